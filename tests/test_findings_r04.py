"""What the driver holds when keys are looked up in large tables."""

import re

import pytest
from pyspark.sql import functions as F

from movewise.operators import validate
from movewise.sources import generator, testbed
from movewise.sources.schema import conformed


@pytest.fixture(scope="module")
def sample(spark):
    return {k: conformed(v, k).cache() for k, v in generator.generate(spark).items()}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_large_tables_are_not_sent_by_the_driver(spark, sample, monkeypatch):
    monkeypatch.setattr(validate, "MANY_KEYS", 0, raising=False)
    plans, counts = [], validate._counts
    monkeypatch.setattr(validate, "_counts", lambda name, df, checks: plans.append(planned(df)) or counts(name, df, checks))
    validate.validate(spark, sample)
    joins = re.findall(r"(\w+Join) .*\b_k\d", "\n".join(plans))
    assert len(joins) > 12 and set(joins) == {"SortMergeJoin"}


def test_tables_are_checked_in_a_plan_each(spark, sample):
    """What is left is a row for each issue, in a plan that reads no table, and is not computed again by who asks twice."""
    tables = dict(generator.with_defects(sample))
    tables["fact_orders"] = tables["fact_orders"].drop("channel")
    del tables["fact_targets"]
    issues = validate.validate(spark, tables)
    plan = planned(issues)
    assert "InMemoryTableScan" not in plan and "Join" not in plan and "HashAggregate" not in plan
    rows = [tuple(r) for r in issues.collect()]
    assert rows == sorted(rows) and {("fact_targets", "table_present", "ERROR", 1), ("fact_orders", "required_columns", "ERROR", 1)} < set(rows) and all(r[3] > 0 for r in rows)
    assert [c for t, c, *_ in rows if t == "fact_orders"] == ["required_columns"] and any(c == "duplicate_key" for _, c, *_ in rows)


def test_lost_keys_are_counted_alike_in_small_and_in_large_tables(spark, sample, monkeypatch):
    """Keys that are null, unknown, or both in one row; a null date is no lost key. Some parents large, all, or none."""
    k = F.pmod(F.hash("order_id", "sku_id"), F.lit(12))
    sales = sample["fact_sales"].withColumns({
        "customer_id": F.when(k == 0, "nobody").when(k == 1, None).otherwise(F.col("customer_id")), "sku_id": F.when(k < 3, "none").otherwise(F.col("sku_id")),
        "kam_id": F.when(k != 4, F.col("kam_id")), "date": F.when(k == 5, None).when(k == 6, F.lit("1900-01-01").cast("date")).otherwise(F.col("date")),
    }).cache()
    sales.count()
    known = {key: {r[0] for r in sample[t].select(key).collect()} for key, t in [("customer_id", "dim_customer"), ("sku_id", "dim_sku"), ("kam_id", "dim_kam"), ("region_code", "dim_region"), ("date", "dim_date")]}
    rows = sales.select(*known).collect()
    want = {f"fk_{key}": sum(r[key] not in have and (key != "date" or r[key] is not None) for r in rows) for key, have in known.items()}
    assert all(want[f"fk_{key}"] > 0 for key in known if key != "region_code")
    for many in (0, len(known["kam_id"]), 10**6):
        monkeypatch.setattr(validate, "MANY_KEYS", many, raising=False)
        found = {r["check"]: r["rows"] for r in validate.validate(spark, sample | {"fact_sales": sales}).where("table = 'fact_sales' AND check LIKE 'fk%'").collect()}
        assert found == {c: n for c, n in want.items() if n}


def test_places_are_sent_and_not_who_lives_there(spark):
    """Also where only a column of customers or suppliers is read, as to count them."""
    m = testbed.Model(spark, "/root/testdata/sf0.001")
    for df in (m.dim_customer().agg(F.count("*")), m.lines().agg(F.count("*")), m.fact_inventory().agg(F.count("*"))):
        joins = re.findall(r"BroadcastHashJoin \[[cs]_nationkey.*", planned(df))
        assert joins and all("BuildRight" in j for j in joins), joins


def test_many_products_are_not_sent_by_the_driver(spark, monkeypatch):
    m = testbed.Model(spark, "/root/testdata/sf0.001")
    total = lambda df: tuple(df.agg(F.count("*"), F.sum("sku_id"), F.sum(F.crc32("category"))).first())
    want = [total(m.fact_sales()), total(m.returns())]
    monkeypatch.setattr(testbed, "MANY_PRODUCTS", 0)
    for df in (m.fact_sales(), m.fact_sales().select("order_id", "sku_id"), m.returns()):
        assert not re.search(r"BroadcastHashJoin \[(l_partkey|sku_id)", planned(df))
    assert [total(m.fact_sales()), total(m.returns())] == want
