"""Work that a round's findings named: what is computed how often, and what is moved."""

import re

import pytest
from pyspark.sql import functions as F

from movewise.operators import mart, validate
from movewise.plans import chart_queries, charts, report_queries, reports, stages
from movewise.sources import generator, testbed
from movewise.sources.schema import conformed
from movewise.sources.warehouse import Warehouse


@pytest.fixture(scope="module")
def sample(spark):
    return {k: conformed(v, k).cache() for k, v in generator.generate(spark).items()}


def counted(spark, df):
    """df, and how many of its rows have been computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(look, df.schema), seen


def test_a_load_computes_its_raw_rows_three_times_at_most(spark, tmp_path, sample):
    """For the errors before, their keys, and the cleaning; the gate, the warehouse and the counts read what was written."""
    raw = dict(generator.with_defects(sample))
    n = raw["fact_sales"].count()
    raw["fact_sales"], seen = counted(spark, raw["fact_sales"])
    done = stages.load(spark, raw, Warehouse(spark, f"file://{tmp_path}/house", "wl"))
    assert done.audit.where("table = 'fact_sales'").count() and seen.value <= 3 * n


def test_masks_tell_what_conditions_tell(spark):
    """Each check of more conditions than a mask holds, and keys of one type or of two."""
    df = spark.createDataFrame([(1, None, 5), (2, 3, -1), (None, 4, 200)], "a int, b int, c int")
    checks = {f"c{i}": ("ERROR", F.col("c") > i - 2) for i in range(2 * validate.MASK + 3)} | {"null": ("WARNING", F.col("b").isNull())}
    narrow, bits = validate._masked(df, checks, ["a"])
    assert len(narrow.columns) == 4
    want = {r["check"]: r["rows"] for r in validate._counts("t", df, checks).collect()}
    assert {r["check"]: r["rows"] for r in validate._counts("t", narrow, bits).collect()} == want and want["null"] == 1


def test_no_wide_rows_in_joins_of_keys(spark, sample):
    own = validate._table_checks("fact_sales", sample["fact_sales"], validate.CONTRACTS["fact_sales"])
    joined, checks = validate._with_parents("fact_sales", sample, own)
    assert not {"order_id", "units", "unit_price", "net_sales", "category", "channel"} & set(joined.columns) and set(own) < set(checks)


def test_keys_of_two_types_meet_as_text(spark, sample):
    plans = sample["fact_kam_targets"]
    numbered = {"dim_kam": spark.createDataFrame([(7, "a")], "kam_id int, kam_name string"), "fact_kam_targets": plans.limit(3).withColumn("kam_id", F.lit("7"))}
    rows = {r["check"]: r["rows"] for r in validate._counts("fact_kam_targets", *validate._with_parents("fact_kam_targets", numbered, {})).collect()}
    assert rows == {"fk_kam_id": 0}


def test_the_gate_judges_issues_that_are_computed_once(spark, monkeypatch):
    issues, seen = counted(spark, spark.createDataFrame([("t", "c", "ERROR", 2), ("t", "d", "WARNING", 1)], validate.SCHEMA).coalesce(1))
    monkeypatch.setattr(report_queries, "_broken", lambda m: {})
    monkeypatch.setattr(report_queries.validate, "validate", lambda spark, tables: issues)
    out = report_queries.gate_verdict(type("M", (), {"spark": spark})()).collect()
    assert [tuple(r) for r in out] == [(1, 1, False)] and seen.value == 2


def test_summaries_that_nobody_reads_run_nothing(spark, sample):
    cells = mart.Summaries(sample, ["region_code", "kam_id"])
    spark.sparkContext.setJobGroup("lazy summaries", "")
    try:
        found = [cells.by("week", ["kam_id"]), cells.by("month", ["region_code"]), cells.by("day")]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy summaries")
    finally:
        spark.sparkContext.setJobGroup("", "")
    want = mart.summarise_by_period(sample, "week", ["kam_id"])
    assert sorted(map(str, found[0].select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_unserved_products_look_at_no_dimension(spark, sample):
    plan = reports.supply_views(sample, "month")["by_sku"]._jdf.queryExecution().analyzed().toString()
    assert "Union" in plan and "LeftOuter" not in plan


def test_lines_are_dealt_by_the_size_of_their_table(spark, monkeypatch):
    """Many parts for large tables, with the same rows; Spark's own choice for small ones."""
    m = testbed.Model(spark, "/root/testdata/sf0.001")
    plain, total = m.lines(), lambda df: tuple(df.agg(F.count("*"), F.sum("order_id"), F.sum("ordered_units")).first())
    assert "RepartitionByExpression" not in plain._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(testbed, "PART_BYTES", 2048)
    parts, many = m.parts("lineitem"), m.lines()
    assert parts > testbed.FEW and many._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression") == 2
    assert total(many) == total(plain)


def test_a_chart_of_unserved_products_writes_no_summaries(spark, sample, monkeypatch):
    """Lines are added up by product alone, with nulls as 0; the page shows the same rows."""
    lines = sample["fact_orders"].unionByName(sample["fact_orders"].limit(3).withColumns({"sku_id": F.lit(None).cast("string"), "ordered_units": F.lit(10**6)}))
    lines = lines.unionByName(sample["fact_orders"].limit(3).withColumn("fulfilled_units", F.lit(None).cast("int")))
    page = charts.supply_page(sample | {"fact_orders": lines})["Unserved products"].collect()
    monkeypatch.setattr(mart, "Summaries", None)
    rows = chart_queries.chart_unserved_products(type("M", (), {"tables": lambda self: sample | {"fact_orders": lines}, "fact_orders": lambda self: lines})()).collect()
    sums = {}
    for r in lines.where("sku_id IS NOT NULL").collect():
        sums[r["sku_id"]] = sums.get(r["sku_id"], 0) + (r["ordered_units"] or 0) - (r["fulfilled_units"] or 0)
    want = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:15]
    assert [tuple(r) for r in rows] == [(i + 1, *x) for i, x in enumerate(want)] and rows == page


def test_joins_by_many_products_are_dealt_by_the_size_of_the_lines(spark, monkeypatch):
    """Where products are not broadcast, no step on lines is left to the session's number of partitions; rows stay the same."""
    m, ordered = testbed.Model(spark, "/root/testdata/sf0.001"), lambda df: sorted(map(str, df.collect()))
    want = {f: ordered(f(m)) for f in (lambda m: mart.commercial_mart(m.tables()), testbed.Model.fact_sales, testbed.Model.returns)}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(testbed, "PART_BYTES", 4096)
    monkeypatch.setattr(testbed, "MANY_PRODUCTS", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert m.parts("lineitem") > testbed.FEW
        for f, rows in want.items():
            plan = f(m)._jdf.queryExecution().executedPlan().toString()
            dealt = [(keys, int(n)) for keys, n in re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan) if re.search("partkey|orderkey|sku_id|order_id", keys)]
            assert len(dealt) >= 4 and {n for _, n in dealt} == {m.parts("lineitem")}, dealt
            assert ordered(f(m)) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
