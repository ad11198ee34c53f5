"""Databases and the catalog's warehouse: scans by quantiles, replacement as a whole, buckets without a shuffle."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from movewise.operators import mart
from movewise.plans import stages
from movewise.sources import generator, jdbc, store
from movewise.sources.schema import TABLES, conformed
from movewise.sources.warehouse import Warehouse


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


@pytest.fixture(scope="module")
def sample(spark):
    return {k: conformed(v, k).cache() for k, v in generator.generate(spark).items()}


# JDBC.


def parts_of(df):
    return [n for n in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().orderBy("p").toPandas()["count"]]


@pytest.mark.parametrize(("key", "value"), [("k", "id * id"), ("k", "cast(id as double) / 7 - 100"), ("k", "date_add(date'2024-01-01', cast(id % 90 as int))"), ("k", "concat('c', lpad(id, 5, '0'))"), ("k", "cast(id as decimal(12,2)) - 300")])
def test_scan_by_quantiles(spark, url, key, value):
    rows = spark.range(3000).selectExpr(f"{value} AS k", "id AS v", "concat('x''', id) AS w").withColumn("k", F.when(F.col("v") % 50 != 0, F.col("k"))).repartition(2)
    jdbc.replace_tables({"t": rows}, url, "VARCHAR(50)")
    back = jdbc.load_jdbc(spark, url, "t", key, 6)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    sizes = parts_of(back)
    assert len(sizes) == 7 and sizes[0] == 60 and max(sizes) < 700


def test_a_crowded_key_is_a_task_of_its_own(spark, url):
    rows = spark.range(2000).select(F.when(F.col("id") < 1000, F.lit(5 * 10**12)).otherwise(F.col("id") * 10**10).alias("k"), "id").repartition(2)
    jdbc.replace_tables({"t": rows}, url)
    where = jdbc.predicates(spark, url, "t", "k", 8)
    sizes = [rows.where(w.replace('"', "")).count() for w in where]
    assert sum(sizes) == 2000 and sorted(sizes)[-1] <= 1130 and sorted(sizes)[-2] <= 260, (where, sizes)


def test_projection_and_filter_reach_the_database(spark, url):
    jdbc.replace_tables({"t": spark.range(100).selectExpr("id AS k", "id % 3 AS v", "'a' AS w")}, url, "VARCHAR(9)")
    df = jdbc.load_jdbc(spark, url, "t", "k", 4).where("v = 1").select("k")
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: .*EqualTo\(v,1\)", plan) and re.search(r"ReadSchema: struct<k:bigint", plan)
    assert df.count() == 33 and df.rdd.getNumPartitions() == 4


def test_odd_tables(spark, url):
    jdbc.replace_tables({"t": spark.createDataFrame([], "k int, w string"), "u": spark.createDataFrame([(None, "a"), (None, "b")], "k int, w string"), "o": spark.createDataFrame([(7, "a")], "k int, w string")}, url, "VARCHAR(9)")
    assert jdbc.load_jdbc(spark, url, "t", "k", 4).collect() == []
    assert jdbc.load_jdbc(spark, url, "u", "k", 4).count() == 2
    assert jdbc.load_jdbc(spark, url, "o", "k", 4).count() == jdbc.load_jdbc(spark, url, "o", "w", 4).count() == jdbc.load_jdbc(spark, url, "o").count() == 1
    with pytest.raises(ValueError, match="unsafe"):
        jdbc.load_jdbc(spark, url, "t; DROP TABLE t")


def test_tables_are_replaced_together(spark, url):
    old = {"a": spark.createDataFrame([(1,)], "k int"), "b": spark.createDataFrame([(1,)], "k int")}
    jdbc.replace_tables(old, url)
    new = {"a": spark.createDataFrame([(2,), (3,)], "k int"), "b": spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("k"))}
    with pytest.raises(Exception, match="no"):
        jdbc.replace_tables(new, url)
    assert [r["k"] for n in "ab" for r in jdbc.load_jdbc(spark, url, n).collect()] == [1, 1]
    with pytest.raises(Exception):  # noqa: B017  rows of another shape than the table: the transaction is rolled back
        jdbc.replace_tables({"a": new["a"], "b": spark.createDataFrame([(1, 2)], "k int, more int")}, url)
    assert [r["k"] for n in "ab" for r in jdbc.load_jdbc(spark, url, n).collect()] == [1, 1]
    jdbc.replace_tables({"a": new["a"]}, url)
    assert sorted(r["k"] for r in jdbc.load_jdbc(spark, url, "a").collect()) == [2, 3]
    left = [r[0] for r in spark.read.jdbc(url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') q").collect()]
    assert sorted(left) == ["A", "B"]


def test_the_model_in_a_database(spark, url, sample):
    store.build_warehouse(sample, url, text_type="VARCHAR(100)")
    back = jdbc.load_jdbc(spark, url, "fact_orders", "date", 5)
    assert sorted(map(tuple, conformed(back, "fact_orders").collect())) == sorted(map(tuple, sample["fact_orders"].collect()))
    with pytest.raises(ValueError, match="lacks"):
        store.build_warehouse({"dim_kam": sample["dim_kam"]}, url)


# The catalog.


def test_versions_and_their_pointer(spark, tmp_path, sample):
    house = Warehouse(spark, f"file://{tmp_path}/house", "wa")
    with pytest.raises(ValueError, match="nothing has been published"):
        house.open()
    first = house.publish(sample)
    before = house.open()
    assert before.database == first.database
    assert {r["table"]: r["rows"] for r in before.statistics().collect()} == {t: sample[t].count() for t in TABLES}
    assert sorted(map(tuple, before.table("fact_targets").collect())) == sorted(map(tuple, sample["fact_targets"].collect()))
    assert before.table("mart_commercial_daily").count() > 0

    broken = sample | {"fact_kam_targets": sample["fact_kam_targets"].withColumn("kam_id", F.lit("K9"))}
    with pytest.raises(ValueError, match="fact_kam_targets.kam_id"):
        house.publish(broken)
    midway = sample | {"fact_orders": sample["fact_orders"].withColumn("ordered_units", F.raise_error(F.lit("lost")).cast("int"))}
    with pytest.raises(Exception, match="lost"):
        house.publish(midway)
    with pytest.raises(ValueError, match="repeats"):
        house.publish(sample | {"dim_kam": sample["dim_kam"].unionByName(sample["dim_kam"])})
    assert house.current() == first.database and house.versions() == [first.database]

    less = sample | {"fact_targets": sample["fact_targets"].limit(5)}
    house.publish(less)
    assert house.open().table("fact_targets").count() == 5 and before.table("fact_targets").count() == sample["fact_targets"].count()
    assert house.vacuum(keep=1) == [] and house.vacuum(keep=0) == [first.database]
    assert house.versions() == [house.current()] and house.open().table("fact_targets").count() == 5


def exchanges_over(plan, table):
    """Shuffles between a scan of a table and the aggregate that follows it."""
    lines, out = plan.splitlines(), []
    for k, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
            for above in reversed(lines[:k]):
                d = len(above) - len(above.lstrip(" :+-*(0123456789)"))
                if d < depth:
                    depth = d
                    if "Union" in above:
                        break
                    if "Exchange" in above:
                        out.append(above.strip())
    return out


def test_no_shuffle_of_bucketed_lines(spark, tmp_path, sample):
    house = Warehouse(spark, f"file://{tmp_path}/house", "wb")
    t = house.publish(sample, buckets=4).tables()
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = mart.commercial_mart(t)._jdf.queryExecution().executedPlan().toString()
        flat = mart.commercial_mart(Warehouse(spark, f"file://{tmp_path}/flat", "wc").publish(sample).tables())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    for name in ("fact_sales", "fact_orders"):
        assert exchanges_over(plan, name) == []
        assert len(exchanges_over(flat, name)) >= 1
    assert sorted(map(tuple, mart.commercial_mart(t).collect()), key=str) == sorted(map(tuple, mart.commercial_mart(sample).collect()), key=str)


def test_stages(spark, tmp_path, sample):
    """Damaged tables are cleaned, gated and published with their reports; what cleaning cannot mend leaves no version."""
    house, lake = Warehouse(spark, f"file://{tmp_path}/house", "wd"), store.Lake(spark, f"file://{tmp_path}/lake")
    done = stages.load(spark, {k: v for k, v in generator.with_defects(sample).items()}, house, lake)
    assert done.errors_before > 0 and done.audit.count() > 0
    rows = {r["table"]: (r["loaded"], r["quarantined"]) for r in done.tables.collect()}
    assert rows["fact_orders"][1] == 1 and rows["fact_sales"] == (sample["fact_sales"].count(), 0)
    assert lake.read_curated("clean")["fact_sales"].count() == rows["fact_sales"][0]
    back = sample["fact_sales"].where("units > 3").select("order_id", "sku_id", "region_code", "customer_id", "date", F.lit(1).alias("returned_units"))
    told = {r["table"]: r["rows"] for r in stages.publish(house.open(), back).collect()}
    assert len(told) == 7 and told["rpt_country_contribution"] == 4
    assert spark.table(f"{house.current()}.rpt_monthly_trade").count() == told["rpt_monthly_trade"]
    with pytest.raises(Exception):  # noqa: B017
        stages.load(spark, sample | {"fact_targets": sample["fact_targets"].withColumn("fill_rate_target", F.lit(7.0))}, house)
    assert house.versions() == [done.version.database]
