"""Exact medians with a hot group, files of one size."""

import os

import pytest
from pyspark.sql import functions as F

from movewise.operators.median import medians
from movewise.sources import store


@pytest.mark.parametrize(("rounds", "bins"), [(0, 8), (1, 8), (2, 5), (1, 4096)])
def test_medians_are_percentiles(spark, rounds, bins):
    """A third of all rows in one group, ties, a group of one, of two, of nulls, a null key, negative and equal values."""
    hot = spark.range(6000).select(F.lit("hot").alias("k"), (F.pmod(F.hash("id"), F.lit(9001)) / 7.0).alias("v"))
    rest = spark.range(3000).select(F.concat(F.lit("k"), (F.col("id") % 40)).alias("k"), F.when(F.col("id") % 11 != 0, F.pmod(F.hash("id"), F.lit(50)) - 25.0).alias("v"))
    odd = spark.createDataFrame([("one", 3.0), ("two", 1.0), ("two", 2.5), ("none", None), (None, 4.0), (None, 8.0), ("same", 5.0), ("same", 5.0), ("same", 5.0), ("far", -1e300), ("far", 1e300), ("far", 7.0)], "k string, v double")
    df = hot.unionByName(rest).unionByName(odd)
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect() if r["m"] is not None}
    assert {r["k"]: r["median"] for r in medians(df, ["k"], "v", rounds=rounds, bins=bins).collect()} == want


def test_median_of_everything_and_of_nothing(spark):
    df = spark.range(10).select((F.col("id") * 1.5).alias("v"))
    assert medians(df, [], "v").collect()[0]["median"] == 6.75
    assert medians(df.where("v < 0").withColumn("k", F.lit(1)), ["k"], "v").collect() == []


@pytest.mark.parametrize("rows", [40_000, 400_000])
def test_files_of_one_size(spark, tmp_path, rows):
    df = spark.range(rows).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    for n, name in ((1, "few"), (64, "many")):
        store.write_sized(df.repartition(n), f"{tmp_path}/{name}", 2 << 20)
        sizes = [os.path.getsize(f"{tmp_path}/{name}/{f}") for f in os.listdir(f"{tmp_path}/{name}") if f.endswith(".parquet")]
        whole = sum(sizes)
        assert max(1, whole // (4 << 20)) <= len(sizes) <= max(1, -(-whole // (1 << 20)) + 1), (len(sizes), whole)
        assert max(sizes) < 5 << 20
    assert spark.read.parquet(f"{tmp_path}/many").count() == rows
    store.write_sized(df.limit(100), f"{tmp_path}/small", 2 << 20)
    assert len([f for f in os.listdir(f"{tmp_path}/small") if f.endswith(".parquet")]) == 1
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) in (None, "67108864b", "64MB", "67108864")
