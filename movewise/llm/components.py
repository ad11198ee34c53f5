"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is two aggregations and a join over (node, node) pairs; a hub costs one partial row per
task in the aggregation, and the join may be split by AQE. Edges are cut to a written table after
each round. Nothing about single nodes reaches the driver, only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mark, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to_least = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(u, v): each node of the edge table (columns u, v: long) that is not the smallest of its component, and that smallest node. rows: at most so many edges."""
    since = mark()
    now = staged(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges", rows)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now
        before = state
        now = staged(_small_star(_large_star(now)), "edges", state[0])
        discard(since, now)
