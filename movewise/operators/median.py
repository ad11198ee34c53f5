"""Exact medians of groups of any size: by counting and narrowing, no group is held in one task's memory.

Equal values are counted first, dealt by group and value, so that a group with a third of all rows is
spread over all tasks. Then each group's range is cut into bins, the bins are counted, and only the one or
two bins that hold the middle ranks go on, to be cut again or to be ordered. A window never sees more than
the bins of a group, or the distinct values of a bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import settled

BINS = 4096


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", rounds: int = 1, bins: int = BINS) -> DataFrame:
    """keys and the median of value (double, nulls apart; a group of nulls only has none). The mean of the two middle values where their number is even."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    rows = settled(rows.withColumns({"_g": F.lit(0).cast("long"), "_base": F.lit(0).cast("long")}))
    total = rows.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    middle = [F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)]
    for _ in range(rounds):
        rows = _narrowed(rows, total, keys, middle, bins)
    by = Window.partitionBy(*keys, "_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = _met(rows, total, keys).withColumn("_end", F.col("_base") + F.sum("_n").over(by)).withColumn("_begin", F.col("_end") - F.col("_n"))
    low, high = (F.max(F.when((F.col("_begin") <= m) & (m < F.col("_end")), F.col("_v"))) for m in middle)
    return placed.groupBy(*keys).agg((low * 0.5 + high * 0.5).alias(name))


def _met(rows: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with the columns of other, null keys meeting null keys."""
    if not on:
        return rows.crossJoin(other)  # other is one row
    renamed = other.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(on)})
    same = [rows[c].eqNullSafe(renamed[f"_k{i}"]) for i, c in enumerate(on)]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return rows.join(renamed, out).drop(*[f"_k{i}" for i in range(len(on))])


def _narrowed(rows: DataFrame, total: DataFrame, keys: list[str], middle: list, bins: int) -> DataFrame:
    """The rows of the bins that hold a middle rank; _g tells bins apart, _base is how many rows come before one."""
    group = [*keys, "_g"]
    ends = rows.groupBy(*group).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_a")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    binned = _met(rows, ends, group).withColumn("_bin", bin_).drop("_a", "_b")
    counted = binned.groupBy(*group, "_base", "_bin").agg(F.sum("_n").alias("_m"))
    by = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = _met(counted.withColumn("_end", F.col("_base") + F.sum("_m").over(by)).withColumn("_begin", F.col("_end") - F.col("_m")), total, keys)
    holds = [(F.col("_begin") <= m) & (m < F.col("_end")) for m in middle]
    kept = counted.where(holds[0] | holds[1]).select(*group, "_bin", F.col("_begin").alias("_before"))
    out = _met(binned, kept, [*group, "_bin"])
    return out.select(*keys, "_v", "_n", (F.col("_g") * bins + F.col("_bin")).alias("_g"), F.col("_before").alias("_base"))
