"""Comparing two tables by key with a tolerance: a parity tool."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of only one side (side = left or right), and shared rows with a column that differs (column names it)."""
    values = [c for c in left.columns if c not in keys and c in right.columns]
    a = left.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"a{i}") for i, v in enumerate(values)], F.lit(True).alias("in_a"))
    b = right.select(*[F.col(k).alias(f"j{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"b{i}") for i, v in enumerate(values)], F.lit(True).alias("in_b"))
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"k{i}").eqNullSafe(F.col(f"j{i}")) for i in range(len(keys))]), "full")
    kinds = dict(left.dtypes)

    def unlike(i: int, v: str):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        same = x.eqNullSafe(y)
        return ~(same | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))) if kinds[v] in ("double", "float", "int", "bigint") or kinds[v].startswith("decimal") else ~same

    found = F.array_compact(F.array(*[F.when(unlike(i, v), F.lit(v)) for i, v in enumerate(values)])) if values else F.array().cast("array<string>")
    side = F.when(F.col("in_b").isNull(), "left").when(F.col("in_a").isNull(), "right").otherwise("both")
    out = both.select(*[F.coalesce(f"k{i}", f"j{i}").alias(k) for i, k in enumerate(keys)], side.alias("side"), F.when(side == "both", found).alias("columns"))
    return out.where((F.col("side") != "both") | (F.size("columns") > 0))
