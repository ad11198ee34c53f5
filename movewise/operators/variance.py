"""Trends and variances: each period against an earlier one, a target, or a forecast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even, label, period_start, ratio, require
from ..sources.schema import TARGET_RULES

COLUMNS = ["metric", "segment", "period_type", "period_start", "comparison_period", "actual", "comparison_value", "variance", "variance_pct", "comparison_type"]


def trend(summary: DataFrame, metric: str, group_by: Sequence[str] = (), periods_back: int = 1) -> DataFrame:
    """Rows that have an earlier row of their segment `periods_back` rows before."""
    require(summary.columns, [metric, "period_start", *group_by], "the period summary")
    if periods_back < 1:
        raise ValueError("periods_back must be 1 or more")
    if "period_start" in group_by:
        raise ValueError("period_start cannot be a group")
    by = Window.partitionBy(*group_by).orderBy("period_start")
    kind = [F.col("period_type")] if "period_type" in summary.columns else []
    out = summary.select(
        F.lit(metric).alias("metric"), *group_by, *kind, "period_start", F.lag("period_start", periods_back).over(by).alias("previous_period_start"),
        F.col(metric).cast("double").alias("value"), F.lag(F.col(metric).cast("double"), periods_back).over(by).alias("previous_value"),
    ).where(F.col("previous_value").isNotNull())
    out = out.withColumn("absolute_change", half_even(F.col("value") - F.col("previous_value"), 6))
    return out.withColumn("pct_change", ratio("absolute_change", "previous_value", 4))


def latest_movement(trends: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    by = Window.partitionBy(*group_by).orderBy(F.desc("period_start"))
    return trends.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _assemble(frame: DataFrame, metric: str, group_by: Sequence[str], kind: str) -> DataFrame:
    out = frame.withColumn("variance", half_even(F.col("actual") - F.col("comparison_value"), 6))
    out = out.withColumns({"metric": F.lit(metric), "segment": label(group_by), "comparison_type": F.lit(kind), "variance_pct": ratio("variance", "comparison_value", 4)})
    return out.select(*COLUMNS, *[g for g in group_by if g not in COLUMNS])


def versus_previous(summary: DataFrame, metric: str, group_by: Sequence[str] = ()) -> DataFrame:
    t = trend(summary, metric, group_by).withColumnsRenamed({"value": "actual", "previous_value": "comparison_value", "previous_period_start": "comparison_period"})
    return _assemble(t.drop("metric"), metric, group_by, "previous_period")


def versus_target(summary: DataFrame, targets: DataFrame, metric: str, target: str, period: str, group_by: Sequence[str] = ()) -> DataFrame:
    if target not in TARGET_RULES:
        raise ValueError(f"unknown target {target!r}")
    require(targets.columns, [target, "date", *group_by], "the targets")
    rule = F.sum(F.col(target).cast("decimal(18,2)")).cast("double") if TARGET_RULES[target] == "sum" else half_even(F.avg(target), 6)
    plan = targets.groupBy(period_start("date", period).alias("period_start"), *group_by).agg(rule.alias("comparison_value"))
    joined = summary.join(plan, ["period_start", *group_by], "left").where(F.col("comparison_value").isNotNull())
    frame = joined.select("period_start", *group_by, F.lit(period).alias("period_type"), F.col("period_start").alias("comparison_period"), F.col(metric).cast("double").alias("actual"), "comparison_value")
    return _assemble(frame, metric, group_by, "target")


def versus_forecast(actual: DataFrame, forecast: DataFrame, metric: str) -> DataFrame:
    """actual (date, value) and forecast (date, forecast), on the dates that both have; none is an error."""
    both = actual.join(forecast, "date")
    if both.isEmpty():
        raise ValueError("actual and forecast share no date")
    frame = both.select(F.col("date").alias("period_start"), F.lit("day").alias("period_type"), F.col("date").alias("comparison_period"), F.col("value").cast("double").alias("actual"), F.col("forecast").alias("comparison_value"))
    return _assemble(frame, metric, [], "forecast")


def combine(*frames: DataFrame) -> DataFrame:
    for f in frames:
        require(f.columns, COLUMNS, "a variance table")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rank(variances: DataFrame, direction: str = "negative", top_n: int = 10) -> DataFrame:
    """The largest variances; ties go by segment and period."""
    if direction not in ("negative", "positive", "absolute"):
        raise ValueError("direction must be negative, positive or absolute")
    v = F.col("variance")
    order = {"negative": v.asc(), "positive": v.desc(), "absolute": F.abs(v).desc()}[direction]
    keep = {"negative": v < 0, "positive": v > 0, "absolute": v.isNotNull()}[direction]
    return variances.where(keep).orderBy(order, "segment", "period_start").limit(top_n)
