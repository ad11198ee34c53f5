"""Names for readers: labels of columns, names behind codes, words for patterns and methods, a glossary.

A view at the end of a plan, never an input of another step: codes stay what they are everywhere else. Codes
meet their names in joins with the dimensions, small or large, and a code without a name stays as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels of columns.
COLUMNS = {
    # Sales
    "net_sales": "Net sales", "gross_sales": "Gross sales", "sales_units": "Units sold", "units": "Units", "sales_order_count": "Orders with sales", "order_count": "Orders", "orders": "Orders", "aov": "Average order value",
    "discount_value": "Discount given", "primary_sales": "Primary (sell-in)", "secondary_sales": "Secondary (sell-through)", "total_sales": "Total sales", "primary_mix": "Primary share", "secondary_mix": "Secondary share",
    # Orders
    "ordered_units": "Units ordered", "fulfilled_units": "Units delivered", "cancelled_units": "Units cancelled", "unfulfilled_units": "Units not delivered", "fill_rate": "Fill rate", "prior_fill_rate": "Fill rate, previous",
    "fill_rate_target": "Fill rate target", "fill_rate_variance": "Fill rate vs target", "fill_rate_change": "Fill rate change", "cancellation_rate": "Cancellation rate",
    # Stock
    "available_stock": "Available stock", "opening_stock": "Opening stock", "received_units": "Units received", "stockout_rate": "Stockout rate",
    # Dimensions
    "region_code": "Region", "city": "City", "zone": "Zone", "category": "Category", "sub_category": "Sub-category", "channel": "Channel", "kam_id": "Account manager", "kam_name": "Account manager", "sku_id": "SKU code", "sku_name": "Product",
    "customer_id": "Customer code", "customer_name": "Customer", "customer_type": "Customer type", "sales_type": "Sales type", "segment": "Segment", "dimension": "Cut by", "warehouse": "Warehouse",
    # Periods
    "period_start": "Period", "week_start": "Week", "date": "Date", "period_type": "Period type", "comparison_period": "Compared with", "previous_period_start": "Previous period", "days_observed": "Days in period", "is_complete": "Complete period",
    # Comparison
    "actual": "Actual", "comparison_value": "Expected", "sales_target": "Sales target", "order_target": "Order target", "variance": "Gap", "variance_pct": "Gap %", "attainment": "Attainment", "target_variance": "Gap to target",
    "target_variance_pct": "Gap to target %", "value": "Value", "previous_value": "Previous", "absolute_change": "Change", "pct_change": "Change %", "change": "Change", "change_pct": "Change %", "movement": "Change",
    "day_over_day_change": "Change vs previous day", "day_over_day_pct": "Change vs previous day %", "prior_day_net_sales": "Net sales, previous day", "direction": "Direction", "before": "Before", "after": "After",
    # Decomposition
    "contribution": "Contribution", "contribution_share": "Share of the change", "share_of_absolute_movement": "Share of all movement", "share_of_net_movement": "Share of net movement", "rate_effect": "From fulfilment",
    "mix_effect": "From demand mix", "interaction_effect": "From both together", "coherence": "Consistency", "ranked_by": "Ranked by",
    # Signals
    "likely_driver": "Likely driver", "impact": "Estimated impact", "estimated_impact": "Estimated impact", "confidence": "Confidence", "priority_score": "Priority", "recommended_investigation": "What to check next", "observation": "Measure",
    "criterion": "Check", "met": "Passed", "detail": "Detail", "basis": "Based on",
    # Forecasts
    "model": "Method", "wape": "Error rate (WAPE)", "mae": "Average error", "rmse": "Error (RMSE)", "mape": "Error rate (MAPE)", "bias": "Bias", "folds": "Test rounds", "n_observations": "Days scored",
    "wape_improvement_vs_baseline": "Better than baseline", "forecast": "Forecast", "error": "Error", "fold": "Round", "origin_date": "Forecast made after", "baseline": "Baseline",
}
#: Columns that have another name here.
COLUMNS |= {"n": "Days scored", "wape_gain": "Better than baseline", "movement_pct": "Change %"}

# Words for the values of some columns.
MODELS = {"naive": "Repeat yesterday", "moving_average_7": "7-day average", "ses": "Weighted recent average", "seasonal_naive_7": "Repeat last week", "seasonal_mean_7": "Same weekday average"}
PATTERNS = {"fulfilment_constraint": "Supply could not keep up", "demand_softness": "Demand weakened", "portfolio_mix_shift": "The sales mix changed", "unclassified": "Not yet clear"}
CRITERIA = {
    "movement_is_material": "Bigger than this segment's usual swing", "movement_persisted": "Moved the same way for more than one period", "segment_carries_the_movement": "This segment accounts for much of the change",
    "other_metrics_agree": "Other measures point the same way", "alternative_not_supported": "The competing explanation does not fit", "movement_is_directional": "A real shift, not segments cancelling out",
}
CONFIDENCE = {"high": "High", "medium": "Medium", "low": "Low"}
DIRECTIONS = {"up": "Up", "down": "Down", "flat": "Steady"}
WORDS = {"model": MODELS, "likely_driver": PATTERNS, "criterion": CRITERIA, "confidence": CONFIDENCE, "direction": DIRECTIONS, "observation": COLUMNS}

#: What the patterns say, and what labels mean.
PATTERN_MEANING = {
    "fulfilment_constraint": "Orders kept coming, and less of what was ordered arrived.", "demand_softness": "Less was ordered, and deliveries went down with the orders, not before them.",
    "portfolio_mix_shift": "Orders went to segments that had other rates all along: the total moved, none of them did.", "unclassified": "No measure moved enough to tell demand from supply.",
}
GLOSSARY = {
    "Fill rate": "Units delivered over units ordered; 0.95 is 95 of 100.", "Average order value": "Net sales over the number of orders.", "Primary (sell-in)": "What the trade bought from us.", "Secondary (sell-through)": "What end customers bought from the trade.",
    "Stockout rate": "Share of days and products without stock in a warehouse.", "Error rate (WAPE)": "Sum of absolute forecast errors over the sum of actual values; lower is better.", "Better than baseline": "Share of the baseline's error rate that a method saves.",
    "From fulfilment": "Part of a change that comes from segments that deliver another share of their orders.", "From demand mix": "Part of a change that comes from orders that went to segments with another rate.",
    "Consistency": "Net over gross movement of a component: near 0 segments cancel out, near 1 they moved one way.", "Estimated impact": "Value of orders that were not served, at the price realised. An estimate, not a loss that was measured.",
    "Confidence": "How many of six named checks the evidence passes. No probability.", "Gap": "Actual less what it is held against; below 0 is short of it.", "Share of the change": "A segment's part of the net change; beyond 100 % where others moved the other way.",
}

#: Codes and the names that dimensions have for them; of codes in several the last one counts.
NAMED = [("dim_region", "region_code", "city"), ("dim_kam", "kam_id", "kam_name"), ("dim_sku", "sku_id", "sku_name"), ("dim_customer", "customer_id", "customer_name")]


def label_of(column: str) -> str:
    return COLUMNS.get(column, column.replace("_", " ").strip().capitalize())


def labelled(df: DataFrame) -> DataFrame:
    """df with labels for column names; where two columns have one label, the later one keeps its own name in words."""
    names: list[str] = []
    for c in df.columns:
        label = label_of(c)
        while label in names:
            label = c.replace("_", " ").capitalize() if c.replace("_", " ").capitalize() not in names else f"{label} ({c})"
        names.append(label)
    return df.toDF(*names)


def in_words(df: DataFrame) -> DataFrame:
    """Values of models, patterns, checks, confidence and direction in words; others are spelled out from their code."""

    def said(c: str, words: dict[str, str]) -> Column:
        known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
        spelled = F.regexp_replace(c, "_", " ")
        return F.coalesce(F.try_element_at(known, F.col(c)), F.concat(F.upper(F.substring(spelled, 1, 1)), F.lower(F.expr(f"substring(replace(`{c}`, '_', ' '), 2)")))).alias(c)

    return df.select(*[said(c, WORDS[c]) if c in WORDS and dict(df.dtypes)[c] == "string" else F.col(c) for c in df.columns])


def named(df: DataFrame, tables: dict[str, DataFrame], columns: Sequence[str] = ("region_code", "kam_id", "sku_id", "customer_id")) -> DataFrame:
    """df with names in the place of codes, as text."""
    order = df.columns
    for dim, key, name in NAMED:
        if key in columns and key in df.columns and dim in tables and {key, name} <= set(tables[dim].columns):
            names = tables[dim].groupBy(F.col(key).cast("string").alias("_code")).agg(F.min(name).alias("_name"))
            code = F.col(key).cast("string")
            df = df.withColumn(key, code).join(names, F.col(key) == F.col("_code"), "left").withColumn(key, F.coalesce("_name", key)).drop("_code", "_name")
    return df.select(*order)


def code_names(tables: dict[str, DataFrame]) -> DataFrame:
    """(code, name) of all dimensions, once each."""
    parts = [tables[dim].select(F.col(key).cast("string").alias("code"), F.lit(k).alias("k"), F.col(name).cast("string").alias("name")) for k, (dim, key, name) in enumerate(NAMED) if dim in tables]
    return reduce(DataFrame.unionByName, parts).where("code IS NOT NULL").groupBy("code").agg(F.max_by("name", F.struct("k", "name")).alias("name"))


def named_segments(df: DataFrame, tables: dict[str, DataFrame], column: str = "segment") -> DataFrame:
    """Segments of several codes, joined by " | ", as names joined by a dot. Distinct segments are looked up, not rows."""
    parts = df.select(F.col(column).alias("_s")).distinct().select("_s", F.posexplode(F.split("_s", r"\s*\|\s*")).alias("_i", "_code"))
    told = parts.join(code_names(tables), F.trim("_code") == F.col("code"), "left").select("_s", "_i", F.coalesce("name", F.trim("_code")).alias("_name"))
    whole = told.groupBy("_s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_name"))), lambda x: x["_name"]), " · ").alias("_names"))
    return df.join(whole, F.col(column) == F.col("_s"), "left").withColumn(column, F.col("_names")).select(*df.columns)


def for_readers(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Names, words and labels at once."""
    out = named_segments(df, tables) if "segment" in df.columns else df
    return labelled(in_words(named(out, tables)))


def glossary(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """(term, meaning) of the labels that some columns have."""
    labels = {label_of(c) for c in columns} | set(columns)
    return spark.createDataFrame([(t, m) for t, m in GLOSSARY.items() if t in labels], "term string, meaning string")
