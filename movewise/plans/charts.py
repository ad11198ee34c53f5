"""Frames that a chart draws as they are: one measure each, in long form, series folded and given fixed slots.

A slot stands for a colour. It belongs to a series, not to its place in what is shown: take `slots` once from the
whole frame and give them to every chart of it, and a filter repaints nothing. "Other" has slot -1, a neutral tone.
Sums are exact (money as decimals), rates are rebuilt from their parts, never added or averaged. Rows without a key
count as "Other". An empty frame gives an empty chart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even, money_sum, ratio, require
from ..operators import kpi, mart, variance
from ..sources.schema import RATES
from . import reports

SERIES, BARS = 8, 12
OTHER = "Other"


def _exact(df: DataFrame, column: str) -> Column:
    """Sum of a column that does not depend on the order of rows."""
    return (money_sum(column) if dict(df.dtypes)[column] in ("double", "float") else F.sum(column).cast("long")).alias(column)


def totals(frame: DataFrame, key: str, measures: Sequence[str] = ("net_sales", "sales_units", "order_count")) -> DataFrame:
    """One row for each value of a dimension: measures over all periods of a summary."""
    require(frame.columns, [key, *measures], "the frame")
    if rates := [m for m in measures if m in RATES]:
        raise ValueError(f"rates do not add up: {rates}")
    return frame.where(F.col(key).isNotNull()).groupBy(key).agg(*[_exact(frame, m) for m in measures])


def slots(frame: DataFrame, key: str, value: str, limit: int = SERIES) -> DataFrame:
    """(key, slot), limit rows at most: every series where they are that few, else the limit - 1 largest by absolute total. Slots go by code."""
    if limit < 2:
        raise ValueError("a chart needs two series or more")
    size = F.abs(value)
    first = totals(frame, key, [value]).orderBy(size.desc(), key).limit(limit + 1)  # each task keeps its own few
    ranked = first.select(key, F.row_number().over(Window.orderBy(size.desc(), key)).alias("_n"), F.count("*").over(Window.partitionBy()).alias("_k"))
    kept = ranked.where((F.col("_k") <= limit) | (F.col("_n") < limit))
    return kept.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("slot"))


def folded(frame: DataFrame, key: str, series: DataFrame) -> DataFrame:
    """frame with the name of its series in place of the key, and the slot: what is measured by key can then be measured by series."""
    named = F.broadcast(series.select(F.col(key).alias("_key"), F.col("slot").alias("_slot")))  # a few rows, by `slots`
    joined = frame.join(named, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(key, F.coalesce("_key", F.lit(OTHER))).withColumn("slot", F.coalesce("_slot", F.lit(-1))).drop("_key", "_slot")


def over_time(frame: DataFrame, x: str, value: str, key: str, series: DataFrame) -> DataFrame:
    """x, series, slot and the value; what has no slot is "Other"."""
    parts = RATES[value] if value in RATES else (value,)
    require(frame.columns, [x, key, *parts], "the frame")
    out = folded(frame, key, series).groupBy(x, F.col(key).alias("series"), "slot").agg(*[_exact(frame, p) for p in parts])
    return out if len(parts) == 1 else out.select(x, "series", "slot", ratio(*parts, 2 if value == "aov" else 4).alias(value))


def stock_over_time(inventory: DataFrame, skus: DataFrame, period: str, key: str, series: DataFrame) -> DataFrame:
    """Levels and stockouts by series. They are means, which do not add up: the key is folded before they are taken."""
    levels = mart.inventory_by_period(folded(inventory, key, series), skus, period, [key, "slot"])
    return levels.select("period_start", F.col(key).alias("series"), "slot", "available_stock", "stockout_rate")


def ranked(frame: DataFrame, label: str, value: str, also: Sequence[str] = (), most: int = BARS, largest: bool = True) -> DataFrame:
    """The first rows by value, from 1; ties go by label and what else is named, nulls are left out."""
    order = [F.desc(value) if largest else F.asc(value), F.col(label), *[F.col(c) for c in also]]
    top = frame.where(F.col(value).isNotNull()).orderBy(*order).limit(most)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("position"), *also, label, value)


def bars(frame: DataFrame, key: str, value: str, most: int = BARS) -> DataFrame:
    """The largest totals."""
    return ranked(totals(frame, key, [value]), key, value, most=most)


def gaps(frame: DataFrame, label: str, value: str, also: Sequence[str] = (), most: int = BARS) -> DataFrame:
    """The rows furthest behind a reference, with the side of zero on which they lie."""
    side = F.when(F.col(value) < 0, "behind").when(F.col(value) > 0, "ahead").otherwise("even")
    return ranked(frame, label, value, also, most, largest=False).withColumn("side", side)


def against_expected(frame: DataFrame, x: str, actual: str, expected: str) -> DataFrame:
    """Two lines of one measure: x, line, value."""
    line = lambda name, c: F.struct(F.lit(name).alias("line"), F.col(c).cast("double").alias("value"))
    return frame.select(x, F.explode(F.array(line("Actual", actual), line("Expected", expected))).alias("_l")).select(x, "_l.line", "_l.value")


def stacked(frame: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """key, part, slot, value, and the part's share of its bar; slots go by the parts' order."""
    whole = F.nullif(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(i).alias("slot"), F.col(p).alias("value"), half_even(F.col(p) / whole, 4).alias("share")) for i, p in enumerate(parts)])
    return frame.select(key, F.explode(cells).alias("_c")).select(key, "_c.*")


def unserved_products(orders: DataFrame, most: int = 15) -> DataFrame:
    """Products by units ordered and not delivered, over all dates: lines are added up by product, without their orders or periods."""
    missing = F.coalesce("ordered_units", F.lit(0)) - F.coalesce("fulfilled_units", F.lit(0))
    return bars(orders.select("sku_id", missing.alias("unfulfilled_units")), "sku_id", "unfulfilled_units", most)


def sales_page(t: dict[str, DataFrame], period: str = "week") -> dict[str, DataFrame]:
    """Charts of a page on sales: each cut as totals and over time, the largest shortfalls against plan, sell-in beside sell-through."""
    dims, out = ["region_code", "category", "channel", "kam_id"], {}
    cells = mart.Summaries(t, dims)
    for d in dims:
        cut = cells.by(period, [d])
        out |= {f"Net sales by {d}": bars(cut, d, "net_sales"), f"{d} over time": over_time(cut, "period_start", "net_sales", d, slots(cut, d, "net_sales")), f"{d} totals": totals(cut, d)}
    plan = variance.versus_target(cells.by(period, dims[:2]), t["fact_targets"], "net_sales", "sales_target", period, dims[:2])
    mix = kpi.primary_secondary_mix(t["fact_sales"], ["region_code"])
    return out | {"Shortfalls": gaps(plan, "segment", "variance", ["period_start"]), "Sell-in and sell-through": stacked(mix, "region_code", ["primary_sales", "secondary_sales"])}


def supply_page(t: dict[str, DataFrame], period: str = "week") -> dict[str, DataFrame]:
    """Charts of a page on supply: service and stock by region, the largest gaps to the service target, products ordered and not delivered."""
    cells = mart.Summaries(t, ["region_code", "category"])
    regions = cells.by(period, ["region_code"])
    series = slots(regions, "region_code", "ordered_units")
    plan = variance.versus_target(cells.by(period, ["region_code", "category"]), t["fact_targets"], "fill_rate", "fill_rate_target", period, ["region_code", "category"])
    return {
        "Fill rate by region": over_time(regions, "period_start", "fill_rate", "region_code", series), "Stock by region": stock_over_time(t["fact_inventory"], t["dim_sku"], period, "region_code", series),
        "Gaps to target": gaps(plan, "segment", "variance", ["period_start"]), "Unserved products": unserved_products(t["fact_orders"]),
    }


def forecast_page(t: dict[str, DataFrame], metric: str = "net_sales", **options) -> dict[str, DataFrame]:
    """Charts of a page on forecasts: methods by their error rate, the best one against what came, and its errors."""
    sheets = reports.forecast_report(t, **options)
    tested = sheets[f"Backtest {metric}"]
    return {"Error rates": ranked(sheets[f"Accuracy {metric}"], "model", "wape", largest=False), "Actual and expected": against_expected(tested, "date", "actual", "forecast"), "Errors": tested.select("date", "error")}


PAGES = {"sales": sales_page, "supply": supply_page, "forecast": forecast_page}
