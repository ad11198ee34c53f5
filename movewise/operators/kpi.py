"""KPI tables: sales, orders, primary/secondary mix, growth, target variance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even, money_sum, ratio, require


def sales_kpis(sales: DataFrame, group_by: Sequence[str] = ("date",)) -> DataFrame:
    require(sales.columns, [*group_by, "order_id", "units", "unit_price", "discount_pct", "net_sales"], "sales")
    sums = sales.groupBy(*group_by).agg(F.count_distinct("order_id").alias("order_count"), F.sum("units").cast("long").alias("units"), money_sum(F.col("units") * F.col("unit_price")).alias("gross_sales"), money_sum("net_sales").alias("net_sales"))
    return sums.withColumns({"discount_value": half_even(F.col("gross_sales") - F.col("net_sales"), 2), "aov": ratio("net_sales", "order_count", 2)})


def fill_rate(fulfilled: Column | str, ordered: Column | str) -> Column:
    return ratio(fulfilled, ordered, 4)


def order_kpis(orders: DataFrame, group_by: Sequence[str] = ("date",)) -> DataFrame:
    """The cancellation rate stays unrounded."""
    require(orders.columns, [*group_by, "order_id", "ordered_units", "fulfilled_units", "cancelled_units"], "orders")
    sums = orders.groupBy(*group_by).agg(F.count_distinct("order_id").alias("order_count"), *[F.sum(c).cast("long").alias(c) for c in ("ordered_units", "fulfilled_units", "cancelled_units")])
    return sums.withColumns({"fill_rate": fill_rate("fulfilled_units", "ordered_units"), "cancellation_rate": F.when(F.col("ordered_units") > 0, ratio("cancelled_units", "ordered_units"))})


def primary_secondary_mix(sales: DataFrame, group_by: Sequence[str] = ("date",)) -> DataFrame:
    """Rows with a null group key are left out, as a pivot does."""
    require(sales.columns, [*group_by, "sales_type", "net_sales"], "sales")
    part = lambda kind: F.coalesce(money_sum(F.when(F.col("sales_type") == kind, F.col("net_sales"))), F.lit(0.0))
    known = sales
    for g in group_by:
        known = known.where(F.col(g).isNotNull())
    out = known.groupBy(*group_by).agg(part("PRIMARY").alias("primary_sales"), part("SECONDARY").alias("secondary_sales"))
    out = out.withColumn("total_sales", half_even(F.col("primary_sales") + F.col("secondary_sales"), 2))
    share = lambda c: F.when(F.col("total_sales") > 0, ratio(c, "total_sales", 4))
    return out.withColumns({"primary_mix": share("primary_sales"), "secondary_mix": share("secondary_sales")})


def add_growth(frame: DataFrame, value: str, group_by: Sequence[str] = (), period: str = "period_start") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*group_by).orderBy(period))
    return frame.withColumn("previous_value", before).withColumn("growth", ratio(F.col(value) - F.col("previous_value"), "previous_value", 4))


def target_variance(actuals: DataFrame, targets: DataFrame, dims: Sequence[str], actual: str = "net_sales", target: str = "sales_target") -> DataFrame:
    """Both sides summed to dims, left from the actuals; the percentage stays unrounded."""
    a = actuals.groupBy(*dims).agg(money_sum(actual).alias("actual"))
    t = targets.groupBy(*dims).agg(money_sum(target).alias("target"))
    out = a.join(t, list(dims), "left").withColumn("variance", half_even(F.col("actual") - F.col("target"), 2))
    return out.withColumn("variance_pct", ratio("variance", "target"))
