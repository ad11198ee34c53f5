"""Enrichment, the commercial mart, and period summaries.

Sales and orders are aggregated on their own and only then brought together (by a union of the two
small aggregates, which also matches null keys), so that an order with several lines is never
counted twice. Rates are rebuilt from summed components at every grain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_even, money_sum, period_end, period_start, ratio, require
from ..functions.staging import dealt, settled, shares, with_totals, written
from ..sources.schema import MART_GRAIN

SUMS = ["gross_sales", "net_sales", "sales_units", "sales_order_count", "order_count", "ordered_units", "fulfilled_units", "cancelled_units"]


def left_enrich(fact: DataFrame, dim: DataFrame, key: str, columns: Sequence[str], check: bool = True) -> DataFrame:
    """fact with columns of dim, many to one. check runs a query that refuses repeated keys of dim, so that no fact line is multiplied."""
    require(fact.columns, [key], "the fact")
    require(dim.columns, [key, *columns], "the dimension")
    if clash := [c for c in columns if c in fact.columns]:
        raise ValueError(f"columns {clash} are in both tables")
    if check:
        _require_unique(dim, key)
    return fact.join(dim.select(key, *columns), key, "left")


def _require_unique(dim: DataFrame, key: str) -> None:
    """Refuses repeated keys; a frame that has passed is not asked again."""
    passed = dim.__dict__.setdefault("_unique_keys", set())
    if key not in passed:
        if not dim.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} repeats in the dimension")
        passed.add(key)


def _enriched(fact: DataFrame, tables: dict[str, DataFrame], steps: list[tuple[str, str, list[str]]], check: bool, only: Sequence[str] | None) -> DataFrame:
    parts = 0
    for dim, key, columns in steps:
        if wanted := [c for c in columns if only is None or c in only]:
            fact, parts = left_enrich(fact, tables[dim], key, wanted, check), max(parts, shares(tables[dim]))
    return dealt(fact, "order_id", parts)  # a join by product has taken lines from their orders, which are counted next


def enrich_sales(tables: dict[str, DataFrame], check: bool = True, only: Sequence[str] | None = None) -> DataFrame:
    """Sales with attributes of product, customer, manager and region; `only` skips dimensions that give none of these columns."""
    steps = [
        ("dim_sku", "sku_id", ["sku_name", "sub_category", "pack_size_kg", "unit_cost", "list_price"]), ("dim_customer", "customer_id", ["customer_name", "customer_type"]),
        ("dim_kam", "kam_id", ["kam_name"]), ("dim_region", "region_code", ["city", "zone"]),
    ]
    return _enriched(tables["fact_sales"], tables, steps, check, only)


def enrich_orders(tables: dict[str, DataFrame], check: bool = True, only: Sequence[str] | None = None) -> DataFrame:
    """Likewise; category comes from the product, kam_id from the customer."""
    if only is not None and "kam_name" in only:
        only = [*only, "kam_id"]
    steps = [
        ("dim_sku", "sku_id", ["sku_name", "category", "sub_category", "pack_size_kg"]), ("dim_customer", "customer_id", ["customer_name", "customer_type", "kam_id"]),
        ("dim_kam", "kam_id", ["kam_name"]), ("dim_region", "region_code", ["city", "zone"]),
    ]
    return _enriched(tables["fact_orders"], tables, steps, check, only)


SPAN = ["first_date", "last_date"]


def with_rates(sums: DataFrame) -> DataFrame:
    money = lambda c: half_even(c, 2).alias(c)
    rest = [c for c in sums.columns if c not in SUMS]
    return sums.select(
        *rest, money("gross_sales"), money("net_sales"), *SUMS[2:],
        ratio("fulfilled_units", "ordered_units", 4).alias("fill_rate"), ratio("cancelled_units", "ordered_units", 4).alias("cancellation_rate"),
        ratio("net_sales", "sales_order_count", 2).alias("aov"), half_even(F.col("gross_sales") - F.col("net_sales"), 2).alias("discount_value"),
    )


def commercial_metrics(sales: DataFrame, orders: DataFrame, grain: Sequence[str], span: bool = False) -> DataFrame:
    """All commercial metrics of enriched sales and orders at a grain; missing sides count as 0. span adds each cell's first and last date."""
    require(sales.columns, [*grain, "order_id", "units", "unit_price", "net_sales"], "sales")
    require(orders.columns, [*grain, "order_id", "ordered_units", "fulfilled_units", "cancelled_units"], "orders")
    dates = [F.min("date").alias("first_date"), F.max("date").alias("last_date")] if span else []
    sold = sales.groupBy(*grain).agg(*dates, money_sum(F.col("units") * F.col("unit_price")).alias("gross_sales"), money_sum("net_sales").alias("net_sales"), F.sum("units").cast("long").alias("sales_units"), F.count_distinct("order_id").alias("sales_order_count"))
    placed = orders.groupBy(*grain).agg(*dates, F.count_distinct("order_id").alias("order_count"), *[F.sum(c).cast("long").alias(c) for c in ("ordered_units", "fulfilled_units", "cancelled_units")])
    ends = [F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")] if span else []
    both = sold.unionByName(placed, allowMissingColumns=True).groupBy(*grain).agg(*ends, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])
    return with_rates(both)


def commercial_mart(tables: dict[str, DataFrame], grain: Sequence[str] | None = None) -> DataFrame:
    grain = list(grain or MART_GRAIN)
    if not {"date", "sales_type"} <= set(grain):
        raise ValueError("the mart's grain needs date and sales_type")
    return commercial_metrics(enrich_sales(tables, only=grain), enrich_orders(tables, only=grain), grain)


def with_period(df: DataFrame, period: str, date_column: str = "date", column: str = "period_start") -> DataFrame:
    """df with the first day of each row's period; a row without a date that can be read is an error, when the plan runs."""
    require(df.columns, [date_column], "the table")
    missing = F.raise_error(F.lit(f"{date_column}: a row has no date that can be read")).cast("date")
    return df.withColumn(column, F.when(F.col(date_column).isNull(), missing).otherwise(period_start(date_column, period)))


def with_completeness(df: DataFrame, period: str, first_last: DataFrame | None) -> DataFrame:
    """period_type, period_end, expected_days and is_complete; first_last is one row (first_date, last_date), or None if df spans its own dates (df is then read twice)."""
    if first_last is None:
        cells = df.withColumnsRenamed({"first_date": "_first", "last_date": "_last"})
        out = with_totals(cells, first_date=F.min("_first"), last_date=F.max("_last")).drop("_first", "_last")
    else:
        out = df.crossJoin(F.broadcast(first_last))
    out = out.withColumn("period_type", F.lit(period)).withColumn("period_end", period_end("period_start", period))
    out = out.withColumn("expected_days", (F.datediff("period_end", "period_start") + 1).cast("int"))
    return out.withColumn("is_complete", (F.col("period_start") >= F.col("first_date")) & (F.col("period_end") <= F.col("last_date"))).drop("first_date", "last_date")


def date_range(*frames: DataFrame) -> DataFrame:
    """First and last date over all frames: one row."""
    out = None
    for f in frames:
        one = f.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def period_calendar(first_last: DataFrame, period: str) -> DataFrame:
    """One row per period between two dates, with its end, days and completeness."""
    step = {"day": "interval 1 day", "week": "interval 7 day", "month": "interval 1 month"}[period]
    starts = first_last.select(F.explode(F.sequence(period_start("first_date", period), period_start("last_date", period), F.expr(step))).alias("period_start"))
    return with_completeness(starts, period, first_last)


def summarise_by_period(tables: dict[str, DataFrame], period: str, group_by: Sequence[str] = (), include_partial: bool = False) -> DataFrame:
    """Commercial metrics per period and group, written once, in no order (see in_order); partial periods are dropped unless asked for."""
    sales, orders = enrich_sales(tables, only=group_by), enrich_orders(tables, only=group_by)
    out = commercial_metrics(with_period(sales, period), with_period(orders, period), ["period_start", *group_by], span=True)
    out = with_completeness(settled(out), period, None)
    return out if include_partial else out.where("is_complete")


class Summaries:
    """Period summaries of any cut of some dimensions, from one pass over the lines.

    The lines are enriched and added up once, to one row per day, order and values of all dimensions, and written
    as columns. Every summary rolls up from there, when it is read: sums of exact decimals, and orders counted once
    in each cell. A summary that nobody reads costs nothing.
    """

    def __init__(self, tables: dict[str, DataFrame], dims: Sequence[str]) -> None:
        self.dims, keys = list(dims), ["date", *dims, "order_id"]
        sales, orders = enrich_sales(tables, only=dims), enrich_orders(tables, only=dims)
        exact = lambda c: F.sum(half_even(c, 2).cast("decimal(18,2)"))
        sold = sales.groupBy(*keys).agg(exact(F.col("units") * F.col("unit_price")).alias("gross_sales"), exact("net_sales").alias("net_sales"), F.sum("units").cast("long").alias("sales_units"), F.lit(1).alias("sold"))
        placed = orders.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("ordered_units", "fulfilled_units", "cancelled_units")], F.lit(1).alias("placed"))
        self.base = written(sold.unionByName(placed, allowMissingColumns=True), "summaries")
        self.span = date_range(self.base)

    def by(self, period: str, group_by: Sequence[str] = (), include_partial: bool = False) -> DataFrame:
        """What `summarise_by_period` gives."""
        if lost := [d for d in group_by if d not in self.dims]:
            raise ValueError(f"the summaries have no {lost}")
        grain, added = ["period_start", *group_by], ["gross_sales", "net_sales", "sales_units", "ordered_units", "fulfilled_units", "cancelled_units"]
        orders = with_period(self.base, period).groupBy(*grain, "order_id").agg(
            *[F.sum(c).alias(c) for c in added], *[F.max(F.when(F.col("order_id").isNotNull(), F.col(c))).alias(c) for c in ("sold", "placed")]
        )
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        cells = orders.groupBy(*grain).agg(
            *[zero(c).cast("double").alias(c) for c in added[:2]], zero("sales_units").alias("sales_units"),
            zero("sold").alias("sales_order_count"), zero("placed").alias("order_count"), *[zero(c).alias(c) for c in added[3:]],
        )
        out = with_completeness(with_rates(cells), period, self.span)
        return out if include_partial else out.where("is_complete")


def in_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows sorted by the grain, for readers: what computes on does without. Spark sorts ranges in parallel."""
    return df.orderBy(*keys)


def drop_partial(df: DataFrame) -> DataFrame:
    return df.where("is_complete")


def inventory_by_period(inventory: DataFrame, skus: DataFrame, period: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Levels are averaged, flows summed, the flag's mean is the stockout rate; partial periods stay."""
    need = [c for c in group_by if c not in inventory.columns]
    frame = left_enrich(inventory, skus, "sku_id", need) if need else inventory
    grouped = with_period(frame, period).groupBy("period_start", *group_by).agg(
        F.avg("opening_stock").alias("opening_stock"), F.avg("available_stock").alias("available_stock"), F.sum("received_units").cast("long").alias("received_units"),
        F.sum("ordered_units").cast("long").alias("ordered_units"), F.sum("fulfilled_units").cast("long").alias("fulfilled_units"), F.avg("stockout_flag").alias("stockout_rate"),
    )
    return grouped.withColumns({"opening_stock": half_even("opening_stock", 2), "available_stock": half_even("available_stock", 2), "stockout_rate": half_even("stockout_rate", 4)})


def returns_by_period(sales: DataFrame, returns: DataFrame, period: str, group_by: Sequence[str] = (), include_partial: bool = False) -> DataFrame:
    """Units sold and returned per period; both sides are kept. A returned unit that the summary fails to hold is an error."""
    keys = ["period_start", *group_by]
    dates = [F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    sold = with_period(sales, period).groupBy(*keys).agg(*dates, F.sum("units").cast("long").alias("sold_units"))
    back = with_period(returns, period).groupBy(*keys).agg(*dates, F.sum("returned_units").cast("long").alias("returned_units"))
    both = sold.unionByName(back, allowMissingColumns=True).groupBy(*keys).agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sold_units", "returned_units")])
    full = settled(both.withColumn("return_rate", ratio("returned_units", "sold_units", 4)))
    if lost := lost_returns(full, returns):
        raise ValueError(f"{lost:,.0f} returned units are not in the summary")
    out = with_completeness(full, period, None)
    return out if include_partial else out.where("is_complete")


def lost_returns(summary: DataFrame, returns: DataFrame) -> float:
    """Returned units that a full summary fails to hold (0 when it reconciles)."""
    a, b = summary.agg(F.sum("returned_units")).first()[0] or 0, returns.agg(F.sum("returned_units")).first()[0] or 0
    return abs(float(a) - float(b))
