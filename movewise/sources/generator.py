"""A sample star schema with planted facts, from hashes of row numbers (no random state, any size).

Planted: from a Monday on, BLR serves less of its Fruits and Vegetables; HYD orders fewer Premium
products; DEL's demand moves to Premium, which it always serves less well. MUM is a control, and so is a
week before anything starts. What was planted travels with a written dataset, in its manifest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import children

# Places, products, dates of the planted events.
REGIONS = [("BLR", "Bengaluru", "South"), ("HYD", "Hyderabad", "South"), ("DEL", "Delhi", "North"), ("MUM", "Mumbai", "West")]
CATEGORIES = ["Fruits", "Vegetables", "Dairy", "Grains"]
CHANNELS = ["Modern Trade", "General Trade", "Online", "Institutional"]
FIRST_DAY, DAYS = "2026-01-01", 60
SUPPLY_FROM, SOFT_FROM, MIX_FROM = "2026-02-23", "2026-02-04", "2026-01-26"
SCENARIOS = [
    {"name": "supply", "region_code": "BLR", "categories": ["Fruits", "Vegetables"], "metric": "fill_rate", "expected_pattern": "fulfilment_constraint", "starts": SUPPLY_FROM, "current_period": "2026-02-23", "comparison_period": "2026-02-16"},
    {"name": "softness", "region_code": "HYD", "categories": [], "metric": "net_sales", "expected_pattern": "demand_softness", "starts": SOFT_FROM, "current_period": "2026-02-09", "comparison_period": "2026-01-26"},
    {"name": "mix", "region_code": "DEL", "categories": [], "metric": "fill_rate", "expected_pattern": "portfolio_mix_shift", "starts": MIX_FROM, "current_period": "2026-01-26", "comparison_period": "2026-01-19"},
    {"name": "quiet region", "region_code": "MUM", "categories": [], "metric": "net_sales", "expected_pattern": None, "starts": None, "current_period": "2026-02-23", "comparison_period": "2026-02-16"},
    {"name": "quiet week", "region_code": "MUM", "categories": [], "metric": "fill_rate", "expected_pattern": None, "starts": None, "current_period": "2026-01-19", "comparison_period": "2026-01-12"},
]
MANIFEST = "manifest"


def _unit(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, str | int) else p for p in parts]), F.lit(1_000_003)) / 1_000_003.0


def _pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def generate(spark: SparkSession, orders_per_day: int = 80, seed: int = 42) -> dict[str, DataFrame]:
    skus = spark.range(28).select(
        F.format_string("S%02d", "id").alias("sku_id"), F.format_string("Item %d", F.floor(F.col("id") / 2)).alias("sku_name"), _pick(CATEGORIES, (F.floor(F.col("id") / 2) % 4) / 4.0).alias("category"),
        F.when(F.col("id") % 2 == 1, "Premium").otherwise("Standard").alias("sub_category"), F.lit(1.0).alias("pack_size_kg"), (F.lit(40.0) + F.col("id") * 3).alias("unit_cost"), (F.lit(60.0) + F.col("id") * 5).alias("list_price"), F.lit(1).alias("active_flag"),
    )
    place = lambda k: _pick([r[k] for r in REGIONS], (F.col("id") % 4) / 4.0)
    customers = spark.range(80).select(
        F.format_string("C%03d", "id").alias("customer_id"), F.format_string("Customer %d", "id").alias("customer_name"), F.lit("Retail Chain").alias("customer_type"), _pick(CHANNELS, (F.floor(F.col("id") / 4) % 4) / 4.0).alias("channel"),
        place(0).alias("region_code"), place(1).alias("city"), place(2).alias("zone"), F.format_string("K%d", F.col("id") % 4 + 1).alias("kam_id"),
    )
    slots = spark.range(DAYS * orders_per_day * 3).select(F.floor(F.col("id") / 3).alias("o"), (F.col("id") % 3).alias("line"))
    by_order = lambda name: _unit(name, seed, F.col("o"))
    base = slots.where((F.col("line") == 0) | ((F.col("line") == 1) & (by_order("size") > 0.62)) | ((F.col("line") == 2) & (by_order("size") > 0.88)))
    base = base.select("o", "line", F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(F.col("o") / orders_per_day).cast("int")).alias("date"), F.format_string("C%03d", F.floor(by_order("customer") * 80).cast("long")).alias("customer_id"), F.floor(_unit("sku", seed, F.col("o"), F.col("line")) * 28).alias("k"))
    lines = base.join(customers.select("customer_id", "channel", "region_code", "kam_id"), "customer_id")
    region, day = F.col("region_code"), F.col("date")
    draw = lambda name: _unit(name, seed, F.col("o"), F.col("line"))
    to_premium = (region == "DEL") & (day >= F.lit(MIX_FROM).cast("date")) & (F.col("k") % 2 == 0) & (draw("mix") < 0.6)
    lines = lines.withColumn("sku_id", F.format_string("S%02d", F.when(to_premium, F.col("k") + 1).otherwise(F.col("k")))).join(skus.select("sku_id", "category", "sub_category", "list_price"), "sku_id")
    soft = (region == "HYD") & (F.col("sub_category") == "Premium") & (day >= F.lit(SOFT_FROM).cast("date"))
    lines = lines.where(~(soft & (draw("soft") < 0.5)))
    short = (region == "BLR") & F.col("category").isin("Fruits", "Vegetables") & (day >= F.lit(SUPPLY_FROM).cast("date"))
    rate = F.when(short, 0.62 + 0.2 * draw("rate")).when((region == "DEL") & (F.col("sub_category") == "Premium"), 0.78 + 0.08 * draw("rate")).otherwise(0.94 + 0.06 * draw("rate"))
    lines = lines.withColumn("ordered_units", (5 + F.floor(draw("units") * 20)).cast("int")).withColumn("fulfilled_units", F.floor(F.col("ordered_units") * rate + draw("cut") * 0.999).cast("int"))
    lines = lines.withColumns({"order_id": F.format_string("O%07d", "o"), "sales_type": F.when(by_order("type") < 0.7, "PRIMARY").otherwise("SECONDARY"), "discount_pct": F.floor(draw("discount") * 4) * 0.05}).dropDuplicates(["order_id", "sku_id", "sales_type"])
    orders = lines.select("order_id", "date", "customer_id", "region_code", "channel", "sku_id", "ordered_units", "fulfilled_units", (F.col("ordered_units") - F.col("fulfilled_units")).alias("cancelled_units"), F.lit("Completed").alias("order_status"), "sales_type")
    value = F.rint(F.col("fulfilled_units") * F.col("list_price") * (1 - F.col("discount_pct")) * 100) / 100
    sales = lines.where("fulfilled_units > 0").select("order_id", "date", "customer_id", "region_code", "channel", "kam_id", "sku_id", "category", "sales_type", F.col("fulfilled_units").alias("units"), F.col("list_price").alias("unit_price"), "discount_pct", value.alias("net_sales"))
    dates = spark.range(DAYS).select(F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("date"))
    regions = spark.createDataFrame(REGIONS, "region_code string, city string, zone string")
    cells = dates.crossJoin(regions.select("region_code")).crossJoin(skus.select("sku_id", "category", "sub_category"))  # the sample's own grid: days x 4 x 28
    low = (F.col("region_code") == "BLR") & F.col("category").isin("Fruits", "Vegetables") & (F.col("date") >= F.lit(SUPPLY_FROM).cast("date"))
    stock = F.greatest(F.lit(0), F.floor(20 + 15 * _unit("stock", seed, F.col("date").cast("string"), F.col("region_code"), F.col("sku_id"))) - F.when(low, 22).otherwise(0)).cast("int")
    inventory = cells.withColumn("available_stock", stock).select("date", "sku_id", F.concat(F.lit("WH-"), "region_code").alias("warehouse"), "region_code", (F.col("available_stock") + 5).alias("opening_stock"), F.lit(10).alias("received_units"), "available_stock", F.lit(15).alias("ordered_units"), F.lit(15).alias("fulfilled_units"), (F.col("available_stock") <= 2).cast("int").alias("stockout_flag"))
    kinds = spark.createDataFrame([(c, h) for c in CATEGORIES for h in CHANNELS], "category string, channel string")
    targets = dates.crossJoin(regions.select("region_code")).crossJoin(kinds).select("date", "region_code", "category", "channel", F.lit(2500.0).alias("sales_target"), F.lit(2).alias("order_target"), F.lit(0.93).alias("fill_rate_target"))  # likewise
    managers = spark.range(1, 5).select(F.format_string("K%d", "id").alias("kam_id"), F.format_string("Manager %d", "id").alias("kam_name"))
    quotas = dates.crossJoin(managers.select("kam_id")).select("date", "kam_id", F.lit(40000.0).alias("sales_target"), F.lit(20).alias("order_target"))
    days = dates.select("date", F.weekofyear("date").alias("week"), F.month("date").alias("month"), F.concat(F.lit("Q"), F.quarter("date")).alias("quarter"), F.year("date").alias("year"))
    return {"dim_date": days, "dim_kam": managers, "dim_region": regions, "dim_sku": skus, "dim_customer": customers, "fact_sales": sales, "fact_orders": orders, "fact_inventory": inventory, "fact_targets": targets, "fact_kam_targets": quotas}


def with_defects(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two repeated sales rows, a null discount, a null price, an impossible order, a null channel."""
    first = lambda df: F.row_number().over(Window.orderBy("order_id", "sku_id", "sales_type"))
    sales = t["fact_sales"].withColumn("_n", first(t["fact_sales"]))
    sales = sales.withColumns({"discount_pct": F.when(F.col("_n") != 3, F.col("discount_pct")), "unit_price": F.when(F.col("_n") != 4, F.col("unit_price"))})
    sales = sales.unionByName(sales.where("_n IN (10, 11)")).drop("_n")
    orders = t["fact_orders"].withColumn("_n", first(t["fact_orders"]))
    orders = orders.withColumns({"fulfilled_units": F.when(F.col("_n") == 5, F.col("ordered_units") + 3).otherwise(F.col("fulfilled_units")), "channel": F.when(F.col("_n") != 6, F.col("channel"))}).drop("_n")
    return t | {"fact_sales": sales, "fact_orders": orders}


def write_dataset(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """<table>.csv folders, and the manifest with the planted scenarios."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
    manifest = {"first_day": FIRST_DAY, "days": DAYS, "tables": sorted(tables), "scenarios": SCENARIOS}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{MANIFEST}")


def load_scenarios(spark: SparkSession, folder: str) -> list[dict]:
    """The planted scenarios of a written dataset; there must be some."""
    if MANIFEST not in children(spark, folder):
        raise ValueError(f"{folder} has no manifest")
    found = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/{MANIFEST}").collect())).get("scenarios")
    if not found:
        raise ValueError(f"the manifest of {folder} has no scenarios")
    return found
