"""The star schema, declared once: types, keys, contracts, foreign keys, metric classes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Table columns and types, keys and value rules of the model.
TABLES: dict[str, str] = {
    "dim_date": "date date, week int, month int, quarter string, year int",
    "dim_kam": "kam_id string, kam_name string",
    "dim_region": "region_code string, city string, zone string",
    "dim_sku": "sku_id string, sku_name string, category string, sub_category string, pack_size_kg double, unit_cost double, list_price double, active_flag int",
    "dim_customer": "customer_id string, customer_name string, customer_type string, channel string, region_code string, city string, zone string, kam_id string",
    "fact_sales": "order_id string, date date, customer_id string, region_code string, channel string, kam_id string, sku_id string, category string, sales_type string, units int, unit_price double, discount_pct double, net_sales double",
    "fact_orders": "order_id string, date date, customer_id string, region_code string, channel string, sku_id string, ordered_units int, fulfilled_units int, cancelled_units int, order_status string, sales_type string",
    "fact_inventory": "date date, sku_id string, warehouse string, region_code string, opening_stock int, received_units int, available_stock int, ordered_units int, fulfilled_units int, stockout_flag int",
    "fact_targets": "date date, region_code string, category string, channel string, sales_target double, order_target int, fill_rate_target double",
    "fact_kam_targets": "date date, kam_id string, sales_target double, order_target int",
}
KEYS: dict[str, list[str]] = {
    "dim_date": ["date"], "dim_kam": ["kam_id"], "dim_region": ["region_code"], "dim_sku": ["sku_id"], "dim_customer": ["customer_id"],
    "fact_sales": ["order_id", "sku_id", "sales_type"], "fact_orders": ["order_id", "sku_id", "sales_type"],
    "fact_inventory": ["date", "sku_id", "warehouse"], "fact_targets": ["date", "region_code", "category", "channel"], "fact_kam_targets": ["date", "kam_id"],
}
NON_NEGATIVE: dict[str, list[str]] = {
    "dim_sku": ["pack_size_kg", "unit_cost", "list_price"], "fact_sales": ["units", "unit_price", "net_sales"],
    "fact_orders": ["ordered_units", "fulfilled_units", "cancelled_units"],
    "fact_inventory": ["opening_stock", "received_units", "available_stock", "ordered_units", "fulfilled_units"],
    "fact_targets": ["sales_target", "order_target"], "fact_kam_targets": ["sales_target", "order_target"],
}
BOUNDS: dict[str, dict[str, tuple[float, float]]] = {"fact_sales": {"discount_pct": (0, 1)}, "fact_inventory": {"stockout_flag": (0, 1)}, "fact_targets": {"fill_rate_target": (0, 1)}}
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("dim_customer", "region_code", "dim_region"), ("dim_customer", "kam_id", "dim_kam"),
    ("fact_sales", "customer_id", "dim_customer"), ("fact_sales", "region_code", "dim_region"), ("fact_sales", "kam_id", "dim_kam"), ("fact_sales", "sku_id", "dim_sku"),
    ("fact_orders", "customer_id", "dim_customer"), ("fact_orders", "region_code", "dim_region"), ("fact_orders", "sku_id", "dim_sku"),
    ("fact_inventory", "sku_id", "dim_sku"), ("fact_inventory", "region_code", "dim_region"),
    ("fact_targets", "region_code", "dim_region"), ("fact_kam_targets", "kam_id", "dim_kam"),
]
DATED = ["fact_sales", "fact_orders", "fact_inventory", "fact_targets", "fact_kam_targets"]
ADDITIVE = ("net_sales", "gross_sales", "sales_units", "ordered_units", "fulfilled_units", "cancelled_units", "order_count", "sales_order_count", "discount_value")
RATES = {"fill_rate": ("fulfilled_units", "ordered_units"), "cancellation_rate": ("cancelled_units", "ordered_units"), "aov": ("net_sales", "sales_order_count"), "return_rate": ("returned_units", "sold_units")}
TARGET_RULES = {"sales_target": "sum", "order_target": "sum", "fill_rate_target": "mean"}
MART_GRAIN = ["date", "region_code", "category", "channel", "sales_type"]


@dataclass
class Contract:
    """What a table must hold; the validator takes a dict of these."""

    columns: list[str]
    key: list[str]
    numeric: list[str] = field(default_factory=list)
    non_negative: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)


def _fields(name: str) -> dict[str, str]:
    return dict(part.split() for part in TABLES[name].split(", "))


CONTRACTS = {name: Contract(list(_fields(name)), KEYS[name], [c for c, t in _fields(name).items() if t in ("int", "double") and not name.startswith("dim_date")], NON_NEGATIVE.get(name, []), BOUNDS.get(name, {})) for name in TABLES}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A typed table without rows."""
    return spark.createDataFrame([], struct(name))


def struct(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The declared columns in order, cast to their types."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in struct(name).fields])
