"""Cleaning with an audit trail and quarantine; nothing disappears without a row in one of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even
from ..sources.schema import KEYS, TABLES
from ..sources.store import load_dataset
from .validate import gate, validate


@dataclass
class Cleaned:
    """tables and quarantined stay lazy; audit is (table, action, rows, detail)."""

    tables: dict[str, DataFrame]
    audit: DataFrame
    quarantined: dict[str, DataFrame]


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def keep_first(df: DataFrame, key: Sequence[str], order: str = "_row") -> DataFrame:
    """The first row of each key in file order (an order column), not an arbitrary one."""
    if order not in df.columns:
        rest = [c for c in df.columns if c not in key]
        by = Window.partitionBy(*key).orderBy(*rest) if rest else Window.partitionBy(*key).orderBy(*key)
    else:
        by = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _looked_up(df: DataFrame, dim: DataFrame, key: str, source: str) -> DataFrame:
    """df with _v: the dimension's value for its key, the least where the key repeats."""
    return df.join(dim.groupBy(key).agg(F.min(source).alias("_v")), key, "left")


def impute(df: DataFrame, column: str, dim: DataFrame, key: str, source: str) -> DataFrame:
    """Null values from a dimension's column."""
    return _looked_up(df, dim, key, source).withColumn(column, F.coalesce(column, "_v")).drop("_v")


def _once(df: DataFrame) -> DataFrame:
    """Distinct rows with _copies; of rows in file order (_row) the first."""
    columns = [c for c in df.columns if c != "_row"]
    first = [F.min("_row").alias("_row")] if "_row" in df.columns else []
    return df.groupBy(*columns).agg(*first, F.count("*").alias("_copies"))


def _counted(name: str, df: DataFrame, actions: dict[str, tuple[Column, str]]) -> DataFrame:
    """(table, action, rows, detail) of a table in one aggregate: the sum of each action's number of rows."""
    sums = df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"c{i}") for i, (c, _) in enumerate(actions.values())])
    rows = [F.struct(F.lit(name).alias("table"), F.lit(a).alias("action"), F.col(f"c{i}").alias("rows"), F.lit(d).alias("detail")) for i, (a, (_, d)) in enumerate(actions.items())]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


REPEATED = ("drop_exact_duplicates", "whole rows")


def clean(spark: SparkSession, tables: dict[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Cleaned:
    """Each table is read once for its audit: repeats, repairs and held rows are sums over one frame with flags.

    keep(frame, name) stands for a frame that a table, its audit and its held rows are made of: `written`, where all of them are wanted.
    """
    if missing := [t for t in TABLES if t not in tables]:
        raise ValueError(f"cleaning needs all tables; missing: {missing}")
    out, held, audit = dict(tables), {}, []
    for name in [t for t in TABLES if t.startswith("dim_")]:
        once = keep(_once(tables[name]), name)
        audit.append(_counted(name, once, {REPEATED[0]: (F.col("_copies") - 1, REPEATED[1])}))
        out[name] = once.select(*tables[name].columns)
    null = lambda c: F.col(c).isNull()
    dated = F.col("date").try_cast("date")

    sales = _looked_up(_once(tables["fact_sales"]), out["dim_sku"], "sku_id", "list_price")
    price = F.coalesce("unit_price", "_v")
    sales = keep(sales.withColumns({"_no_discount": null("discount_pct"), "_no_price": null("unit_price"), "_unsellable": _no((price <= 0) | (F.col("units") <= 0))}), "fact_sales")
    audit.append(_counted("fact_sales", sales, {
        REPEATED[0]: (F.col("_copies") - 1, REPEATED[1]), "impute_discount_pct": (F.col("_no_discount"), "null becomes 0"),
        "impute_unit_price": (F.col("_no_price") & F.col("_v").isNotNull(), "from dim_sku.list_price"), "unresolved_unit_price": (F.col("_no_price") & null("_v"), "no list price"),
        "quarantine_unsellable_lines": (F.col("_unsellable"), "price or units not positive"),
    }))
    mended = sales.withColumns({"discount_pct": F.coalesce("discount_pct", F.lit(0.0)), "unit_price": price})
    held["fact_sales"] = mended.where("_unsellable").select(*tables["fact_sales"].columns)
    value = half_even(F.col("units") * F.col("unit_price") * (1 - F.col("discount_pct")), 2)
    out["fact_sales"] = mended.where(~F.col("_unsellable")).withColumns({"net_sales": value, "date": dated}).select(*tables["fact_sales"].columns)

    orders = _looked_up(tables["fact_orders"], out["dim_customer"], "customer_id", "channel")
    orders = keep(orders.withColumns({"_no_channel": null("channel"), "_impossible": _no(F.col("fulfilled_units") > F.col("ordered_units"))}), "fact_orders")
    audit.append(_counted("fact_orders", orders, {
        "impute_channel": (F.col("_no_channel") & F.col("_v").isNotNull(), "from dim_customer.channel"), "unresolved_channel": (F.col("_no_channel") & null("_v"), "unknown customer"),
        "quarantine_invalid_quantities": (F.col("_impossible"), "fulfilled above ordered"),
    }))
    mended = orders.withColumn("channel", F.coalesce("channel", "_v"))
    held["fact_orders"] = mended.where("_impossible").select(*tables["fact_orders"].columns)
    out["fact_orders"] = mended.where(~F.col("_impossible")).withColumn("date", dated).select(*tables["fact_orders"].columns)

    for name in ("fact_inventory", "fact_targets", "fact_kam_targets"):
        by_key = tables[name].groupBy(*KEYS[name]).agg(F.count("*").alias("_copies"))
        audit.append(_counted(name, by_key, {"drop_duplicate_key": (F.col("_copies") - 1, "first row kept")}))
        out[name] = keep(keep_first(tables[name], KEYS[name]).withColumn("date", dated), name)
    return Cleaned(out, reduce(DataFrame.unionByName, audit).where("rows > 0"), held)


def clean_or_raise(spark: SparkSession, tables: dict[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Cleaned:
    """Clean, validate, and refuse data that still breaks a contract."""
    result = clean(spark, tables, keep)
    gate(validate(spark, result.tables))
    return result


def load_business_data(spark: SparkSession, folder: str) -> tuple[Cleaned, DataFrame]:
    """From a folder of raw tables to gated ones: what cleaning made of them, and (table, rows) as they were read."""
    raw = load_dataset(spark, folder, typed=True, ordered=True)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in raw.items()]
    done = clean_or_raise(spark, raw)
    plain = lambda frames: {name: df.drop("_row") for name, df in frames.items()}
    return Cleaned(plain(done.tables), done.audit, plain(done.quarantined)), reduce(DataFrame.unionByName, counts)


def write_cleaned(result: Cleaned, folder: str, fmt: str = "parquet") -> None:
    """clean/<table>, cleaning_audit, quarantine/<table> (only where rows were held)."""
    save = lambda df, path: df.write.mode("overwrite").option("header", True).format(fmt).save(f"{folder}/{path}")
    for name, df in result.tables.items():
        save(df, f"clean/{name}")
    save(result.audit, "cleaning_audit")
    for name, df in result.quarantined.items():
        if not df.isEmpty():
            save(df, f"quarantine/{name}")
