"""Contract checks: two aggregates per table, foreign keys among them; issues are rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType

from ..functions.exprs import half_even
from ..sources.schema import CONTRACTS, DATED, FOREIGN_KEYS, Contract

SCHEMA = "table string, check string, severity string, rows long"
STOCKOUT_LEVEL, NET_TOLERANCE = 2, 0.02


class DatasetContractError(ValueError):
    """Raised by the gate, with every error in its message."""


def _counts(name: str, df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """All conditional counts of a table in one pass."""
    if not checks:
        return df.sparkSession.createDataFrame([], SCHEMA)
    sums = df.agg(*[F.sum(F.coalesce(cond, F.lit(False)).cast("long")).alias(f"c{i}") for i, (_, cond) in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(check).alias("check"), F.lit(sev).alias("severity"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("rows")) for i, (check, (sev, _)) in enumerate(checks.items())])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def _table_checks(name: str, df: DataFrame, contract: Contract) -> dict[str, tuple[str, Column]]:
    number = lambda c: F.col(c).try_cast("double")
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in contract.columns])
    out = {"required_values": ("ERROR", any_null)}
    for c in contract.numeric:
        out[f"numeric_{c}"] = ("ERROR", number(c).isNull())
    for c in contract.non_negative:
        out[f"non_negative_{c}"] = ("ERROR", number(c) < 0)
    for c, (low, high) in contract.bounds.items():
        out[f"bounds_{c}"] = ("ERROR", (number(c) < low) | (number(c) > high))
    if name == "fact_orders":
        out["fulfilled_not_greater_than_ordered"] = ("ERROR", number("fulfilled_units") > number("ordered_units"))
        out["order_quantity_reconciliation"] = ("ERROR", number("fulfilled_units") + number("cancelled_units") != number("ordered_units"))
    if name == "fact_sales":
        value = half_even(number("units") * number("unit_price") * (1 - number("discount_pct")), 2)
        out["sales_value_reconciliation"] = ("ERROR", F.abs(value - number("net_sales")) > NET_TOLERANCE)
    if name == "fact_inventory":
        out["stockout_flag_consistency"] = ("WARNING", (number("stockout_flag") == 1) & (number("available_stock") > STOCKOUT_LEVEL))
    return out


#: Conditions that fit a row's mask.
MASK = 62
#: Parents' keys up to which they are sent to every task. More are merged with the rows that refer to them: files tell too little of a table's size in memory for Spark to choose.
MANY_KEYS = 100_000


def _masked(df: DataFrame, checks: dict[str, tuple[str, Column]], keys: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[str, Column]]]:
    """The keys of each row and which conditions it meets, as bits of a few numbers: what joins move is narrow. And the conditions over these bits."""
    bits: dict[str, list[Column]] = {}
    found = {}
    for i, (check, (severity, cond)) in enumerate(checks.items()):
        word, bit = f"_m{i // MASK}", 1 << i % MASK
        bits.setdefault(word, []).append(F.when(F.coalesce(cond, F.lit(False)), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        found[check] = (severity, F.col(word).bitwiseAND(F.lit(bit).cast("long")) != 0)
    return df.select(*keys, *[reduce(Column.bitwiseOR, b).alias(word) for word, b in bits.items()]), found


def _comparable(child: DataFrame, parent: DataFrame, key: str) -> Callable[[Column], Column]:
    """Keys of one exact type are compared as they are, others as text."""
    kinds = {child.schema[key].dataType, parent.schema[key].dataType}
    return (lambda c: c) if len(kinds) == 1 and isinstance(next(iter(kinds)), (IntegralType, StringType, DateType)) else lambda c: c.cast("string")


def _relations(name: str, tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """A table's keys and the tables at hand that they refer to."""
    relations = [(k, p) for c, k, p in FOREIGN_KEYS if c == name] + ([("date", "dim_date")] if name in DATED else [])
    return [(k, p) for k, p in relations if p in tables and k in tables[name].columns and k in tables[p].columns]


def _large(tables: dict[str, DataFrame]) -> set[str]:
    """The parents of more than MANY_KEYS rows, counted in one job."""
    parents = sorted({p for name in tables for _, p in _relations(name, tables)})
    counts = [tables[p].agg(F.count("*").alias("rows")).select(F.lit(p).alias("table"), "rows") for p in parents]
    return {r["table"] for r in reduce(DataFrame.unionByName, counts).collect() if r["rows"] > MANY_KEYS} if counts else set()


def _with_parents(name: str, tables: dict[str, DataFrame], own: dict[str, tuple[str, Column]], large: Collection[str] = ()) -> tuple[DataFrame, dict[str, tuple[str, Column]]]:
    """A table's keys looked up in their parents, with a bit for each that finds none, and the checks of these bits beside the table's own ones.

    A null key is an orphan; a null date is another check's matter. Parents' keys are distinct, so no row is multiplied.
    Large parents come last and are merged: the driver never holds their keys, and rows then move without the keys that are looked up already.
    """
    df = tables[name]
    relations = sorted(_relations(name, tables), key=lambda r: r[1] in large)
    out, checks = _masked(df, own, [k for k, _ in relations])
    masks = [c for c in out.columns if c not in {k for k, _ in relations}]
    out = out.withColumn("_f", F.lit(0).cast("long"))
    for i, (key, parent) in enumerate(relations):
        same = _comparable(df, tables[parent], key)
        have = tables[parent].select(same(F.col(key)).alias(f"_k{i}")).distinct().withColumn(f"_p{i}", F.lit(True))
        have = have.hint("merge") if parent in large else F.broadcast(have)
        lost, bit = F.col(f"_p{i}").isNull(), F.lit(1 << i).cast("long")
        lost = lost & F.col(key).isNotNull() if key == "date" else lost
        rest = [k for k, _ in relations[i + 1 :]]
        out = out.join(have, same(F.col(key)) == F.col(f"_k{i}"), "left").select(*rest, *masks, F.when(lost, F.col("_f").bitwiseOR(bit)).otherwise(F.col("_f")).alias("_f"))
        checks[f"fk_{key}"] = ("ERROR", F.col("_f").bitwiseAND(bit) != 0)
    return out, checks


def validate(spark: SparkSession, tables: dict[str, DataFrame], contracts: dict[str, Contract] | None = None) -> DataFrame:
    """Issues (table, check, severity, rows) with rows > 0; a table without its columns is not checked further.

    Two passes over a table: one for all its conditions and foreign keys, one for its key. They run when this is called,
    pass by pass, and give a row for each check: one plan of all tables is more than a driver should plan again at each of its stages.
    """
    contracts = contracts or CONTRACTS
    found = [(n, "table_present", "ERROR", 1) for n in contracts if n not in tables]
    lacking = {n: [c for c in k.columns if c not in tables[n].columns] for n, k in contracts.items() if n in tables}
    found += [(n, "required_columns", "ERROR", len(c)) for n, c in lacking.items() if c]
    sound = {n: tables[n] for n, c in lacking.items() if not c}
    large = _large(sound)
    for name, df in sound.items():
        found += map(tuple, _counts(name, *_with_parents(name, sound, _table_checks(name, df, contracts[name]), large)).where("rows > 0").collect())
        repeated = df.groupBy(*contracts[name].key).count().where("count > 1").agg(F.sum("count").alias("rows")).first()["rows"]
        found += [(name, "duplicate_key", "ERROR", repeated)] if repeated else []
    return spark.createDataFrame(found, SCHEMA).orderBy("table", "check")


def errors(issues: DataFrame) -> DataFrame:
    return issues.where("severity = 'ERROR'")


def warnings(issues: DataFrame) -> DataFrame:
    return issues.where("severity = 'WARNING'")


def passed(issues: DataFrame) -> bool:
    return errors(issues).isEmpty()


def gate(issues: DataFrame) -> None:
    """Raises on any error; warnings never block. There are a few issues at most, one per check."""
    if found := errors(issues).orderBy("table", "check").collect():
        raise DatasetContractError("; ".join(f"{r['table']}.{r['check']}: {r['rows']} rows" for r in found))
