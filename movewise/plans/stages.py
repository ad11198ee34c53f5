"""Stages of a load: raw tables cleaned, gated and published as a warehouse version; then the analyses as report tables in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import written
from ..operators import clean, validate
from ..sources.store import Lake
from ..sources.warehouse import Published, Warehouse
from . import reports


@dataclass
class Loaded:
    """What a load did: the version, (table, rows) loaded and held back, the errors that the raw tables had, and the audit."""

    version: Published
    tables: DataFrame
    errors_before: int
    audit: DataFrame


def load(spark: SparkSession, raw: dict[str, DataFrame], house: Warehouse, lake: Lake | None = None, buckets: int = 0) -> Loaded:
    """Refuses, before the warehouse is touched, what still breaks a contract after cleaning. With a lake the clean zone is written too.

    What cleaning made of each table is written once: the gate, the warehouse, the audit and the held rows are read from it.
    """
    before = validate.errors(validate.validate(spark, raw)).count()
    done = clean.clean_or_raise(spark, raw, written)
    version = house.publish(done.tables, buckets)
    stored = version.tables()
    if lake is not None:
        for name, df in stored.items():
            lake.write(df, "clean", name, typed=True)
    rows = [(name, df.count(), done.quarantined[name].count() if name in done.quarantined else 0) for name, df in stored.items()]
    return Loaded(version, spark.createDataFrame(rows, "table string, loaded long, quarantined long"), before, done.audit)


def publish(version: Published, returns: DataFrame) -> DataFrame:
    """(table, rows) of the report tables, written into the version's database."""
    spark, rows = version.spark, []
    for name, df in reports.analysis_tables(version.tables(), returns).items():
        full = f"{version.database}.{name}"
        reports.flatten(df).write.mode("overwrite").format("parquet").saveAsTable(full)
        rows.append((name, spark.table(full).agg(F.count("*")).first()[0]))
    return spark.createDataFrame(rows, "table string, rows long")
