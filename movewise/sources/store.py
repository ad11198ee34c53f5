"""Readers and writers: folders of CSV or Parquet, JDBC and catalog tables, lake zones."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jdbc import load_jdbc, replace_tables, safe_name
from .quoted_csv import read_quoted_csv
from .schema import DATED, FOREIGN_KEYS, TABLES, conformed, empty
from .workbook import read_sheet

ZONES = ("raw", "curated", "clean", "jobs")

def load_table(spark: SparkSession, path: str, fmt: str | None = None, ordered: bool = False) -> DataFrame:
    """CSV (as text), Parquet, or a sheet of a workbook (the first). ordered: with _row, which sorts as the rows stand in the source."""
    kind = fmt or path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return read_quoted_csv(spark, path).drop(*(["_line"] if ordered else ["_line", "_row"]))
    if kind == "parquet":
        df = spark.read.parquet(path)
        return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_row")) if ordered else df
    if kind in ("xlsx", "excel"):
        return read_sheet(spark, path, ordered=ordered)
    raise ValueError(f"unknown file type {kind!r}")


def children(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def load_dataset(spark: SparkSession, folder: str, typed: bool = False, ordered: bool = False) -> dict[str, DataFrame]:
    """Every <table>.csv, <table>.parquet or <table>.xlsx of a folder, on any file system that Spark reads; see load_table."""
    found = {n.rpartition(".")[0]: n for n in children(spark, folder) if n.endswith((".csv", ".parquet", ".xlsx"))}
    if not found:
        raise FileNotFoundError(f"no tables in {folder}")
    out = {t: load_table(spark, f"{folder}/{n}", ordered=ordered) for t, n in found.items()}
    return {t: typed_table(df, t) if typed and t in TABLES else df for t, df in out.items()}


def coerce_dates(df: DataFrame, columns: tuple[str, ...] = ("date",)) -> DataFrame:
    """Unreadable dates become null."""
    return df.withColumns({c: F.col(c).try_cast("date") for c in columns if c in df.columns})


def typed_table(df: DataFrame, name: str) -> DataFrame:
    """Declared types by try_cast; what cannot be read is null and the validator's to count."""
    fields = dict(x.split() for x in TABLES[name].split(", "))
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in fields.items() if c in df.columns})


def load_csv_directory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: coerce_dates(df) if t in DATED or t == "dim_date" else df for t, df in load_dataset(spark, folder).items()}


def available_tables(spark: SparkSession) -> list[str]:
    """Names of the catalog's tables and of temp views, sorted."""
    return sorted({t.name for t in spark.catalog.listTables()})


def load_catalog(spark: SparkSession, tables: list[str] | None = None) -> dict[str, DataFrame]:
    names = [safe_name(t) for t in tables or TABLES]
    have = available_tables(spark)
    if missing := [t for t in names if t not in have]:
        raise ValueError(f"the catalog lacks {missing}")
    return {t: spark.table(t) for t in names}


def foreign_key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, rows of each broken relation; Spark does not enforce keys."""
    from functools import reduce

    out = []
    for child, key, parent in FOREIGN_KEYS:
        if child in tables and parent in tables:
            lost = tables[child].select(key).join(tables[parent].select(key).distinct(), key, "left_anti").agg(F.count("*").alias("rows"))
            out.append(lost.select(F.lit(child).alias("table"), F.lit(key).alias("column"), "rows"))
    return reduce(DataFrame.unionByName, out)


def build_database(spark: SparkSession, tables: dict[str, DataFrame], views: bool = True, check: bool = True, suffix: str = "") -> None:
    """Temp views of the tables, after a key check, with the staging views and the mart on top. A suffix keeps datasets of one session apart."""
    if check and (broken := foreign_key_violations(tables).where("rows > 0").collect()):
        raise ValueError("; ".join(f"{r['table']}.{r['column']}: {r['rows']} orphans" for r in broken))
    for name, df in tables.items():
        df.createOrReplaceTempView(safe_name(name + suffix))
    if views:
        from ..plans.sql import apply_views

        apply_views(spark, suffix)


def build_warehouse(tables: dict[str, DataFrame], url: str, **properties: str) -> None:
    """All tables of the model through JDBC, parents before children; the old ones are replaced in one transaction. A catalog's warehouse is in `warehouse`."""
    if missing := [t for t in TABLES if t not in tables]:
        raise ValueError(f"the warehouse lacks {missing}")
    replace_tables({name: conformed(tables[name], name) for name in TABLES}, url, **properties)


#: What a file of a curated table takes, as rows are shuffled (Parquet is some three times smaller).
FILE_BYTES = 256 << 20


def write_sized(df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Parquet in files of about one size, whatever the partitions of df: small ones are put together, large ones split, by their measured size.

    A table below the size is one file; a larger one has a file for each file_bytes, none of them much smaller than a fifth of it.
    """
    spark = df.sparkSession
    want = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(file_bytes), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(max(1, file_bytes // 5))}
    old = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        df.hint("rebalance").write.mode("overwrite").parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write_report_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(safe_name(name))


@dataclass
class Lake:
    """Zones under one root URI; every path ends at a table's own folder."""

    spark: SparkSession
    root: str

    def uri(self, zone: str, table: str) -> str:
        if zone not in ZONES:
            raise ValueError(f"zone must be one of {ZONES}")
        return f"{self.root.rstrip('/')}/{zone}/{safe_name(table)}"

    def exists(self, zone: str, table: str) -> bool:
        return bool(children(self.spark, self.uri(zone, table)))

    def read(self, zone: str, table: str) -> DataFrame:
        return coerce_dates(self.spark.read.parquet(self.uri(zone, table)))

    def write(self, df: DataFrame, zone: str, table: str, typed: bool = False, file_bytes: int = FILE_BYTES) -> None:
        write_sized(conformed(df, table) if typed else df, self.uri(zone, table), file_bytes)

    def land(self, df: DataFrame, table: str) -> None:
        """Raw values unchanged, as CSV; empty means null."""
        df.write.mode("overwrite").csv(self.uri("raw", table), header=True)

    def write_summary(self, summary: dict) -> None:
        self.spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.mode("overwrite").text(self.uri("curated", "_summary"))

    def read_summary(self) -> dict:
        return json.loads("".join(r["value"] for r in self.spark.read.text(self.uri("curated", "_summary")).collect()))

    def read_curated(self, zone: str = "curated") -> dict[str, DataFrame]:
        """Tables that exist, and typed empty ones for the rest."""
        return {t: self.read(zone, t) if self.exists(zone, t) else empty(self.spark, t) for t in TABLES}

    def read_run(self, zone: str = "curated") -> tuple[dict[str, DataFrame], DataFrame | None, dict]:
        """Tables, returned lines where there are any, and the summary of the run that wrote them."""
        returns = self.read(zone, "returns") if self.exists(zone, "returns") else None
        return self.read_curated(zone), returns, self.read_summary() if self.exists("curated", "_summary") else {}
