"""A warehouse in the catalog: all tables of a load appear at once, or none does.

Write, audit, publish. A load writes every table into a database of its own, checks them there, and
computes their statistics. Readers take the version that one small file names; writing that file is the
only step that they can see, and it replaces the old one in a single rename. A load that fails before it
leaves the old version as it is and takes its own tables away. Old versions stay for readers that have
them open until `vacuum`.

Facts can be stored in buckets, so that what groups or joins by the bucket's column does so without a
shuffle; see `publish`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import KEYS, TABLES, conformed
from .store import foreign_key_violations, safe_name

POINTER = "CURRENT"


@dataclass
class Published:
    """One version: its tables stay what they are, whatever is published later."""

    spark: SparkSession
    database: str

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{safe_name(name)}")

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in TABLES}

    def statistics(self) -> DataFrame:
        """(table, rows, bytes) as ANALYZE TABLE left them in the catalog."""
        rows = []
        for t in TABLES:
            said = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.database}.{t}").where("col_name = 'Statistics'").first()
            size, _, count = (said["data_type"] if said else "").partition(" bytes")
            rows.append((t, int(count.strip(", ").removesuffix(" rows")) if "rows" in count else None, int(size) if size else None))
        return self.spark.createDataFrame(rows, "table string, rows long, bytes long")


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, name: str = "movewise") -> None:
        self.spark, self.root, self.name = spark, root.rstrip("/"), safe_name(name)

    # The pointer.

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The database that readers see."""
        path, fs = self._fs(f"{self.root}/{POINTER}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def _point_to(self, database: str) -> None:
        draft, fs = self._fs(f"{self.root}/.{POINTER}-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(database.encode()))
        stream.close()
        context = self.spark.sparkContext
        rename = context._jvm.org.apache.hadoop.fs.Options.Rename
        how = context._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        final, _ = self._fs(f"{self.root}/{POINTER}")
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(draft, final, how)

    # Writing.

    def publish(self, tables: dict[str, DataFrame], buckets: int = 0, bucket_by: dict[str, str] | None = None, check: bool = True) -> Published:
        """All tables of the model as a new version.

        buckets: facts are stored in so many buckets, of the column that bucket_by names for them (`date` where it
        names none), sorted by it within each: an aggregate by date and more then needs no shuffle of lines.
        check: keys of dimensions and foreign keys are audited on what was written; a broken one stops the load.
        """
        if missing := [t for t in TABLES if t not in tables]:
            raise ValueError(f"the warehouse lacks {missing}")
        stamp = datetime.now(UTC).strftime("%Y%m%d%H%M%S%f")
        database = f"{self.name}_{stamp}_{uuid.uuid4().hex[:6]}"
        self.spark.sql(f"CREATE DATABASE {database} LOCATION '{self.root}/{database}'")
        try:
            for name in TABLES:
                self._write(conformed(tables[name], name), f"{database}.{name}", name, buckets, bucket_by or {})
            made = Published(self.spark, database)
            if check:
                self._audit(made)
            for name in TABLES:
                self.spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS FOR COLUMNS {', '.join(KEYS[name])}")
            self._views(database)
            self._point_to(database)
        except BaseException:
            self._drop(database)
            raise
        return made

    def _write(self, df: DataFrame, full_name: str, name: str, buckets: int, bucket_by: dict[str, str]) -> None:
        if not (buckets and name.startswith("fact_")):
            df.write.format("parquet").saveAsTable(full_name)
            return
        by = bucket_by.get(name, "date")
        df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by).saveAsTable(full_name)

    def _audit(self, made: Published) -> None:
        tables, broken = made.tables(), []
        for name in [t for t in TABLES if t.startswith("dim_")]:
            if not tables[name].groupBy(*KEYS[name]).count().where("count > 1").isEmpty():
                broken.append(f"{name}: {KEYS[name]} repeats")
        broken += [f"{r['table']}.{r['column']}: {r['rows']} orphans" for r in foreign_key_violations(tables).where(F.col("rows") > 0).collect()]
        if broken:
            raise ValueError("; ".join(broken))

    def _views(self, database: str) -> None:
        """The staging views and the mart, over the tables of this version."""
        from ..plans.sql import VIEWS, qualified, text_of

        for name in VIEWS:
            self.spark.sql(f"CREATE VIEW {database}.{name} AS {qualified(text_of(name), database)}")

    def _drop(self, database: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
        path, fs = self._fs(f"{self.root}/{database}")
        fs.delete(path, True)

    # Reading.

    def open(self) -> Published:
        """The version that is current now."""
        if (database := self.current()) is None:
            raise ValueError(f"nothing has been published in {self.root}")
        return Published(self.spark, database)

    def versions(self) -> list[str]:
        """Databases of this warehouse, oldest first."""
        head = f"{self.name}_2"
        return sorted(d.name for d in self.spark.catalog.listDatabases() if d.name.startswith(head) and (d.locationUri or "").rstrip("/").endswith(f"{self.root.split(':', 1)[-1].lstrip('/')}/{d.name}"))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drops old versions but the `keep` newest besides the current one."""
        now = self.current()
        old = [d for d in self.versions() if d != now]
        gone = old[: max(0, len(old) - keep)]
        for database in gone:
            self._drop(database)
        return gone
