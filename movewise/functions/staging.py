"""Results that several steps use: written once, so that they are not computed again and again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a local master takes a temporary folder; a cluster is refused."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/movewise-shared"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, removed when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _until_the_end(spark, path)
    return path


def _until_the_end(spark: SparkSession, path: str) -> None:
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))


def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in a scratch folder: for rows that several tables are made of, so that each reads only its columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir: later steps read it instead of computing it, and executors may be lost.

    Meant for aggregates. What is written goes when the driver ends, unless the session had set its checkpoint folder itself.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
        _until_the_end(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint()


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df by its key in so many parts, which a join or a count by this key takes as they are; 0 parts are left to Spark."""
    return df.repartition(parts, key) if parts else df


def of_shares(df: DataFrame, parts: int) -> DataFrame:
    """df, a dimension too large to be sent to every task, with a note of how many tasks share the facts that it is joined to."""
    df.__dict__["_shares"] = parts
    return df


def shares(df: DataFrame) -> int:
    return df.__dict__.get("_shares", 0)


def with_totals(df: DataFrame, **totals) -> DataFrame:
    """df with aggregates over all its rows as columns: one row, broadcast, instead of a window that takes all rows to one task."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(name) for name, c in totals.items()])))
