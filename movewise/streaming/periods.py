"""Calendar periods over a stream of events: an extension of the batch periods.

A period is complete once the watermark has passed its end; late events within the watermark still
count. State is one row per open period and group, dropped when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Windows start on Monday (1970-01-05 was one).
WINDOWS = {"day": ("1 day", "0 seconds"), "week": ("7 days", "4 days")}


def period_totals(events: DataFrame, period: str = "day", late: str = "2 days", group_by: Sequence[str] = ("event_type",), time: str = "ts", value: str = "value") -> DataFrame:
    """period_start, group, events, total; append mode emits a period when it is complete."""
    length, start = WINDOWS[period]
    w = F.window(time, length, startTime=start)
    out = events.withWatermark(time, late).groupBy(w, *group_by).agg(F.count("*").alias("events"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select(F.to_date("window.start").alias("period_start"), *group_by, "events", "total")


def stream_events(spark, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
