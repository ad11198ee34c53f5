"""The package as a zip for executors: code that runs in Python workers is imported there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="movewise-"), "movewise_engine.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith((".py", ".sql")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(to)
    _shipped.add(context.applicationId)
