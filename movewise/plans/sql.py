"""Spark SQL resources: staging views, the mart, and the analytical queries, run over temp views."""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from ..sources.schema import TABLES

VIEWS = ["stg_sales", "stg_orders", "stg_inventory", "stg_targets", "stg_kam_targets", "mart_commercial_daily"]
QUERIES = ["daily_sales_tracker", "fill_rate_by_segment", "kam_scorecard", "primary_secondary_mix", "supply_watchlist", "target_variance", "weekly_movers"]


def text_of(name: str) -> str:
    return (resources.files(__package__) / "sql" / f"{name}.sql").read_text()


def available_queries() -> list[str]:
    return list(QUERIES)


def statements(script: str) -> list[str]:
    """Statements of a script, without comments."""
    lines = [x.partition("--")[0] for x in script.splitlines()]
    return [s.strip() for s in "\n".join(lines).split(";") if s.strip()]


def suffixed(text: str, suffix: str) -> str:
    """SQL over the views of one dataset among several: every name of a table or view gets the suffix."""
    return re.sub(rf"\b({'|'.join([*TABLES, *VIEWS])})\b", lambda m: m[1] + suffix, text) if suffix else text


def qualified(text: str, database: str) -> str:
    """SQL over the tables and views of a database, whatever temporary views have their names."""
    return re.sub(rf"\b({'|'.join([*TABLES, *VIEWS])})\b", lambda m: f"{database}.{m[1]}", text)


def apply_views(spark: SparkSession, suffix: str = "") -> None:
    for name in VIEWS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name}{suffix} AS {suffixed(text_of(name), suffix)}")


def run_query(spark: SparkSession, name: str, suffix: str = "") -> DataFrame:
    if name not in QUERIES:
        raise ValueError(f"no query {name!r}; there are {QUERIES}")
    return spark.sql(suffixed(text_of(name), suffix))


def run_query_file(spark: SparkSession, path: str) -> DataFrame:
    with open(path) as f:
        *setup, last = statements(f.read())
    for s in setup:
        spark.sql(s)
    return spark.sql(last)
