"""Databases through JDBC: scans dealt to tasks by quantiles of a key, and a set of tables replaced in one transaction.

A scan first counts. The database groups its keys into bins, and bins that hold more than a task's share
are counted again in finer ones, until the share fits or one key is left. Cuts between bins that lie at
quantiles become range predicates, one task each; rows without a key are a task of their own. The driver
sees counts only. Columns and filters of the query that follows are pushed into each task's SELECT by
Spark.

A replacement writes all tables beside the old ones, by many tasks, and then moves the rows over in one
transaction: readers see all old tables or all new ones, and a load that fails leaves the old ones.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Bins of one count, and how often crowded ones are counted again.
BINS, ROUNDS = 256, 8


def safe_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"unsafe table name {name!r}")
    return name


def quoted(spark: SparkSession, url: str, column: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)


def _asked(spark: SparkSession, url: str, query: str, properties: dict[str, str]) -> list:
    return spark.read.jdbc(url, f"({query}) q", properties=properties).collect()


def _number_cuts(ask: Callable[[str], list], key: str, low, high, share: float, whole: bool) -> list[tuple[float, int]]:
    """(lower edge, rows) of bins in order, crowded ones finer."""
    out: list[tuple[float, int]] = []
    open_bins = [(low, high, None)]
    for depth in range(ROUNDS):
        crowded = []
        for a, b, _ in open_bins:
            width = (b - a) / BINS if not whole else max(1, -(-(b - a + 1) // BINS))
            if not width or a + width <= a:
                continue
            inside = f"{key} >= {a!r} AND {key} <= {b!r}" if depth == 0 else f"{key} >= {a!r} AND {key} < {b!r}"
            rows = ask(f"SELECT b, COUNT(*) AS n FROM (SELECT FLOOR(({key} - {a!r}) / {width!r}) AS b FROM T_ WHERE {inside}) x GROUP BY b")
            found = sorted((int(r[0]), int(r[1])) for r in rows)
            out = [x for x in out if not (a <= x[0] and (x[0] <= b if depth == 0 else x[0] < b))]
            for k, n in found:
                edge = a + k * width
                out.append((edge, n))
                if n > share and (width > 1 if whole else True) and depth + 1 < ROUNDS:
                    crowded.append((edge, edge + width, n))
        open_bins = crowded
        if not crowded:
            break
    return sorted(out)


def _text_cuts(ask: Callable[[str], list], key: str, share: float) -> list[tuple[str, int]]:
    """(prefix, rows) in the database's order, prefixes as long as shares ask for."""
    cuts: list[tuple[str, int]] = []
    for length in (1, 2, 3, 4, 6, 8):
        rows = ask(f"SELECT p, COUNT(*) AS n FROM (SELECT SUBSTR({key}, 1, {length}) AS p FROM T_ WHERE {key} IS NOT NULL) x GROUP BY p")
        cuts = sorted((r[0], int(r[1])) for r in rows)
        if len(cuts) > BINS * 4 or not cuts or max(n for _, n in cuts) <= share:
            break
    return cuts


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, dt.datetime):
        return f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}"
    if isinstance(value, dt.date):
        return f"{{d '{value.isoformat()}'}}"
    return repr(value)


def _at_quantiles(bins: list[tuple[object, int]], parts: int) -> list[object]:
    """Edges that come nearest to equal shares, the first bin's not among them."""
    total, before, out = sum(n for _, n in bins), 0, []
    for edge, n in bins:
        if before * parts >= total * (len(out) + 1) and before:
            out.append(edge)
        elif before and n * parts > total and before * parts > total * len(out):  # a crowded bin begins a task of its own
            out.append(edge)
        before += n
        if len(out) == parts - 1:
            break
    return sorted(set(out))


def predicates(spark: SparkSession, url: str, table: str, key: str, parts: int, properties: dict[str, str] | None = None) -> list[str]:
    """Conditions that each row meets exactly one of: ranges of the key at its quantiles, and no key at all."""
    properties, name = properties or {}, quoted(spark, url, key)
    kind = spark.read.jdbc(url, safe_name(table), properties=properties).schema[key].dataType
    ask = lambda q: _asked(spark, url, q.replace("T_", table), properties)
    n, known, low, high = ask(f"SELECT COUNT(*) AS n, COUNT({name}) AS k, MIN({name}) AS a, MAX({name}) AS b FROM T_")[0]
    out = [f"{name} IS NULL"] if known < n else []
    if not known:
        return out or ["1 = 0"]
    share = known / parts
    if isinstance(kind, StringType):
        bins = _text_cuts(ask, name, share)
    elif isinstance(kind, (DateType, TimestampType)):
        first = dt.datetime(low.year, low.month, low.day)
        days = f"{{fn TIMESTAMPDIFF(SQL_TSI_DAY, {_literal(first)}, {name})}}"
        rows = ask(f"SELECT b, COUNT(*) AS n FROM (SELECT {days} AS b FROM T_ WHERE {name} IS NOT NULL) x GROUP BY b")  # a row for each day
        edge = lambda k: first + dt.timedelta(days=k) if isinstance(kind, TimestampType) else (first + dt.timedelta(days=k)).date()
        bins = [(edge(k), c) for k, c in sorted((int(r[0]), int(r[1])) for r in rows)]
    elif isinstance(kind, NumericType):
        whole = "int" in kind.simpleString() or isinstance(low, Decimal) and getattr(kind, "scale", 1) == 0
        bins = _number_cuts(ask, name, int(low) if whole else float(low), int(high) if whole else float(high), share, whole)
    else:
        raise ValueError(f"{key} is {kind.simpleString()}: no key to deal rows by")
    cuts = [_literal(c) for c in _at_quantiles(bins, parts)]
    if not cuts:
        return [*out, f"{name} IS NOT NULL"]
    return [*out, f"{name} < {cuts[0]}", *[f"{name} >= {a} AND {name} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)], f"{name} >= {cuts[-1]}"]


def load_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int | None = None, **properties: str) -> DataFrame:
    """A table; with a key by many tasks (parts, or as many as the session shuffles to), each with an equal share of the rows."""
    if key is None:
        return spark.read.jdbc(url, safe_name(table), properties=properties)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.jdbc(url, safe_name(table), predicates=predicates(spark, url, table, key, parts, properties), properties=properties)


def in_transaction(spark: SparkSession, url: str, statements: list[str], properties: dict[str, str] | None = None) -> None:
    """All statements or none."""
    jvm = spark.sparkContext._jvm
    held = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        held.setProperty(k, v)
    if driver := (properties or {}).get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    connection = jvm.java.sql.DriverManager.getConnection(url, held)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def replace_tables(tables: dict[str, DataFrame], url: str, text_type: str = "VARCHAR(4000)", **properties: str) -> None:
    """The tables in their order (parents first), all replaced at once; tables that are not there yet are made, with text_type for texts."""
    spark = next(iter(tables.values())).sparkSession
    mark = uuid.uuid4().hex[:8]
    beside = {name: f"{safe_name(name)}_{mark}" for name in tables}
    made: list[str] = []
    try:
        for name, df in tables.items():
            types = ", ".join(f"`{f.name}` {text_type}" for f in df.schema.fields if isinstance(f.dataType, StringType))
            options = {"createTableColumnTypes": types} if types else {}
            made.append(beside[name])
            df.write.mode("error").jdbc(url, beside[name], properties=properties)
            df.limit(0).write.mode("append").options(**options).jdbc(url, name, properties=properties)
        columns = {name: ", ".join(quoted(spark, url, c) for c in df.columns) for name, df in tables.items()}
        texts = {name: [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)] for name, df in tables.items()}
        values = {name: ", ".join(f"CAST({quoted(spark, url, c)} AS {text_type})" if c in texts[name] else quoted(spark, url, c) for c in df.columns) for name, df in tables.items()}
        moved = [f"INSERT INTO {name} ({columns[name]}) SELECT {values[name]} FROM {beside[name]}" for name in tables]
        in_transaction(spark, url, [f"DELETE FROM {name}" for name in reversed(list(tables))] + moved, properties)
    finally:
        for name in made:
            try:
                in_transaction(spark, url, [f"DROP TABLE {name}"], properties)
            except Exception:  # noqa: BLE001  the write failed before its table was there
                continue
