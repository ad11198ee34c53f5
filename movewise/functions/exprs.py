"""Column expressions: rounding, ratios, money sums, calendar periods, labels.

Rounding is half-to-even on the scaled double (rint), as NumPy does it, never Spark's round(). Money
is rounded to cents per line and summed as decimals, so sums do not depend on the order of rows.
Undefined ratios are null; NaN is never produced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(value: Column | str, places: int) -> Column:
    """Half-to-even at some decimals; adding 0.0 turns a negative zero into zero."""
    scale = float(10**places)
    return F.rint(_c(value) * scale) / F.lit(scale) + F.lit(0.0)


def ratio(top: Column | str, bottom: Column | str, places: int | None = None) -> Column:
    """top / bottom as double, null where bottom is 0 (ANSI division would fail)."""
    out = _c(top).cast("double") / F.nullif(_c(bottom).cast("double"), F.lit(0.0))
    return out if places is None else half_even(out, places)


def money_sum(value: Column | str) -> Column:
    """Order-independent sum of amounts, each rounded to cents."""
    return F.sum(half_even(value, 2).cast("decimal(18,2)")).cast("double")


def check_period(period: str) -> str:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, not {period!r}")
    return period


def period_start(date: Column | str, period: str) -> Column:
    """First day of the day, the week (Monday) or the month."""
    d = _c(date).cast("date")
    return d if check_period(period) == "day" else F.trunc(d, period).cast("date")


def period_end(start: Column | str, period: str) -> Column:
    s = _c(start)
    return {"day": s, "week": F.date_add(s, 6), "month": F.last_day(s)}[check_period(period)]


def label(dims: Sequence[str], empty: str = "TOTAL") -> Column:
    """Dimension values joined into one segment name; nulls are shown, not skipped."""
    if not dims:
        return F.lit(empty)
    return F.concat_ws(" | ", *[F.coalesce(F.col(d).cast("string"), F.lit("None")) for d in dims])


def require(columns: Sequence[str], wanted: Sequence[str], what: str) -> None:
    if missing := [c for c in wanted if c not in columns]:
        raise ValueError(f"{what} lacks the columns {missing}")
