"""Text from signals: deterministic sentences, and a guard against figures or claims that the evidence lacks.

`told` and `guarded` are columns of a plan, for any number of signals. `briefing` and what follows it is driver-side
work over a handful of rows, with the same words and rules. A rewriter (any callable) may reword the briefing; its
text is used only if the guard accepts it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import require

# What counts as a figure, and phrases that claim a cause.
FIGURE = re.compile(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?")
DAY = re.compile(r"\d{4}-\d{2}(?:-\d{2})?")
FIRST_YEAR, LAST_YEAR, SMALL_COUNT = 1900, 2100, 12
CAUSAL = ("caused by", "the cause of", "the root cause", "because of", "due to", "resulted from", "led to", "proves", "demonstrates that", "as a result of")
#: Metrics whose change is told in percentage points.
IN_POINTS = ("fill_rate", "cancellation_rate", "return_rate")
#: Display names of metrics and codes; anything else is spelled out from its code.
LABELS = {"net_sales": "net sales", "aov": "average order value", "kam_id": "account manager", "sku_id": "product", "fulfilment_constraint": "fulfilment or supply constraint", "demand_softness": "weaker demand", "portfolio_mix_shift": "shift in mix"}


def humanise(code: str) -> str:
    return LABELS.get(code, code.replace("_", " "))


def for_display(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: humanise(c).capitalize() for c in df.columns})


@dataclass(frozen=True)
class Verdict:
    ok: bool
    figures: tuple[str, ...] = field(default_factory=tuple)
    phrases: tuple[str, ...] = field(default_factory=tuple)

    @property
    def reason(self) -> str:
        if self.ok:
            return "every figure is in the evidence and no cause is claimed"
        return "; ".join([*(["figures without evidence: " + ", ".join(self.figures)] if self.figures else []), *(["claims of cause: " + ", ".join(self.phrases)] if self.phrases else [])])


def known_numbers(package: object) -> Iterator[float]:
    """Every number in a nested package."""
    if isinstance(package, bool) or package is None:
        return
    if isinstance(package, int | float):
        yield float(package)
    elif isinstance(package, str):
        for token in FIGURE.findall(DAY.sub(" ", package)):
            yield float(token.rstrip("%").replace(",", ""))
    elif isinstance(package, dict):
        for x in package.values():
            yield from known_numbers(x)
    elif isinstance(package, list | tuple):
        for x in package:
            yield from known_numbers(x)


def verify(text: str, package: object) -> Verdict:
    """A figure is supported if a known number (as it is, or as a percentage) rounds to it as precisely as it is written; signs are words' matter."""
    known = [abs(x) for x in known_numbers(package)]
    wrong = []
    for token in FIGURE.findall(DAY.sub(" ", text or "")):
        bare = token.rstrip("%").replace(",", "")
        value, slack = abs(float(bare)), 0.5 * 10.0 ** -len(bare.partition(".")[2]) + 1e-9
        whole = value == int(value)
        if whole and (value <= SMALL_COUNT or FIRST_YEAR <= value <= LAST_YEAR):
            continue
        scales = (100.0, 1.0) if token.endswith("%") else (1.0, 100.0)
        if not any(abs(k * s - value) <= slack for k in known for s in scales):
            wrong.append(token)
    claims = tuple(p for p in CAUSAL if p in (text or "").lower())
    return Verdict(not wrong and not claims, tuple(wrong), claims)


def moved(metric: str, change: float, pct: float | None) -> str:
    if metric in IN_POINTS:
        out = f"{round(change * 1000) / 10:+,.1f} percentage points"
    else:
        out = f"{change:+,.0f}" if abs(change) >= 1 else f"{change:+.4f}"
    return out if pct is None else f"{out} ({round(pct * 1000) / 10:+,.1f}%)"


def explain(signal: dict) -> str:
    """One signal as sentences, from its own numbers only."""
    parts = [f"{humanise(signal['metric']).capitalize()} in {signal['segment']} moved {moved(signal['metric'], signal['movement'], signal['movement_pct'])} in {signal['period']} against {signal['comparison_period']}."]
    driver = signal["likely_driver"]
    parts.append("The evidence fits no known pattern." if driver == "unclassified" else f"The evidence is consistent with: {humanise(driver)}.")
    if signal.get("alternative_supported"):
        parts.append("Another reading is also supported by the data.")
    if signal.get("impact"):
        parts.append(f"The estimated value associated with the shortfall is {signal['impact']:,.2f}.")
    parts.append(f"Confidence is {signal['confidence']}: {signal['criteria_met']} of 6 criteria met.")
    if signal.get("recommended_investigation"):
        parts.append(signal["recommended_investigation"])
    return " ".join(parts)


def _spelled(code: str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.col(code)), F.replace(F.col(code), F.lit("_"), F.lit(" ")))


def _signed(value: Column, places: int) -> Column:
    return F.concat(F.when(value < 0, "-").otherwise("+"), F.format_number(F.abs(value), places))


def told(signals: DataFrame) -> DataFrame:
    """signals with `text`: what `explain` says of each row. Without a movement there is nothing to tell: null."""
    require(signals.columns, ["metric", "segment", "movement", "movement_pct", "period", "comparison_period", "likely_driver", "alternative_supported", "impact", "confidence", "criteria_met"], "the signals")
    c, text = F.col, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    tenths = lambda x: _signed(F.rint(c(x) * 1000.0) / 10.0, 1)
    change = F.when(c("metric").isin(*IN_POINTS), text(tenths("movement"), " percentage points")).when(F.abs("movement") >= 1, _signed(c("movement"), 0)).otherwise(_signed(c("movement"), 4))
    change = F.concat(change, F.coalesce(text(" (", tenths("movement_pct"), "%)"), F.lit("")))
    name = _spelled("metric")
    first = text(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)), " in ", c("segment"), " moved ", change, " in ", c("period").cast("string"), " against ", c("comparison_period").cast("string"), ".")
    pattern = F.when(c("likely_driver") == "unclassified", "The evidence fits no known pattern.").otherwise(text("The evidence is consistent with: ", _spelled("likely_driver"), "."))
    other = F.when(c("alternative_supported"), "Another reading is also supported by the data.")
    value = F.when(c("impact") != 0, text("The estimated value associated with the shortfall is ", F.format_number("impact", 2), "."))
    sure = text("Confidence is ", c("confidence"), ": ", c("criteria_met").cast("string"), " of 6 criteria met.")
    advice = [F.when(c("recommended_investigation") != "", c("recommended_investigation"))] if "recommended_investigation" in signals.columns else []
    return signals.withColumn("text", F.when(first.isNotNull(), F.concat_ws(" ", first, pattern, other, value, sure, *advice)))


def guarded(rows: DataFrame, text: str, evidence: Sequence[str] | None = None) -> DataFrame:
    """rows with `figures` and `phrases`, what `verify` objects to in a text, and `ok`; evidence names the columns that a text may use (all others by default)."""
    kind = dict(rows.dtypes)
    use = [c for c in (evidence or rows.columns) if c != text]
    numbers = [F.col(c).cast("double") for c in use if kind[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind[c].startswith("decimal")]
    words = F.concat_ws(" ", *[F.col(c) for c in use if kind[c] == "string"])
    tokens = lambda x: F.regexp_extract_all(F.regexp_replace(x, DAY.pattern, " "), F.lit(FIGURE.pattern), F.lit(0))
    bare = lambda t: F.regexp_replace(t, "[,%]", "")
    known = F.filter(F.concat(F.array(*numbers).cast("array<double>"), F.transform(tokens(words), lambda t: bare(t).cast("double"))), lambda x: x.isNotNull())

    def unsupported(token: Column, have: Column) -> Column:
        value = F.abs(bare(token).cast("double"))
        slack = 0.5 * F.pow(F.lit(10.0), -F.length(F.regexp_extract(bare(token), r"\.(\d+)$", 1))) + 1e-9
        small = (value == F.floor(value)) & ((value <= SMALL_COUNT) | value.between(FIRST_YEAR, LAST_YEAR))
        return ~small & ~F.exists(have, lambda k: (F.abs(F.abs(k) - value) <= slack) | (F.abs(F.abs(k) * 100.0 - value) <= slack))

    said = F.coalesce(F.col(text), F.lit(""))
    out = rows.withColumn("_known", known).withColumns({"figures": F.filter(tokens(said), lambda t: unsupported(t, F.col("_known"))), "phrases": F.filter(F.array(*[F.lit(p) for p in CAUSAL]), lambda p: F.contains(F.lower(said), p))})
    return out.withColumn("ok", (F.size("figures") == 0) & (F.size("phrases") == 0)).drop("_known")


def briefing(signals: DataFrame, title: str = "What moved", markdown: bool = False, rewrite: Callable[[str, dict], str] | None = None) -> str:
    """All signals of a table (a handful, the top of a ranking); a rewriter's text must pass the guard, or ours stays."""
    rows = [r.asDict() for r in signals.collect()]
    lines = [f"# {title}" if markdown else title]
    if not rows:
        lines.append("No signal stands out.")
    for n, row in enumerate(rows, 1):
        text = explain(row)
        if rewrite is not None:
            try:
                other = rewrite(text, row)
            except Exception:  # noqa: BLE001  a service that fails must not stop the report
                other = text
            text = other if verify(other, row).ok else text
        lines.append(f"- {text}" if markdown else f"{n}. {text}")
    return "\n".join(lines)


def package(signals: DataFrame) -> dict:
    """All that a text may say, as plain values: what the guard checks and a rewriter gets."""
    rows = [r.asDict() for r in signals.collect()]
    return {"signals": rows, "count": len(rows), "texts": [explain(r) for r in rows]}


def prompt(row: dict) -> str:
    """What a rewriter is asked: the facts of one signal and the rules for its text."""
    facts = "\n".join(f"{k}: {v}" for k, v in row.items() if v is not None)
    return f"Reword this finding for a manager in at most three sentences. Use only these figures, and claim no cause.\n{facts}\nDraft: {explain(row)}"


def summary(signals: DataFrame) -> str:
    """One paragraph over a table of signals."""
    rows = [r.asDict() for r in signals.collect()]
    if not rows:
        return "No signal stands out."
    first, value = rows[0], sum(r["impact"] or 0.0 for r in rows)
    kinds = sorted({humanise(r["likely_driver"]) for r in rows if r["likely_driver"] != "unclassified"})
    parts = [f"{len(rows)} segments stand out in {first['period']} against {first['comparison_period']}, {first['segment']} first."]
    parts += [f"The evidence is consistent with: {', '.join(kinds)}."] if kinds else ["The evidence fits no known pattern."]
    parts += [f"The estimated value associated with all shortfalls is {value:,.2f}."] if value else []
    return " ".join(parts)
