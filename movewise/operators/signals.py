"""Signals: evidence, pattern, impact, confidence and priority of the segments behind a movement.

One plan over segment-sized rows: leaders of a decomposition join wide evidence columns; patterns,
criteria and impact are column expressions. Texts name what the evidence is consistent with; no
cause is claimed. A missing value before or after is direction "unknown" and never read as a fall.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even, label, ratio, require
from ..functions.staging import settled
from ..sources.schema import ADDITIVE
from ..sources.schema import RATES as RATE_PARTS
from .decompose import ABSOLUTE_TOLERANCE, EFFECTS, RELATIVE_TOLERANCE, resolve_periods

# Thresholds of evidence and confidence.
STABLE_BAND = 0.05
MATERIAL, PERSISTENT, CONCENTRATED, CORROBORATED, COHERENT = 1.5, 2, 0.15, 2, 0.30
HIGH, MEDIUM = 5, 3
WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
COMMERCIAL = ["net_sales", "ordered_units", "fulfilled_units", "cancelled_units", "order_count"]
RATES = ["fill_rate", "cancellation_rate"]
STOCK = ["available_stock", "received_units", "stockout_rate"]
STOCK_DIMENSIONS = {"region_code", "sku_id", "warehouse", "category", "sub_category"}
MIX, SUPPLY, DEMAND, UNCLASSIFIED = "portfolio_mix_shift", "fulfilment_constraint", "demand_softness", "unclassified"


def change_pct(before: Column, after: Column) -> Column:
    """Against the size of the value before, whatever its sign."""
    return (after - before) / F.nullif(F.abs(before), F.lit(0.0))


def direction(before: Column, after: Column) -> Column:
    change, pct = after - before, change_pct(before, after)
    moved = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return F.when(before.isNull() | after.isNull(), "unknown").when(before == 0, moved).when(F.abs(pct) < STABLE_BAND, "flat").otherwise(moved)


def evidence(summary: DataFrame, dims: Sequence[str], current, comparison, inventory: DataFrame | None = None) -> DataFrame:
    """One row per segment: <name>_before, _after, _dir for every observation. A segment without a row counts as 0, except for rates."""

    def wide(frame: DataFrame, names: list[str], nullable: list[str]) -> DataFrame:
        names = [n for n in names if n in frame.columns]
        two = frame.where(F.col("period_start").isin(current, comparison))
        at = lambda n, p: F.max(F.when(F.col("period_start") == F.lit(p), F.col(n))).cast("double")
        fill = lambda n, c: c if n in nullable else F.coalesce(c, F.lit(0.0))
        return two.groupBy(*dims).agg(*[fill(n, at(n, p)).alias(f"{n}_{k}") for n in names for k, p in (("before", comparison), ("after", current))])

    out = wide(summary, COMMERCIAL + RATES, RATES)
    if inventory is not None:
        stock = wide(inventory.select("period_start", *dims, *STOCK), STOCK, [])
        out = out.join(stock, list(dims), "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in stock.columns if c not in dims})
    names = [c.removesuffix("_after") for c in out.columns if c.endswith("_after")]
    return out.withColumns({f"{n}_dir": direction(F.col(f"{n}_before"), F.col(f"{n}_after")) for n in names})


def evidence_rows(wide: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The observations of evidence() as rows."""
    names = [c.removesuffix("_dir") for c in wide.columns if c.endswith("_dir")]
    b, a = (lambda n: F.col(f"{n}_before")), (lambda n: F.col(f"{n}_after"))
    row = lambda n: F.struct(F.lit(n).alias("observation"), b(n).alias("before"), a(n).alias("after"), half_even(a(n) - b(n), 6).alias("change"), half_even(change_pct(b(n), a(n)), 4).alias("change_pct"), F.col(f"{n}_dir").alias("direction"))
    return wide.select(*dims, F.explode(F.array(*map(row, names))).alias("o")).select(*dims, "o.*")


def persistence(summary: DataFrame, metric: str, dims: Sequence[str], current) -> DataFrame:
    """streak: consecutive changes up to the current period with the latest one's sign (0 if it did not move)."""
    by = Window.partitionBy(*dims).orderBy("period_start")
    signs = summary.where(F.col("period_start") <= F.lit(current)).select(*dims, "period_start", F.signum(F.col(metric).cast("double") - F.lag(F.col(metric).cast("double")).over(by)).alias("s")).where(F.col("s").isNotNull())
    back = Window.partitionBy(*dims).orderBy(F.desc("period_start"))
    newest = signs.withColumn("last", F.first("s").over(back)).withColumn("broken", F.sum((F.col("s") != F.col("last")).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return newest.groupBy(*dims).agg(F.sum(((F.col("broken") == 0) & (F.col("last") != 0)).cast("int")).cast("int").alias("streak"))


def typical_swing(summary: DataFrame, metric: str, dims: Sequence[str]) -> DataFrame:
    """Median absolute change of a segment's own history; null under three rows or if it is 0."""
    by = Window.partitionBy(*dims).orderBy("period_start")
    steps = summary.select(*dims, F.abs(F.col(metric).cast("double") - F.lag(F.col(metric).cast("double")).over(by)).alias("d"))
    out = steps.groupBy(*dims).agg(F.count("*").alias("n"), F.percentile("d", 0.5).alias("m"))
    return out.select(*dims, F.when((F.col("n") >= 3) & (F.col("m") > 0), half_even("m", 6)).alias("typical"))


def selling_price(net: Column, units: Column) -> Column:
    return F.coalesce(net / F.nullif(units, F.lit(0.0)), F.lit(0.0))


def shortfall(ordered: Column, fulfilled: Column, baseline: Column, net: Column) -> Column:
    """Value of the units that the earlier fill rate would have served, at the price realised."""
    rate = F.least(F.greatest(baseline, F.lit(0.0)), F.lit(1.0))
    return half_even(F.greatest(F.lit(0.0), ordered * rate - fulfilled) * selling_price(net, fulfilled), 2)


def unfulfilled(ordered: Column, fulfilled: Column, net: Column) -> Column:
    return half_even(F.greatest(F.lit(0.0), ordered - fulfilled) * selling_price(net, fulfilled), 2)


def _is(name: str, *values: str) -> Column:
    return F.col(f"{name}_dir").isin(*values)


def classified(frame: DataFrame, component: str | Column) -> DataFrame:
    """likely_driver, alternative_supported and corroborating (count) from evidence columns; component is the effect that a row was ranked by."""
    if "available_stock_dir" not in frame.columns:
        frame = frame.withColumns({"available_stock_dir": F.lit("unknown"), "stockout_rate_dir": F.lit("unknown")})
    down_f, held = _is("fulfilled_units", "down"), _is("ordered_units", "up", "flat")
    count = lambda *cs: reduce(lambda a, b: a + b, [c.cast("int") for c in cs])
    mix = (F.lit(component) if isinstance(component, str) else component) == "mix_effect"
    lagged = _is("fill_rate", "down") | (down_f & held)
    soft = _is("ordered_units", "down")
    return frame.withColumns({
        "likely_driver": F.when(mix, MIX).when(lagged, SUPPLY).when(soft, DEMAND).otherwise(UNCLASSIFIED),
        "alternative_supported": F.when(mix, down_f & ~soft).when(lagged, ~held).when(soft, _is("available_stock", "down") | _is("stockout_rate", "up")),
        "corroborating": F.when(mix, 0).when(lagged, F.lit(2) + count(_is("available_stock", "down"), _is("stockout_rate", "up"))).when(soft, F.lit(1) + count(down_f, _is("available_stock", "up", "flat"))).otherwise(F.lit(0)),
    })


@dataclass(frozen=True)
class Case:
    """A movement to look into: of a metric, from one period to another."""

    name: str
    metric: str
    current: date
    comparison: date


def _checked(summary: DataFrame, cases: Sequence[Case]) -> None:
    """Refuses metrics and periods that the summary does not have."""
    for metric in dict.fromkeys(c.metric for c in cases):
        if metric not in RATE_PARTS and metric not in ADDITIVE:
            raise ValueError(f"{metric} is neither additive nor a rate")
        require(summary.columns, RATE_PARTS.get(metric, (metric,)), "the period summary")
    have = {r[0] for r in summary.select("period_start").distinct().collect()}
    for c in cases:
        if c.comparison >= c.current:
            raise ValueError("the comparison period must come first")
        if lost := [p for p in (c.current, c.comparison) if p not in have]:
            raise ValueError(f"the summary has no period {lost[0]}")


def _sides(summary: DataFrame, cases: Sequence[Case]) -> DataFrame:
    """(case, metric, _p, _k): the periods of each case, 0 before and 1 after."""
    rows = [(c.name, c.metric, p, k) for c in cases for p, k in ((c.comparison, 0), (c.current, 1))]
    return summary.sparkSession.createDataFrame(rows, "case string, metric string, _p date, _k int")


def _before_after(frame: DataFrame, sides: DataFrame, dims: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per case and segment: <name>_before and <name>_after."""
    at = lambda n, k: F.max(F.when(F.col("_k") == k, F.col(n))).cast("double")
    two = frame.select("period_start", *dims, *names).join(sides, F.col("period_start") == F.col("_p"))
    return two.groupBy("case", "metric", *dims).agg(*[at(n, k).alias(f"{n}_{s}") for n in names for k, s in ((0, "before"), (1, "after"))])


def _by_metric(metrics: Sequence[str], value) -> Column:
    """value(metric) of each row's own metric."""
    out = F.lit(None).cast("double")
    for m in metrics:
        out = F.when(F.col("metric") == m, value(m)).otherwise(out)
    return out


def _split(frame: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Contributions and, for rates, their effects, by case; parts of a rate that do not add back to its movement are an error, when the plan runs."""
    zero = lambda n, s: F.coalesce(F.col(f"{n}_{s}"), F.lit(0.0))
    rates, sums = [m for m in metrics if m in RATE_PARTS], [m for m in metrics if m not in RATE_PARTS]
    part = lambda at, s: _by_metric(rates, lambda m: zero(RATE_PARTS[m][at], s))
    frame = frame.withColumns({"n0": part(0, "before"), "n1": part(0, "after"), "d0": part(1, "before"), "d1": part(1, "after")})
    total = frame.groupBy("case").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n0", "n1", "d0", "d1")])
    frame = frame.join(total, "case")
    frame = frame.withColumns({"w0": ratio("d0", "t_d0"), "w1": ratio("d1", "t_d1"), "own0": ratio("n0", "d0"), "own1": ratio("n1", "d1")})
    frame = frame.withColumns({"r0": F.coalesce("own0", "own1", F.when(F.col("d0").isNotNull(), 0.0)), "r1": F.coalesce("own1", "own0", F.when(F.col("d0").isNotNull(), 0.0))})
    w, r = F.col("w1") - F.col("w0"), F.col("r1") - F.col("r0")
    added = _by_metric(sums, lambda m: half_even(zero(m, "after") - zero(m, "before"), 6))
    exact = F.col("w1") * F.col("r1") - F.col("w0") * F.col("r0")
    frame = frame.withColumns({"rate_effect": half_even(F.col("w0") * r, 10), "mix_effect": half_even(w * F.col("r0"), 10), "interaction_effect": half_even(w * r, 10), "exact": exact, "contribution": F.coalesce(added, half_even(exact, 10))})
    moved = ratio("t_n1", "t_d1") - ratio("t_n0", "t_d0")
    off = F.abs(F.col("t_exact") - moved) > ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * F.abs(moved)
    wrong = F.when(F.col("metric").isin(rates) & (moved.isNull() | off), F.raise_error(F.concat("metric", F.lit(" of "), "case", F.lit(": no denominator in one of the periods, or segments that do not add to the movement"))).cast("double"))
    each = lambda f, names: [f(F.sum(n)).alias(f"net_{n}") for n in names] + [f(F.sum(F.abs(n))).alias(f"gross_{n}") for n in names]
    whole = frame.groupBy("case", "metric", "t_n0", "t_n1", "t_d0", "t_d1").agg(F.sum("exact").alias("t_exact"), *each(lambda x: x, [*EFFECTS, "contribution"]))
    ranked = F.array_sort(F.array(*[F.struct((-F.abs(half_even(f"net_{e}", 6))).alias("by"), F.lit(e).alias("component"), half_even(F.abs(f"net_{e}") / F.nullif(F.col(f"gross_{e}"), F.lit(0.0)), 4).alias("coherence")) for e in EFFECTS]))[0]
    rate = F.col("metric").isin(rates)
    whole = whole.select(
        "case", F.coalesce(wrong, half_even("gross_contribution", 10)).alias("_gross"), F.when(rate, ranked["component"]).otherwise("contribution").alias("component"),
        F.when(rate, F.coalesce(ranked["coherence"], F.lit(0.0)) >= COHERENT).otherwise(True).alias("steady"), *[half_even(f"gross_{e}", 10).alias(f"_all_{e}") for e in [*EFFECTS, "contribution"]],
    )
    frame = frame.join(whole, "case")
    pick = lambda prefix: reduce(lambda x, e: F.when(F.col("component") == e, F.col(prefix + e)).otherwise(x), EFFECTS, F.col(f"{prefix}contribution"))
    frame = frame.withColumns({"_v": pick(""), "_all": pick("_all_")})
    return frame.withColumns({"share_of_absolute_movement": F.when(F.col("_gross") > 0, ratio(F.abs("contribution"), "_gross", 4)), "component_share": ratio(F.abs("_v"), "_all")})


def _histories(leaders: DataFrame, summary: DataFrame, dims: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """streak and typical of each case and segment, from one grouping: its values in the order of periods."""
    past = leaders.select("case", "metric", "current", *dims).join(summary.select("period_start", *dims, *metrics), list(dims))
    value = _by_metric(metrics, lambda m: F.col(m).cast("double"))
    grouped = past.groupBy("case", "current", *dims).agg(F.array_sort(F.collect_list(F.struct(F.col("period_start").alias("p"), value.alias("v")))).alias("_h"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_h") - 1), lambda i: F.struct(F.get("_h", i)["p"].alias("p"), (F.get("_h", i)["v"] - F.get("_h", i - 1)["v"]).alias("d")))
    grouped = grouped.withColumn("_d", F.filter(F.when(F.size("_h") > 1, steps).otherwise(F.array().cast("array<struct<p:date,d:double>>")), lambda x: x["d"].isNotNull()))
    signs = F.reverse(F.transform(F.filter("_d", lambda x: x["p"] <= F.col("current")), lambda x: F.signum(x["d"])))
    run = F.aggregate(signs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & (x == signs[0]) & (x != 0)).cast("int")).alias("n"), (a["on"] & (x == signs[0])).alias("on")))
    sizes = F.array_sort(F.transform("_d", lambda x: F.abs(x["d"])))
    middle = (F.get(sizes, F.floor((F.size(sizes) - 1) / 2).cast("int")) + F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))) / 2
    typical = F.when((F.size("_h") >= 3) & (F.size("_d") > 0) & (middle > 0), half_even(middle, 6))
    return grouped.select("case", *dims, F.when(F.size("_h") > 1, run["n"]).alias("streak"), typical.alias("typical"))


def detect_cases(summary: DataFrame, cases: Sequence[Case], dims: Sequence[str], inventory: DataFrame | None = None, top_n: int = 3, direction_: str = "negative", min_confidence: str | None = None) -> DataFrame:
    """Signals of many movements in one plan: case, the dimensions, and the columns of `detect`.

    Cases are a table that meets the summary by period; leaders are the first top_n segments of each case.
    """
    if min_confidence is not None and min_confidence not in WEIGHTS:
        raise ValueError(f"min_confidence must be one of {sorted(WEIGHTS)}")
    if len({c.name for c in cases}) < len(cases):
        raise ValueError("cases need names of their own")
    _checked(summary, cases)
    dims, metrics = list(dims), list(dict.fromkeys(c.metric for c in cases))
    names = [n for n in dict.fromkeys([*COMMERCIAL, *RATES, *metrics, *[x for m in metrics for x in RATE_PARTS.get(m, ())]]) if n in summary.columns]
    sides = _sides(summary, cases)
    parts = _split(settled(_before_after(summary, sides, dims, names)), metrics).withColumn("segment", label(dims))
    v = F.col("_v")
    keep = {"negative": v < 0, "positive": v > 0, "absolute": v.isNotNull()}[direction_]
    order = {"negative": v.asc(), "positive": v.desc(), "absolute": F.abs(v).desc()}[direction_]
    periods = sides.groupBy("case").agg(F.max("_p").alias("current"), F.min("_p").alias("comparison"))
    leaders = parts.where(keep).withColumn("_n", F.row_number().over(Window.partitionBy("case").orderBy(order, "segment"))).where(F.col("_n") <= top_n).join(periods, "case")
    leaders = settled(leaders)  # top_n rows a case

    stock = inventory if inventory is not None and set(dims) <= STOCK_DIMENSIONS else None
    note = None if stock is not None else "no inventory at this grain" if inventory is not None else "no inventory given"
    observed = [n for n in [*COMMERCIAL, *RATES] if n in names]
    rows = leaders.withColumns({f"value_{s}": _by_metric(metrics, lambda m, s=s: F.col(f"{m}_{s}")) for s in ("before", "after")})
    rows = rows.withColumns({f"{n}_{s}": F.coalesce(f"{n}_{s}", F.lit(0.0)) for n in observed if n not in RATES for s in ("before", "after")})
    if stock is not None:
        levels = _before_after(stock, sides, dims, STOCK).drop("metric")
        rows = rows.join(levels, ["case", *dims], "left").withColumns({f"{n}_{s}": F.coalesce(f"{n}_{s}", F.lit(0.0)) for n in STOCK for s in ("before", "after")})
        observed += STOCK
    rows = rows.withColumns({f"{n}_dir": direction(F.col(f"{n}_before"), F.col(f"{n}_after")) for n in observed})
    rows = rows.join(_histories(leaders, summary, dims, metrics), ["case", *dims], "left")
    rows = classified(rows, F.col("component"))
    moved = F.col("value_after") - F.col("value_before")
    impact = F.when(F.col("fill_rate_before").isNotNull(), shortfall(F.col("ordered_units_after"), F.col("fulfilled_units_after"), F.col("fill_rate_before"), F.col("net_sales_after")))
    no = lambda c: F.coalesce(c, F.lit(False))
    criteria = {
        "movement_is_material": no(F.abs(moved) >= MATERIAL * F.col("typical")), "movement_persisted": no(F.col("streak") >= PERSISTENT), "segment_carries_the_movement": no(F.col("component_share") >= CONCENTRATED),
        "other_metrics_agree": F.col("corroborating") >= CORROBORATED, "alternative_not_supported": no(~F.col("alternative_supported")), "movement_is_directional": F.col("steady"),
    }
    rows = rows.withColumns({"movement": half_even(moved, 4), "movement_pct": half_even(change_pct(F.col("value_before"), F.col("value_after")), 4), "impact": impact} | criteria)
    rows = rows.withColumn("criteria_met", reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in criteria]))
    rows = rows.withColumn("confidence", F.when(F.col("criteria_met") >= HIGH, "high").when(F.col("criteria_met") >= MEDIUM, "medium").otherwise("low"))
    rows = rows.withColumn("weight", weight_of("confidence")).withColumn("priority_score", half_even(F.coalesce(F.abs("impact"), F.lit(0.0)) * F.col("weight"), 2))
    if min_confidence:
        rows = rows.where(F.col("weight") >= WEIGHTS[min_confidence])
    return rows.select(
        "case", *dims, "metric", F.lit(" | ".join(dims)).alias("dimension"), "segment", F.col("current").alias("period"), F.col("comparison").alias("comparison_period"), "movement", "movement_pct", "contribution", "share_of_absolute_movement",
        F.col("component").alias("ranked_by"), "likely_driver", "alternative_supported", "corroborating", "impact", *criteria, "criteria_met", "confidence", "priority_score", investigation().alias("recommended_investigation"), F.lit(note).cast("string").alias("inventory_note"),
    )


def weight_of(confidence: str) -> Column:
    c = F.col(confidence)
    return F.when(c == "high", WEIGHTS["high"]).when(c == "medium", WEIGHTS["medium"]).otherwise(WEIGHTS["low"])


def detect(summary: DataFrame, metric: str, dims: Sequence[str], inventory: DataFrame | None = None, current=None, comparison=None, top_n: int = 3, direction_: str = "negative", min_confidence: str | None = None) -> DataFrame:
    """Signals of the leading segments of one movement, by priority (ties by segment)."""
    case = Case(metric, metric, *resolve_periods(summary, current, comparison))
    return detect_cases(summary, [case], dims, inventory, top_n, direction_, min_confidence).drop("case", *dims).orderBy(F.desc("priority_score"), "segment")


def investigation() -> Column:
    s = F.col("segment")
    return (
        F.when(F.col("likely_driver") == MIX, F.concat(F.lit("Check how demand shifted between segments of "), s, F.lit(" and whether its receivers are stocked.")))
        .when(F.col("likely_driver") == SUPPLY, F.concat(F.lit("Check stock and replenishment of "), s, F.lit(", largest unserved products first.")))
        .when(F.col("likely_driver") == DEMAND, F.concat(F.lit("Check orders of "), s, F.lit(" by customer and channel, and that stock was there.")))
        .otherwise(F.concat(F.lit("Look at "), s, F.lit(" at a finer grain or over a longer time.")))
    )


# Planted scenarios, and what is found of them.

SCENARIO = "case string, expected_pattern string, region string, kinds array<string>, metric string, under_way array<string>"


def _planted(found: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """A row for each scenario, with the regions where anything had begun by its period."""
    begun = lambda day: sorted({s["region_code"] for s in scenarios if s.get("starts") and str(s["starts"]) <= day})
    rows = [(s["name"], s.get("expected_pattern"), s["region_code"], list(s.get("categories") or []), s["metric"], begun(str(s["current_period"]))) for s in scenarios]
    return found.sparkSession.createDataFrame(rows, SCENARIO)


def judged(found: DataFrame, scenarios: Sequence[dict], dims: Sequence[str] = ("region_code", "category"), floors: Sequence[str] = ("high", "medium")) -> DataFrame:
    """One row per scenario and confidence floor: what its signals (of detect_cases, the case being its name) say of it.

    Signals of the floor's confidence or more count, in order of priority. One is a false alarm where nothing had
    begun in its region (the first dimension). The first in the scenario's region, and of its categories (the last
    dimension) if it has any, is its match. outcome: hit, wrong_pattern, miss; of a control correct_silence or false_alarm.
    """
    least = F.explode(F.array(*[F.struct(F.lit(f).alias("confidence_floor"), F.lit(WEIGHTS[f]).alias("least")) for f in floors]))
    grid = _planted(found, scenarios).withColumn("_f", least).select("*", "_f.*").drop("_f")
    signal = found.select("case", F.col(dims[0]).alias("_region"), F.col(dims[-1]).alias("_kind"), "segment", "likely_driver", "priority_score", weight_of("confidence").alias("weight"))
    loud = grid.join(signal, "case").where(F.col("weight") >= F.col("least"))
    loud = loud.withColumn("n", F.row_number().over(Window.partitionBy("case", "confidence_floor").orderBy(F.desc("priority_score"), "segment")).cast("int"))
    calm = ~F.coalesce(F.array_contains("under_way", F.col("_region")), F.lit(False))
    here = F.col("expected_pattern").isNotNull() & (F.col("_region") == F.col("region")) & ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("_kind")))
    told = loud.groupBy("case", "confidence_floor").agg(
        F.count("*").cast("int").alias("signals_returned"), F.transform(F.array_sort(F.collect_list(F.when(calm, F.struct("n", "segment")))), lambda x: x["segment"]).alias("false_positives"),
        F.min(F.when(here, F.struct("n", "segment", "likely_driver"))).alias("match"),
    )
    out = grid.join(told, ["case", "confidence_floor"], "left").withColumns({"signals_returned": F.coalesce("signals_returned", F.lit(0)), "false_positives": F.coalesce("false_positives", F.array().cast("array<string>"))})
    control = F.when(F.size("false_positives") > 0, "false_alarm").otherwise("correct_silence")
    outcome = F.when(F.col("expected_pattern").isNull(), control).when(F.col("match").isNull(), "miss").when(F.col("match.likely_driver") == F.col("expected_pattern"), "hit").otherwise("wrong_pattern")
    return out.select(
        F.col("case").alias("scenario"), "expected_pattern", "region", "metric", "confidence_floor", outcome.alias("outcome"), F.col("match.segment").alias("matched_segment"), F.col("match.likely_driver").alias("matched_pattern"),
        F.col("match.n").alias("rank"), "signals_returned", "false_positives",
    )


def evaluate_scenarios(scenarios: Sequence[dict], summary: DataFrame, dims: Sequence[str], inventory: DataFrame | None = None, floors: Sequence[str] = ("high", "medium"), top_n: int = 6) -> DataFrame:
    """Every planted scenario at each confidence floor, judged by the signals of its own metric and periods."""
    day = lambda s, k: date.fromisoformat(str(s[k]))
    cases = [Case(s["name"], s["metric"], day(s, "current_period"), day(s, "comparison_period")) for s in scenarios]
    return judged(detect_cases(summary, cases, dims, inventory, top_n), scenarios, dims, floors)


def summarise_evaluation(outcomes: DataFrame) -> DataFrame:
    """Detection rates of each floor."""
    n = lambda c: F.count(F.when(c, 1))
    kind = lambda o: n(F.col("outcome") == o)
    planted = n(F.col("expected_pattern").isNotNull())
    return outcomes.groupBy("confidence_floor").agg(
        planted.alias("planted_scenarios"), kind("hit").alias("correctly_classified"), kind("wrong_pattern").alias("found_but_misclassified"), kind("miss").alias("missed"), ratio(kind("hit"), planted, 4).alias("recall"),
        F.coalesce(F.sum(F.size("false_positives")), F.lit(0)).cast("long").alias("false_alarm_signals"), kind("correct_silence").alias("controls_silent"), n(F.col("expected_pattern").isNull()).alias("controls"),
    )
