"""Exact contributions of segments to a movement, and the drivers behind them.

A rate's movement is split per segment into rate, mix and interaction effects (w is the share of the
denominator, r the rate; 0 before, 1 after): w0 (r1 - r0), (w1 - w0) r0, (w1 - w0)(r1 - r0). They add
back to the movement, which is asserted. One conditional aggregation aligns the two periods.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even, label, ratio, require
from ..functions.staging import settled, with_totals
from ..sources.schema import ADDITIVE, RATES

OTHER = "Other (below volume floor)"
OFFSETTING = 0.05
EFFECTS = ["rate_effect", "mix_effect", "interaction_effect"]
ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE = 1e-9, 1e-6
COLUMNS = ["metric", "dimension", "segment", "period_start", "comparison_period", "contribution", "contribution_share", "share_of_absolute_movement"]


def resolve_periods(summary: DataFrame, current=None, comparison=None) -> tuple[date, date]:
    """The two periods to compare: the latest and the one before it by default."""
    rows = summary.select("period_start").distinct().orderBy(F.desc("period_start"))
    if current is None and comparison is None:
        last = [r[0] for r in rows.limit(2).collect()]
        if len(last) < 2:
            raise ValueError("a movement needs two periods")
        return last[0], last[1]
    have = [r[0] for r in rows.collect()]
    current = current or have[0]
    if comparison is None:
        earlier = [p for p in have if p < current]
        if not earlier:
            raise ValueError("no period before the current one")
        comparison = earlier[0]
    for p in (current, comparison):
        if p not in have:
            raise ValueError(f"the summary has no period {p}")
    if comparison >= current:
        raise ValueError("the comparison period must come first")
    return current, comparison


def _sums(summary: DataFrame, dims: Sequence[str], columns: Sequence[str], current, comparison) -> DataFrame:
    """One row per segment: each column now (name_1) and before (name_0), absent segments as 0."""
    at = lambda c, p: F.coalesce(F.sum(F.when(F.col("period_start") == F.lit(p), F.col(c))), F.lit(0)).cast("double")
    two = summary.where(F.col("period_start").isin(current, comparison))
    return two.groupBy(*dims).agg(*[at(c, p).alias(f"{c}_{k}") for c in columns for k, p in ((0, comparison), (1, current))])


def _finished(frame: DataFrame, metric: str, dims: Sequence[str], current, comparison) -> DataFrame:
    out = with_totals(frame, _net=half_even(F.sum("contribution"), 10), _gross=half_even(F.sum(F.abs("contribution")), 10))
    usable = (F.col("_net") != 0) & (F.abs("_net") >= OFFSETTING * F.col("_gross"))
    out = out.withColumns({
        "metric": F.lit(metric), "dimension": F.lit(" | ".join(dims)), "segment": label(dims), "period_start": F.lit(current), "comparison_period": F.lit(comparison),
        "contribution_share": F.when(usable, ratio("contribution", "_net", 4)), "share_of_absolute_movement": F.when(F.col("_gross") > 0, ratio(F.abs("contribution"), "_gross", 4)),
    })
    return out.select(*COLUMNS, *[c for c in frame.columns if c not in COLUMNS]).orderBy("contribution", "segment")


def decompose_additive(summary: DataFrame, metric: str, dims: Sequence[str], current=None, comparison=None) -> DataFrame:
    if metric not in ADDITIVE:
        raise ValueError(f"{metric} is not additive")
    require(summary.columns, [metric, *dims], "the period summary")
    current, comparison = resolve_periods(summary, current, comparison)
    sums = settled(_sums(summary, dims, [metric], current, comparison)).withColumnsRenamed({f"{metric}_0": "previous_value", f"{metric}_1": "current_value"})
    return _finished(sums.withColumn("contribution", half_even(F.col("current_value") - F.col("previous_value"), 6)), metric, dims, current, comparison)


def decompose_rate(summary: DataFrame, metric: str, dims: Sequence[str], current=None, comparison=None, min_share: float = 0.0, check: bool = True) -> DataFrame:
    """Rate, mix and interaction effects by segment; thin segments may be folded into one.

    A segment without a denominator in one period takes the other period's rate there: all mix.
    """
    if metric not in RATES:
        raise ValueError(f"{metric} is not a rate")
    top, bottom = RATES[metric]
    require(summary.columns, [top, bottom, *dims], "the period summary")
    current, comparison = resolve_periods(summary, current, comparison)
    frame = settled(_sums(summary, dims, [top, bottom], current, comparison).toDF(*dims, "n0", "n1", "d0", "d1"))  # a row a segment, read by every total below
    if min_share > 0:
        frame = _folded(frame, dims, min_share)
    frame = with_totals(frame, t0=F.sum("d0"), t1=F.sum("d1"))
    frame = frame.withColumns({"w0": ratio("d0", "t0"), "w1": ratio("d1", "t1"), "own0": ratio("n0", "d0"), "own1": ratio("n1", "d1")})
    frame = frame.withColumns({"r0": F.coalesce("own0", "own1", F.lit(0.0)), "r1": F.coalesce("own1", "own0", F.lit(0.0))})
    w, r = F.col("w1") - F.col("w0"), F.col("r1") - F.col("r0")
    frame = frame.withColumns({"rate_effect": half_even(F.col("w0") * r, 10), "mix_effect": half_even(w * F.col("r0"), 10), "interaction_effect": half_even(w * r, 10), "exact": F.col("w1") * F.col("r1") - F.col("w0") * F.col("r0")})
    if check:
        assert_adds_up(frame.withColumn("segment", label(dims)), metric)
    frame = frame.withColumn("contribution", half_even("exact", 10))
    return _finished(frame.select(*dims, *EFFECTS, "contribution", F.col("own0").alias("previous_value"), F.col("own1").alias("current_value")), metric, dims, current, comparison)


def _folded(frame: DataFrame, dims: Sequence[str], min_share: float) -> DataFrame:
    """Segments under the share in both periods become one, if there are two of them or more."""
    thin = (ratio("d0", "_t0") < min_share) & (ratio("d1", "_t1") < min_share)
    sized = with_totals(frame, _t0=F.sum("d0"), _t1=F.sum("d1")).withColumn("_thin", F.coalesce(thin, F.lit(False)))
    marked = with_totals(sized, _many=F.sum(F.col("_thin").cast("int")))
    fold = F.col("_thin") & (F.col("_many") >= 2)
    return marked.select(*[F.when(fold, F.lit(OTHER)).otherwise(F.col(d).cast("string")).alias(d) for d in dims], "n0", "n1", "d0", "d1").groupBy(*dims).agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")])


def assert_adds_up(decomposition: DataFrame, metric: str) -> None:
    """Refuses a split whose exact contributions do not add back to the observed movement: one aggregate row comes back."""
    row = decomposition.agg(F.sum("n0"), F.sum("n1"), F.sum("d0"), F.sum("d1"), F.sum("exact")).first()
    n0, n1, d0, d1, parts = (float(x or 0) for x in row)
    if d0 == 0 or d1 == 0:
        raise ValueError(f"{metric} has no denominator in one of the periods")
    observed = n1 / d1 - n0 / d0
    if abs(observed - parts) > ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * abs(observed):
        stranded = decomposition.where(((F.col("d0") == 0) & (F.col("n0") != 0)) | ((F.col("d1") == 0) & (F.col("n1") != 0))).select("segment").orderBy("segment").limit(5).collect()
        raise ValueError(f"{metric}: segments add to {parts}, the movement is {observed}; numerators without {RATES[metric][1]} in {[r[0] for r in stranded]}; raise min_share to fold them")


def decompose(summary: DataFrame, metric: str, dims: Sequence[str], current=None, comparison=None, min_share: float = 0.0) -> DataFrame:
    if metric in RATES:
        return decompose_rate(summary, metric, dims, current, comparison, min_share)
    return decompose_additive(summary, metric, dims, current, comparison)


def total_movement(decomposition: DataFrame) -> float:
    return float(decomposition.agg(F.sum("contribution")).first()[0] or 0.0)


def coherence(decomposition: DataFrame) -> DataFrame:
    """Per effect: net and gross movement, their ratio, and the share of all net movement."""
    require(decomposition.columns, EFFECTS, "a rate decomposition")
    sums = decomposition.agg(*[F.sum(e).alias(f"{e}_n") for e in EFFECTS], *[F.sum(F.abs(e)).alias(f"{e}_g") for e in EFFECTS])
    rows = F.explode(F.array(*[F.struct(F.lit(e).alias("component"), half_even(F.col(f"{e}_n"), 6).alias("net"), half_even(F.col(f"{e}_g"), 6).alias("gross"), half_even(F.abs(f"{e}_n") / F.nullif(F.col(f"{e}_g"), F.lit(0.0)), 4).alias("coherence")) for e in EFFECTS]))
    return with_totals(sums.select(rows.alias("x")).select("x.*"), _all=half_even(F.sum(F.abs("net")), 6)).withColumn("share_of_net_movement", ratio(F.abs("net"), "_all", 4)).drop("_all")


def dominant_component(decomposition: DataFrame) -> str:
    if not set(EFFECTS) <= set(decomposition.columns):
        return "contribution"
    return coherence(decomposition).orderBy(F.abs("net").desc(), "component").first()["component"]


def concentration(decomposition: DataFrame, top_n: int = 3, name: str = "concentration") -> DataFrame:
    """One row: the share of the top segments in the sum of absolute contributions. A limit takes the top ones, task by task."""
    sizes = decomposition.select(F.abs("contribution").alias("a"), "segment")
    top = sizes.orderBy(F.desc("a"), "segment").limit(top_n).agg(half_even(F.sum("a"), 10).alias("t"))
    return top.crossJoin(sizes.agg(half_even(F.sum("a"), 10).alias("w"))).select(ratio("t", "w", 4).alias(name))  # one row on each side


def rank_drivers(decomposition: DataFrame, direction: str = "negative", top_n: int = 5, by: str = "contribution") -> DataFrame:
    """Ties go by segment."""
    if direction not in ("negative", "positive", "absolute"):
        raise ValueError("direction must be negative, positive or absolute")
    require(decomposition.columns, [by], "the decomposition")
    v = F.col(by)
    keep = {"negative": v < 0, "positive": v > 0, "absolute": v.isNotNull()}[direction]
    order = {"negative": v.asc(), "positive": v.desc(), "absolute": F.abs(v).desc()}[direction]
    top = decomposition.where(keep).orderBy(order, "segment").limit(top_n)
    return top.select(F.row_number().over(Window.orderBy(order, "segment")).cast("int").alias("rank"), F.lit(by).alias("ranked_by"), *top.columns)


def compare_dimensions(summaries: dict[str, DataFrame], metric: str, dimensions: Sequence[Sequence[str]], current=None, comparison=None, top_n: int = 3) -> DataFrame:
    """One row per cut: how many segments, the leader, and how concentrated the movement is."""
    rows = []
    for dims in dimensions:
        key = " | ".join(dims)
        if key not in summaries:
            raise ValueError(f"no period summary for {key}")
        d = settled(decompose(summaries[key], metric, dims, current, comparison))
        best = F.max_by(F.struct("segment", "contribution", "share_of_absolute_movement"), F.struct(F.abs("contribution"), F.col("segment")))
        one = d.agg(F.count("*").alias("segments"), half_even(F.sum("contribution"), 4).alias("total_movement"), best.alias("b"))
        one = one.select(F.lit(key).alias("dimension"), "segments", "total_movement", F.col("b.segment").alias("top_segment"), half_even(F.col("b.contribution"), 4).alias("top_contribution"), F.col("b.share_of_absolute_movement").alias("top_share_of_absolute_movement"))
        rows.append(one.crossJoin(concentration(d, top_n, f"top_{top_n}_concentration")))  # one row on each side
    return reduce(DataFrame.unionByName, rows).orderBy(F.col(f"top_{top_n}_concentration").desc_nulls_last(), "dimension")


def explain_movement(summary: DataFrame, metric: str, dims: Sequence[str], current=None, comparison=None, top_n: int = 3) -> dict:
    """A small package for reports: direction, ranking column, leaders, components."""
    d = decompose(summary, metric, dims, current, comparison)
    moved, by = total_movement(d), dominant_component(d)
    direction = "negative" if moved < 0 else "positive"
    parts = [r.asDict() for r in coherence(d).collect()] if by != "contribution" else []
    return {"metric": metric, "dimension": " | ".join(dims), "total_movement": moved, "direction": direction, "ranked_by": by, "leaders": [r.asDict() for r in rank_drivers(d, direction, top_n, by).collect()], "components": parts}


def fold_small(frame: DataFrame, key: str, value: str, limit: int = 8) -> DataFrame:
    """The largest limit - 1 keys by absolute total; the rest become "Other"."""
    totals = settled(frame.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("_t")))
    first = totals.orderBy(F.abs("_t").desc(), key).limit(limit + 1).collect()  # a few rows
    if len(first) <= limit:
        return frame.where(F.col(key).isNotNull())
    kept = [r[key] for r in first[: limit - 1]]
    return frame.where(F.col(key).isNotNull()).withColumn(key, F.when(F.col(key).isin(kept), F.col(key)).otherwise(F.lit("Other")))


def service_status(fill_rate: Column | str, target: Column | str) -> Column:
    """Bands of a fill rate against its target."""
    gap = (F.col(fill_rate) if isinstance(fill_rate, str) else fill_rate) - (F.col(target) if isinstance(target, str) else target)
    return F.when(gap.isNull(), "No demand").when(gap >= 0, "On target").when(gap >= -0.05, "Slightly below").when(gap >= -0.15, "Below target").otherwise("Well below")
