"""Reports and views: compositions of the operators, as dicts of DataFrames. They compute no metric of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_even, label
from ..functions.staging import settled
from ..operators import decompose, forecast, kpi, mart, signals, variance
from ..sources import workbook
from . import narrate

Tables = dict[str, DataFrame]
METRICS = ["net_sales", "units", "orders"]


def daily_sales_tracker(t: Tables) -> dict[str, DataFrame]:
    """Sales of each day against the day before and the plan."""
    day = mart.summarise_by_period(t, "day")
    moved = variance.trend(day, "net_sales").select("period_start", F.col("previous_value").alias("prior_day_net_sales"), F.col("absolute_change").alias("day_over_day_change"))
    plan = variance.versus_target(day, t["fact_targets"], "net_sales", "sales_target", "day").select("period_start", F.col("comparison_value").alias("sales_target"), F.col("variance").alias("target_variance"), F.col("variance_pct").alias("target_variance_pct"))
    return {"Daily tracker": day.join(moved, "period_start", "left").join(plan, "period_start", "left").orderBy("period_start")}


def sales_performance(t: Tables) -> dict[str, DataFrame]:
    """Weekly sales by region, category, channel and manager, and against the plan."""
    cuts = {"By region": ["region_code"], "By category": ["category"], "By channel": ["channel"], "By manager": ["kam_id"]}
    cells = mart.Summaries(t, ["region_code", "category", "channel", "kam_id"])
    out = {name: mart.in_order(cells.by("week", dims), ["period_start", *dims]) for name, dims in cuts.items()}
    dims = ["region_code", "category", "channel"]
    out["Plan variance"] = variance.versus_target(cells.by("week", dims), t["fact_targets"], "net_sales", "sales_target", "week", dims)
    return out


def fill_rate_report(t: Tables) -> dict[str, DataFrame]:
    """Weekly service by region and category, against its target and the week before."""
    dims = ["region_code", "category"]
    week = mart.summarise_by_period(t, "week", dims)
    return {
        "Against target": variance.versus_target(week, t["fact_targets"], "fill_rate", "fill_rate_target", "week", dims),
        "Service detail": mart.in_order(week.withColumn("unfulfilled_units", F.col("ordered_units") - F.col("fulfilled_units")), ["period_start", *dims]),
        "Movement": variance.trend(week, "fill_rate", dims).orderBy("absolute_change"),
    }


def primary_secondary(t: Tables) -> dict[str, DataFrame]:
    """How sales divide into primary and secondary ones."""
    return {f"By {d}": kpi.primary_secondary_mix(t["fact_sales"], [d]) for d in ("region_code", "channel", "category")}


def forecast_report(t: Tables, horizon: int = 7, initial: int = 28, step: int = 7) -> dict[str, DataFrame]:
    """Backtests of the daily forecasters and the predictions of the best one."""
    daily, out = settled(forecast.daily_series(t["fact_sales"], t["fact_orders"])), {}
    for metric in METRICS:
        predictions = settled(forecast.backtest(forecast.extract_metric(daily, metric), horizon=horizon, initial=initial, step=step))
        scored = forecast.ranked(forecast.against_baseline(forecast.scores(predictions)))
        out[f"Accuracy {metric}"] = scored
        best = F.broadcast(scored.where("rank = 1").select("model"))  # one row
        out[f"Backtest {metric}"] = predictions.join(best, "model").select("fold", "origin_date", "date", "actual", "forecast", half_even(F.col("forecast") - F.col("actual"), 4).alias("error"))
    return out | {"Daily series": daily}


def _summary_and_stock(t: Tables, dims: list[str], period: str) -> tuple[DataFrame, DataFrame | None]:
    stock = mart.inventory_by_period(t["fact_inventory"], t["dim_sku"], period, dims) if set(dims) <= signals.STOCK_DIMENSIONS else None
    return mart.summarise_by_period(t, period, dims), stock


def signal_report(t: Tables, metric: str = "net_sales", dims: tuple[str, ...] = ("region_code", "category"), period: str = "week", top_n: int = 5) -> dict[str, DataFrame]:
    """Segments behind the latest movement, with their evidence, criteria and a briefing."""
    summary, stock = _summary_and_stock(t, list(dims), period)
    found = settled(signals.detect(summary, metric, dims, stock, top_n=top_n))
    current, comparison = decompose.resolve_periods(summary)
    rows = signals.evidence_rows(signals.evidence(summary, dims, current, comparison, stock), dims)
    criteria = ["movement_is_material", "movement_persisted", "segment_carries_the_movement", "other_metrics_agree", "alternative_not_supported", "movement_is_directional"]
    checks = found.select("segment", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("met")) for c in criteria])).alias("c")).select("segment", "c.*")
    named = rows.withColumn("segment", label(list(dims))).join(found.select("segment"), "segment", "left_semi")
    words = narrate.told(found).orderBy(F.desc("priority_score"), "segment").select(F.col("text").alias("briefing"))
    return {"Signals": found, "Evidence": named, "Criteria": checks, "Impact": found.select("segment", "impact", "confidence", "priority_score"), "Briefing": words}


REPORTS: dict[str, Callable[..., dict[str, DataFrame]]] = {f.__name__: f for f in (daily_sales_tracker, sales_performance, fill_rate_report, primary_secondary, forecast_report, signal_report)}


def available_reports() -> list[str]:
    return sorted(REPORTS)


def cover(name: str, t: Tables, sheets: dict[str, DataFrame], options: dict) -> DataFrame:
    """(item, text): what a report holds, from when to when its facts reach, and how to read it."""
    a, z = mart.date_range(t["fact_sales"], t["fact_orders"]).first()
    about = (REPORTS[name].__doc__ or name).strip().split("\n")[0]
    notes = ["Periods that the data covers only in part are left out.", "A ratio without a denominator is empty, never 0.", "Patterns say what the evidence is consistent with; no cause is claimed."]
    rows = [("report", narrate.humanise(name)), ("about", about), ("first date", str(a)), ("last date", str(z)), *[(f"option {k}", str(v)) for k, v in options.items()], *[("sheet", s) for s in sheets], *[("note", n) for n in notes]]
    return t["fact_sales"].sparkSession.createDataFrame(rows, "item string, text string")


def build_report(name: str, t: Tables, **options) -> dict[str, DataFrame]:
    if name not in REPORTS:
        raise ValueError(f"no report {name!r}; there are {available_reports()}")
    sheets = REPORTS[name](t, **options)
    return {"Cover": cover(name, t, sheets, options)} | sheets


def build_all_reports(t: Tables) -> dict[str, dict[str, DataFrame]]:
    return {name: build_report(name, t) for name in REPORTS}


def write_workbook(name: str, t: Tables, path: str, **options) -> None:
    """A report as a workbook: a cover that says what it is and how to read it, then its sheets, numbers shown by their meaning."""
    sheets = build_report(name, t, **options)
    lines = sheets.pop("Cover").collect()  # a dozen lines of text
    said = [(r["item"], r["text"]) for r in lines]
    notes = [text for item, text in said if item == "note"] + [f"{item}: {text}" for item, text in said if item not in ("note", "report", "about", "sheet")]
    title, about = (next(text for item, text in said if item == wanted) for wanted in ("report", "about"))
    workbook.write_workbook({sheet: flatten(df) for sheet, df in sheets.items()}, path, workbook.Cover(title, about, notes))


def write_csv(sheets: dict[str, DataFrame], folder: str) -> None:
    for name, df in sheets.items():
        flatten(df).write.mode("overwrite").csv(f"{folder}/{name.lower().replace(' ', '_')}", header=True)


def analysis_tables(t: Tables, returns: DataFrame) -> dict[str, DataFrame]:
    """The published tables."""
    month = mart.summarise_by_period(t, "month")
    split = decompose.decompose_rate(mart.returns_by_period(t["fact_sales"], returns, "month", ["region_code"]), "return_rate", ["region_code"], min_share=0.01)
    series = forecast.extract_metric(forecast.daily_series(t["fact_sales"], t["fact_orders"]), "net_sales")
    return {
        "rpt_monthly_trade": mart.in_order(month, ["period_start"]), "rpt_monthly_trend": variance.trend(month, "net_sales"),
        "rpt_country_contribution": decompose.decompose_additive(mart.summarise_by_period(t, "month", ["region_code"]), "net_sales", ["region_code"]),
        "rpt_returns_monthly": mart.returns_by_period(t["fact_sales"], returns, "month", ["region_code"]), "rpt_return_rate_split": split, "rpt_return_rate_components": decompose.coherence(split),
        "rpt_forecast_accuracy": forecast.against_baseline(forecast.scores(forecast.backtest(series, horizon=7, initial=56, step=14))),
    }


def flatten(df: DataFrame) -> DataFrame:
    """Columns that any warehouse takes: nested ones as JSON, timestamps as dates."""
    kind = dict(df.dtypes)
    return df.select(*[F.to_json(c).alias(c) if kind[c].startswith(("struct", "array", "map")) else F.to_date(c).alias(c) if kind[c].startswith("timestamp") else F.col(c) for c in df.columns])


# Views of a dashboard, without one.


def available_periods(summary: DataFrame) -> DataFrame:
    return summary.where("is_complete").select("period_start").distinct().orderBy(F.desc("period_start"))


def overview(t: Tables, period: str = "week") -> dict:
    """The latest complete period against the one before: two rows reach the driver."""
    summary = mart.summarise_by_period(t, period)
    last = [r.asDict() for r in summary.orderBy(F.desc("period_start")).limit(2).collect()]
    if len(last) < 2:
        return {"available": False}
    now, before = last
    change = lambda m: None if now[m] is None or before[m] is None else now[m] - before[m]
    headline = {m: {"value": now[m], "previous": before[m], "change": change(m), "change_pct": change(m) / abs(before[m]) if before[m] and change(m) is not None else None} for m in ("net_sales", "sales_units", "order_count", "fill_rate", "aov")}
    plan = variance.versus_target(summary, t["fact_targets"], "net_sales", "sales_target", period).where(F.col("period_start") == F.lit(now["period_start"])).limit(1).collect()
    headline["target"] = plan[0].asDict() if plan else None
    return {"available": True, "period": now["period_start"], "comparison_period": before["period_start"], "period_type": period, "headline": headline, "trend": variance.trend(summary, "net_sales"), "summary": summary}


HEADLINE = ("net_sales", "sales_units", "order_count", "fill_rate", "aov")


def headline(t: Tables, period: str = "week") -> DataFrame:
    """metric, period, value, previous, change, change_pct of the latest complete period, and its net sales against the plan."""
    summary = mart.summarise_by_period(t, period)
    newest = F.max_by(F.struct("period_start", *HEADLINE), "period_start")
    now = summary.agg(newest.alias("now"))
    before = summary.join(F.broadcast(now.select(F.col("now.period_start").alias("_p"))), F.col("period_start") < F.col("_p")).agg(newest.alias("before"))  # one row
    both = now.crossJoin(F.broadcast(before))  # one row on each side
    value = lambda side, c: F.col(f"{side}.{c}").cast("double")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col("now.period_start").alias("period"), value("now", c).alias("value"), value("before", c).alias("previous")) for c in HEADLINE]))
    out = both.select(rows.alias("r")).select("r.*")
    plan = variance.versus_target(summary, t["fact_targets"], "net_sales", "sales_target", period).join(F.broadcast(now.select(F.col("now.period_start").alias("period_start"))), "period_start")
    out = out.withColumn("change", half_even(F.col("value") - F.col("previous"), 6)).withColumn("change_pct", half_even((F.col("value") - F.col("previous")) / F.nullif(F.abs("previous"), F.lit(0.0)), 4))
    return out.unionByName(plan.select(F.lit("gap to plan").alias("metric"), F.col("period_start").alias("period"), F.col("actual").alias("value"), F.col("comparison_value").alias("previous"), F.col("variance").alias("change"), F.col("variance_pct").alias("change_pct")))


def sales_views(t: Tables) -> dict[str, DataFrame]:
    dims = ["region_code", "category", "channel", "kam_id"]
    cells = mart.Summaries(t, dims)
    out = {"daily": mart.in_order(cells.by("day"), ["period_start"])} | {d: mart.in_order(cells.by("week", [d]), ["period_start", d]) for d in dims}
    return out | {"mix": kpi.primary_secondary_mix(t["fact_sales"], ["region_code"]), "plan": variance.versus_target(cells.by("week", dims[:2]), t["fact_targets"], "net_sales", "sales_target", "week", dims[:2])}


def match_periods(df: DataFrame, reference: DataFrame) -> DataFrame:
    return df.join(reference.select("period_start").distinct(), "period_start", "left_semi")


def supply_views(t: Tables, period: str = "week") -> dict[str, DataFrame]:
    dims = ["region_code", "category"]
    cells = mart.Summaries(t, dims)
    segments = mart.in_order(cells.by(period, dims), ["period_start", *dims])
    plan = mart.with_period(t["fact_targets"], period).groupBy("period_start", *dims).agg(half_even(F.avg("fill_rate_target"), 6).alias("fill_rate_target"))
    service = segments.join(plan, ["period_start", *dims], "left").withColumn("status", decompose.service_status("fill_rate", "fill_rate_target"))
    sku = mart.commercial_metrics(mart.enrich_sales(t, only=["sku_id"]), mart.enrich_orders(t, only=["sku_id"]), ["sku_id"]).withColumn("unfulfilled_units", F.col("ordered_units") - F.col("fulfilled_units"))
    return {
        "segments": segments, "service": service, "by_region": mart.in_order(cells.by(period, ["region_code"]), ["period_start", "region_code"]),
        "inventory": mart.in_order(match_periods(mart.inventory_by_period(t["fact_inventory"], t["dim_sku"], period, ["region_code"]), segments), ["period_start", "region_code"]),
        "by_sku": sku.orderBy(F.desc("unfulfilled_units"), "sku_id").limit(15), "trend": variance.trend(cells.by(period), "fill_rate"),
    }


def forecast_views(t: Tables, horizon: int = 7, initial: int = 28, step: int = 7) -> dict:
    return forecast_report(t, horizon, initial, step) | {"settings": {"horizon": horizon, "initial": initial, "step": step}}


def signal_views(t: Tables, **options) -> dict[str, DataFrame]:
    return signal_report(t, **options)


def data_quality_summary(audit: DataFrame) -> DataFrame:
    return audit.orderBy("table", "action")
