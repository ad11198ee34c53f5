"""Registered queries of the remaining sheets, views and published tables, of capabilities and of the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import settled
from ..operators import validate
from ..sources import invoices
from ..sources.testbed import INVOICE_SQL, Model
from . import queries as q
from . import reports
from .more_queries import _BAD, _BROKEN, _DAY, _REGION_RETURNS, _broken, _published, _report
from .queries import _D, _MONTH, _R, RC, query

# Sheets.


@query("SELECT * FROM p", q._summary(["region_code"], "week"))
def report_by_region(m: Model) -> DataFrame:
    return _report(m, "sales_performance", "By region")


@query("SELECT * FROM p", q._summary(["category"], "week"))
def report_by_category(m: Model) -> DataFrame:
    return _report(m, "sales_performance", "By category")


@query("SELECT * FROM p", q._summary(["channel"], "week"))
def report_by_channel(m: Model) -> DataFrame:
    return _report(m, "sales_performance", "By channel")


def _trend_sql(metric: str, dims: list[str], period: str) -> str:
    keys = ", ".join([*dims, ""])
    part = f"PARTITION BY {', '.join(dims)} " if dims else ""
    summary = q._summary(dims, period)
    return (
        (summary if dims else summary.replace("GROUP BY ALL", "GROUP BY period_start"))
        + f""",
t0 AS (SELECT '{metric}' AS metric, {keys}period_type, period_start, lag(period_start) OVER w AS previous_period_start, CAST({metric} AS DOUBLE) AS value, CAST(lag({metric}) OVER w AS DOUBLE) AS previous_value FROM p WINDOW w AS ({part}ORDER BY period_start)),
t1 AS (SELECT *, {_R("value - previous_value", 6)} AS absolute_change FROM t0 WHERE previous_value IS NOT NULL), tr AS (SELECT *, {_R("absolute_change / nullif(previous_value, 0)")} AS pct_change FROM t1)"""
    )


@query("SELECT * FROM tr", _trend_sql("fill_rate", RC, "week"))
def report_service_movement(m: Model) -> DataFrame:
    return _report(m, "fill_rate_report", "Movement")


@query("SELECT * FROM ser", q._SERIES)
def report_daily_series(m: Model) -> DataFrame:
    return _report(m, "forecast_report", "Daily series", initial=700, step=700)


@query("SELECT segment, impact, confidence, " + _R("coalesce(abs(impact), 0) * weight", 2) + " AS priority_score FROM x4", q._SIGNALS)
def report_signal_impact(m: Model) -> DataFrame:
    return _report(m, "signal_report", "Impact", period="month")


# Views.


@query("SELECT * FROM p", _DAY)
def view_sales_daily(m: Model) -> DataFrame:
    return reports.sales_views(m.tables())["daily"]


@query("SELECT * FROM p", q._summary(["kam_id"], "week"))
def view_sales_by_manager(m: Model) -> DataFrame:
    return reports.sales_views(m.tables())["kam_id"]


@query(
    f"SELECT {q._VARIANCE}, category FROM (SELECT *, {_R('variance / nullif(comparison_value, 0)')} AS variance_pct FROM pv)",
    q._summary(RC, "week")
    + f""", pt AS (SELECT {q._WEEK} AS period_start, region_code, category, {_D("sales_target")} AS comparison_value FROM fact_targets GROUP BY ALL),
pv AS (SELECT 'net_sales' AS metric, region_code || ' | ' || category AS segment, 'week' AS period_type, period_start, period_start AS comparison_period, net_sales AS actual, comparison_value, {_R("net_sales - comparison_value", 6)} AS variance, 'target' AS comparison_type, region_code, category FROM p JOIN pt USING (period_start, region_code, category))""",
)
def view_sales_plan(m: Model) -> DataFrame:
    return reports.sales_views(m.tables())["plan"]


@query("SELECT * FROM p", q._summary(RC))
def view_supply_segments(m: Model) -> DataFrame:
    return reports.supply_views(m.tables(), "month")["segments"]


@query("SELECT * FROM p", q._summary(["region_code"]))
def view_supply_by_region(m: Model) -> DataFrame:
    return reports.supply_views(m.tables(), "month")["by_region"]


@query("SELECT * FROM tr", _trend_sql("fill_rate", [], "month"))
def view_supply_trend(m: Model) -> DataFrame:
    return reports.supply_views(m.tables(), "month")["trend"]


_RANKED = f"SELECT *, {_R('((SELECT wape FROM sc WHERE model = ' + chr(39) + 'naive' + chr(39) + ') - wape) / nullif((SELECT wape FROM sc WHERE model = ' + chr(39) + 'naive' + chr(39) + '), 0)')} AS wape_gain"


@query(_RANKED + ", CAST(row_number() OVER (ORDER BY wape NULLS LAST, model) AS INTEGER) AS rank FROM sc", q._backtest_sql(56, 28, 7).replace("CAST(orders AS DOUBLE)", "CAST(units AS DOUBLE)") + "," + q._SCORES)
def view_forecast_accuracy(m: Model) -> DataFrame:
    return reports.forecast_views(m.tables(), initial=56, step=28)["Accuracy units"]


@query("SELECT segment, likely_driver, confidence FROM x4", q._SIGNALS)
def view_signals(m: Model) -> DataFrame:
    return reports.signal_views(m.tables(), period="month")["Signals"].select("segment", "likely_driver", "confidence")


_HEADLINE = ["net_sales", "sales_units", "order_count", "fill_rate", "aov"]


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS metric, period_start AS period, CAST(v AS DOUBLE) AS value, CAST(w AS DOUBLE) AS previous, {_R('CAST(v AS DOUBLE) - CAST(w AS DOUBLE)', 6)} AS change, {_R('(CAST(v AS DOUBLE) - CAST(w AS DOUBLE)) / nullif(abs(CAST(w AS DOUBLE)), 0)')} AS change_pct FROM (SELECT period_start, {c} AS v, lag({c}) OVER (ORDER BY period_start) AS w FROM p) QUALIFY row_number() OVER (ORDER BY period_start DESC) = 1" for c in _HEADLINE)
    + f" UNION ALL SELECT 'gap to plan', period_start, net_sales, sales_target, {_R('net_sales - sales_target', 6)}, {_R(_R('net_sales - sales_target', 6) + ' / nullif(sales_target, 0)')} FROM (SELECT period_start, net_sales, sales_target FROM p JOIN (SELECT {_MONTH} AS period_start, {_D('sales_target')} AS sales_target FROM fact_targets GROUP BY 1) USING (period_start) WHERE period_start = (SELECT max(period_start) FROM p))",
    q._summary([], "month").replace("GROUP BY ALL", "GROUP BY period_start"),
)
def view_overview_headline(m: Model) -> DataFrame:
    """Five metrics of the latest complete month against the month before, and its gap to the plan."""
    return reports.headline(m.tables(), "month")


# Published tables.


@query("SELECT * FROM tr", _trend_sql("net_sales", [], "month"))
def published_monthly_trend(m: Model) -> DataFrame:
    return _published(m, "rpt_monthly_trend")


@query("SELECT * FROM p", _REGION_RETURNS)
def published_monthly_returns(m: Model) -> DataFrame:
    return _published(m, "rpt_returns_monthly")


_SPLIT = q._rate_sql(_REGION_RETURNS, ["region_code"], "returned_units", "sold_units", "return_rate", "0.01")


@query(f"SELECT *, {_R('abs(net) / nullif(' + _R('sum(abs(net)) OVER ()', 6) + ', 0)')} AS share_of_net_movement FROM co", q._COHERENCE.replace(q._RATE, _SPLIT))
def published_return_components(m: Model) -> DataFrame:
    return _published(m, "rpt_return_rate_components")


@query(_RANKED + " FROM sc", q._backtest_sql(56, 14, 7).replace("CAST(orders AS DOUBLE)", "CAST(net_sales AS DOUBLE)") + "," + q._SCORES)
def published_forecast_accuracy(m: Model) -> DataFrame:
    return _published(m, "rpt_forecast_accuracy")


# What a source can be asked, and the gate.


@query(
    "SELECT analysis, needs, CASE WHEN needs = 'fact_sales' THEN (SELECT count(*) FROM isl) ELSE 0 END > 0 AS supported, CASE WHEN needs = 'fact_sales' THEN (SELECT count(*) FROM isl) ELSE 0 END AS rows FROM (VALUES "
    + ", ".join(f"('{a}', '{', '.join(facts)}')" for a, facts in invoices.NEEDS.items())
    + ") t(analysis, needs)",
    INVOICE_SQL,
)
def capability_answers(m: Model) -> DataFrame:
    """Each analysis, the facts that it needs, and the sold lines that stand behind its answer."""
    sheet = invoices.adapt(m.spark, m.invoices())
    sold = F.lit(sheet.counts["source_lines"] - sheet.counts["return_lines"]).cast("long")
    answers = sheet.capabilities.answers(m.spark)
    return answers.select("analysis", "needs", "supported", F.when(F.col("supported"), sold).otherwise(F.lit(0)).cast("long").alias("rows"))


@query(
    "SELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, count(*) FILTER (WHERE severity = 'ERROR') = 0 AS passed FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS severity, CAST(({n}) AS BIGINT) AS rows" for (_, _, s), n in _BAD.items())
    + ") WHERE rows > 0",
    _BROKEN,
)
def gate_verdict(m: Model) -> DataFrame:
    """What the gate would say of the broken model: it raises the errors that are counted here."""
    issues = settled(validate.validate(m.spark, _broken(m)))
    try:
        validate.gate(issues)
        passed = True
    except validate.DatasetContractError:
        passed = False
    count = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return issues.agg(count("ERROR").alias("errors"), count("WARNING").alias("warnings")).withColumn("passed", F.lit(passed))


@query("SELECT order_id, sku_id, net_sales FROM fact_sales ORDER BY net_sales DESC, order_id, sku_id, units LIMIT 10")
def largest_sales(m: Model) -> DataFrame:
    """The first rows of a report: each task keeps its ten."""
    return m.fact_sales().orderBy(F.desc("net_sales"), "order_id", "sku_id", "units").limit(10).select("order_id", "sku_id", "net_sales")
