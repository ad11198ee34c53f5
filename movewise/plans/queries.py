"""The registered queries: each operator over the business model of the driver's tables, with DuckDB SQL.

Segments are analysed by month and weekly queries by region and category, where cells hold enough
lines. All roundings in the SQL are half-to-even, as in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import half_even
from ..operators import clean, decompose, forecast, kpi, mart, signals, validate, variance
from ..sources import invoices, store
from ..sources.testbed import MODEL_SQL, Model
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RC = ["region_code", "category"]


def query(oracle: str | None = None, ctes: str = ""):
    """Registers a function of the model; oracle is its SQL over the model's CTEs."""

    def add(f: Callable[[Model], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if oracle:
            ORACLE[name] = f"WITH {MODEL_SQL}{',' + ctes if ctes else ''} {oracle}"
        return f

    return add


_R = lambda x, p=4: f"(round_even({x}, {p}) + 0.0)"
_D = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18, 2))) AS DOUBLE)"
_L = lambda x: f"CAST(sum({x}) AS BIGINT)"
_Q = lambda a, b: f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"
_WEEK = "CAST(date_trunc('week', date) AS DATE)"
_MONTH = "CAST(date_trunc('month', date) AS DATE)"


def _metrics(grain: list[str], period: str = "") -> str:
    """CTE `m`: commercial metrics at a grain; period is an expression that stands for period_start."""
    keys = ", ".join(grain)
    made = ", ".join(f"{period} AS period_start" if g == "period_start" else g for g in grain)
    return f"""
s_ AS (SELECT {made}, {_D("round_even(units * unit_price, 2)")} AS gross_sales, {_D("net_sales")} AS net_sales, {_L("units")} AS sales_units, count(DISTINCT order_id) AS sales_order_count FROM fact_sales GROUP BY ALL),
o_ AS (SELECT {made}, count(DISTINCT order_id) AS order_count, {_L("ordered_units")} AS ordered_units, {_L("fulfilled_units")} AS fulfilled_units, {_L("cancelled_units")} AS cancelled_units FROM stg_orders GROUP BY ALL),
b_ AS (SELECT {keys}, coalesce(gross_sales, 0) AS gross_sales, coalesce(net_sales, 0) AS net_sales, coalesce(sales_units, 0) AS sales_units, coalesce(sales_order_count, 0) AS sales_order_count, coalesce(order_count, 0) AS order_count,
  coalesce(ordered_units, 0) AS ordered_units, coalesce(fulfilled_units, 0) AS fulfilled_units, coalesce(cancelled_units, 0) AS cancelled_units FROM s_ FULL JOIN o_ USING ({keys})),
m AS (SELECT *, {_R(_Q("fulfilled_units", "ordered_units"))} AS fill_rate, {_R(_Q("cancelled_units", "ordered_units"))} AS cancellation_rate, {_R(_Q("net_sales", "sales_order_count"), 2)} AS aov, {_R("gross_sales - net_sales", 2)} AS discount_value FROM b_)"""


def _summary(dims: list[str], period: str = "month", partial: bool = False) -> str:
    """CTE `m` and `p`: a period summary, complete periods only."""
    start = {"day": "date", "week": _WEEK, "month": _MONTH}[period]
    end = {"day": "period_start", "week": "period_start + 6", "month": "last_day(period_start)"}[period]
    return (
        _metrics(["period_start", *dims], start)
        + f""",
ends AS (SELECT min(date) AS a, max(date) AS z FROM line),
q_ AS (SELECT m.*, '{period}' AS period_type, CAST({end} AS DATE) AS period_end, a, z FROM m, ends),
p AS (SELECT * EXCLUDE (a, z), CAST(period_end - period_start + 1 AS INTEGER) AS expected_days, period_start >= a AND period_end <= z AS is_complete FROM q_ {"" if partial else "WHERE period_start >= a AND period_end <= z"})"""
    )


def _months(m: Model, dims: list[str]) -> DataFrame:
    return mart.summarise_by_period(m.tables(), "month", dims)


# Mart, staging and the analytical SQL.


@query("SELECT * FROM m", _metrics(["date", *RC, "channel", "sales_type"]))
def commercial_mart(m: Model) -> DataFrame:
    return mart.commercial_mart(m.tables())


def _sql(name: str):
    def run(m: Model) -> DataFrame:
        store.build_database(m.spark, m.tables(), check=False, suffix=m.suffix)
        return sql.run_query(m.spark, name, m.suffix)

    run.__name__ = name
    return run


_MART = _metrics(["date", *RC, "channel", "sales_type"]) + ", mart AS (SELECT * FROM m)"
_sql_oracles = {
    "daily_sales_tracker": f"""
, day AS (SELECT date, {_D("net_sales")} AS net_sales, {_L("sales_units")} AS units, sum(ordered_units) AS ordered, sum(fulfilled_units) AS fulfilled FROM mart GROUP BY date),
placed AS (SELECT date, count(DISTINCT order_id) AS orders FROM fact_orders GROUP BY date), plan AS (SELECT date, {_D("sales_target")} AS sales_target FROM fact_targets GROUP BY date)
SELECT date, net_sales, units, orders, {_R(_Q("fulfilled", "ordered"))} AS fill_rate, sales_target, {_R("net_sales - sales_target", 2)} AS target_variance, {_R("(net_sales - sales_target) / nullif(sales_target, 0)")} AS target_variance_pct,
  lag(net_sales) OVER (ORDER BY date) AS prior_day_net_sales, {_R("net_sales - lag(net_sales) OVER (ORDER BY date)", 2)} AS day_over_day_change FROM day JOIN placed USING (date) LEFT JOIN plan USING (date)""",
    "fill_rate_by_segment": f"""
, week AS (SELECT {_WEEK} AS week_start, region_code, category, count(DISTINCT date) AS days_observed, {_L("ordered_units")} AS ordered_units, {_L("fulfilled_units")} AS fulfilled_units FROM mart GROUP BY ALL),
plan AS (SELECT {_WEEK} AS week_start, region_code, category, {_R("avg(fill_rate_target)")} AS fill_rate_target FROM fact_targets GROUP BY ALL)
SELECT week_start, region_code, category, days_observed, ordered_units, fulfilled_units, {_R(_Q("fulfilled_units", "ordered_units"))} AS fill_rate, fill_rate_target, {_R(_Q("fulfilled_units", "ordered_units") + " - fill_rate_target")} AS fill_rate_variance,
  ordered_units - fulfilled_units AS unfulfilled_units FROM week LEFT JOIN plan USING (week_start, region_code, category)""",
    "kam_scorecard": f"""
, sold AS (SELECT kam_id, {_D("net_sales")} AS net_sales FROM fact_sales GROUP BY 1), placed AS (SELECT kam_id, count(DISTINCT order_id) AS orders, sum(ordered_units) AS ordered, sum(fulfilled_units) AS fulfilled FROM stg_orders GROUP BY 1),
quota AS (SELECT kam_id, {_D("sales_target")} AS sales_target, {_L("order_target")} AS order_target FROM fact_kam_targets GROUP BY 1)
SELECT k.kam_id, kam_name, net_sales, sales_target, {_R("net_sales - sales_target", 2)} AS sales_variance, {_R("net_sales / nullif(sales_target, 0)")} AS sales_attainment, orders, order_target, {_R(_Q("fulfilled", "ordered"))} AS fill_rate
FROM dim_kam k LEFT JOIN sold USING (kam_id) LEFT JOIN placed USING (kam_id) LEFT JOIN quota USING (kam_id)""",
    "primary_secondary_mix": f"""
, mo AS (SELECT strftime(date, '%Y-%m') AS month, region_code, CAST(coalesce(sum(CAST(net_sales AS DECIMAL(18, 2))) FILTER (WHERE sales_type = 'PRIMARY'), 0) AS DOUBLE) AS primary_sales,
  CAST(coalesce(sum(CAST(net_sales AS DECIMAL(18, 2))) FILTER (WHERE sales_type = 'SECONDARY'), 0) AS DOUBLE) AS secondary_sales, {_D("net_sales")} AS total_sales FROM mart GROUP BY ALL)
SELECT *, {_R("primary_sales / nullif(total_sales, 0)")} AS primary_mix, {_R("secondary_sales / nullif(total_sales, 0)")} AS secondary_mix FROM mo""",
    "supply_watchlist": f"""
, week AS (SELECT {_WEEK} AS week_start, region_code, category, {_L("ordered_units")} AS ordered_units, {_L("fulfilled_units")} AS fulfilled_units, count(DISTINCT date) AS days_observed FROM mart GROUP BY ALL),
stock AS (SELECT {_WEEK} AS week_start, region_code, category, {_R("avg(available_stock)", 2)} AS available_stock, {_R("avg(stockout_flag)")} AS stockout_rate FROM fact_inventory JOIN dim_sku USING (sku_id) GROUP BY ALL),
bo AS (SELECT *, {_Q("fulfilled_units", "ordered_units")} AS rate FROM week LEFT JOIN stock USING (week_start, region_code, category)),
st AS (SELECT *, lag(rate) OVER w AS prior_rate, lag(ordered_units) OVER w AS prior_ordered_units, lag(available_stock) OVER w AS prior_stock FROM bo WINDOW w AS (PARTITION BY region_code, category ORDER BY week_start))
SELECT week_start, region_code, category, {_R("rate")} AS fill_rate, {_R("prior_rate")} AS prior_fill_rate, {_R("rate - prior_rate")} AS fill_rate_change, ordered_units, prior_ordered_units, {_R(_Q("ordered_units", "prior_ordered_units") + " - 1")} AS demand_change_pct,
  available_stock, {_R("available_stock / nullif(prior_stock, 0) - 1")} AS stock_change_pct, stockout_rate, ordered_units - fulfilled_units AS unfulfilled_units, days_observed
FROM st WHERE rate - prior_rate <= CAST(-0.05 AS DOUBLE) AND {_Q("ordered_units", "prior_ordered_units")} >= CAST(0.95 AS DOUBLE)""",
    "target_variance": f"""
, actual AS (SELECT region_code, category, channel, {_D("net_sales")} AS net_sales FROM mart GROUP BY ALL), plan AS (SELECT region_code, category, channel, {_D("sales_target")} AS sales_target FROM fact_targets GROUP BY ALL)
SELECT region_code, category, channel, coalesce(net_sales, 0) AS net_sales, sales_target, {_R("coalesce(net_sales, 0) - sales_target", 2)} AS variance, {_R("(coalesce(net_sales, 0) - sales_target) / nullif(sales_target, 0)")} AS variance_pct,
  {_R("coalesce(net_sales, 0) / nullif(sales_target, 0)")} AS attainment FROM plan LEFT JOIN actual USING (region_code, category, channel)""",
    "weekly_movers": f"""
, week AS (SELECT {_WEEK} AS week_start, region_code, category, sum(CAST(net_sales AS DECIMAL(18, 2))) AS net, count(DISTINCT date) AS days_observed FROM mart GROUP BY ALL),
st AS (SELECT *, lag(net) OVER (PARTITION BY region_code, category ORDER BY week_start) AS prior FROM week), mv AS (SELECT *, net - prior AS moved FROM st WHERE prior IS NOT NULL)
SELECT week_start, region_code, category, CAST(prior AS DOUBLE) AS prior_net_sales, CAST(net AS DOUBLE) AS net_sales, CAST(moved AS DOUBLE) AS contribution, {_R(_Q("moved", "sum(moved) OVER (PARTITION BY week_start)"))} AS share_of_net_movement,
  {_R(_Q("abs(moved)", "sum(abs(moved)) OVER (PARTITION BY week_start)"))} AS share_of_absolute_movement, days_observed FROM mv""",
}
for _name, _text in _sql_oracles.items():
    QUERIES[_name] = (lambda f: lambda spark, sf_dir: f(Model(spark, sf_dir)))(_sql(_name))
    ORACLE[_name] = f"WITH {MODEL_SQL},{_MART}{_text}"


@query("SELECT * FROM m", _metrics(["date", *RC, "channel", "sales_type"]))
def mart_sql(m: Model) -> DataFrame:
    store.build_database(m.spark, m.tables(), suffix=m.suffix)
    return m.spark.table(f"mart_commercial_daily{m.suffix}")


@query("SELECT category, region_code, count(*) AS rows, CAST(sum(units) AS BIGINT) AS units FROM (SELECT s.* FROM fact_sales s JOIN dim_sku USING (sku_id) JOIN dim_region r ON s.region_code = r.region_code) GROUP BY ALL")
def enrich_sales(m: Model) -> DataFrame:
    return mart.enrich_sales(m.tables()).where("sku_name IS NOT NULL AND kam_name IS NOT NULL AND zone IS NOT NULL").groupBy("category", "region_code").agg(F.count("*").alias("rows"), F.sum("units").alias("units"))


@query("SELECT category, kam_id, count(*) AS rows, CAST(sum(ordered_units) AS BIGINT) AS ordered_units FROM stg_orders GROUP BY ALL")
def enrich_orders(m: Model) -> DataFrame:
    return mart.enrich_orders(m.tables()).groupBy("category", "kam_id").agg(F.count("*").alias("rows"), F.sum("ordered_units").alias("ordered_units"))


# KPIs.

_SALES_KPI = f"""sk AS (SELECT date, count(DISTINCT order_id) AS order_count, {_L("units")} AS units, {_D("round_even(units * unit_price, 2)")} AS gross_sales, {_D("net_sales")} AS net_sales FROM fact_sales GROUP BY date)"""


@query(f"SELECT *, {_R('gross_sales - net_sales', 2)} AS discount_value, {_R(_Q('net_sales', 'order_count'), 2)} AS aov FROM sk", _SALES_KPI)
def sales_kpis(m: Model) -> DataFrame:
    return kpi.sales_kpis(m.fact_sales())


@query(
    f"SELECT *, {_R(_Q('fulfilled_units', 'ordered_units'))} AS fill_rate, CASE WHEN ordered_units > 0 THEN {_Q('cancelled_units', 'ordered_units')} END AS cancellation_rate FROM ok",
    f"ok AS (SELECT date, count(DISTINCT order_id) AS order_count, {_L('ordered_units')} AS ordered_units, {_L('fulfilled_units')} AS fulfilled_units, {_L('cancelled_units')} AS cancelled_units FROM fact_orders GROUP BY date)",
)
def order_kpis(m: Model) -> DataFrame:
    return kpi.order_kpis(m.fact_orders())


_MIX = f"""mx AS (SELECT region_code, {_MONTH} AS period_start, CAST(coalesce(sum(CAST(net_sales AS DECIMAL(18, 2))) FILTER (WHERE sales_type = 'PRIMARY'), 0) AS DOUBLE) AS primary_sales, CAST(coalesce(sum(CAST(net_sales AS DECIMAL(18, 2))) FILTER (WHERE sales_type = 'SECONDARY'), 0) AS DOUBLE) AS secondary_sales FROM fact_sales GROUP BY ALL),
my AS (SELECT *, {_R("primary_sales + secondary_sales", 2)} AS total_sales FROM mx)"""


@query(f"SELECT *, CASE WHEN total_sales > 0 THEN {_R('primary_sales / nullif(total_sales, 0)')} END AS primary_mix, CASE WHEN total_sales > 0 THEN {_R('secondary_sales / nullif(total_sales, 0)')} END AS secondary_mix FROM my", _MIX)
def mix_by_month(m: Model) -> DataFrame:
    return kpi.primary_secondary_mix(mart.with_period(m.fact_sales(), "month"), ["region_code", "period_start"])


@query("SELECT date, period_start FROM (SELECT DISTINCT date, CAST(date_trunc('week', date) AS DATE) AS period_start FROM line)")
def period_labels(m: Model) -> DataFrame:
    return mart.with_period(m.dim_date(), "week").select("date", "period_start")


@query(f"SELECT region_code, period_start, net_sales, lag(net_sales) OVER w AS previous_value, {_R('(net_sales - lag(net_sales) OVER w) / nullif(lag(net_sales) OVER w, 0)')} AS growth FROM p WINDOW w AS (PARTITION BY region_code ORDER BY period_start)", _summary(["region_code"]))
def growth(m: Model) -> DataFrame:
    return kpi.add_growth(_months(m, ["region_code"]).select("region_code", "period_start", "net_sales"), "net_sales", ["region_code"])


@query(
    f"SELECT *, {_R('actual - target', 2)} AS variance, {_R('actual - target', 2)} / nullif(target, 0) AS variance_pct FROM a LEFT JOIN t USING (region_code, category)",
    f"a AS (SELECT region_code, category, {_D('net_sales')} AS actual FROM fact_sales GROUP BY ALL), t AS (SELECT region_code, category, {_D('sales_target')} AS target FROM fact_targets GROUP BY ALL)",
)
def target_variance_kpi(m: Model) -> DataFrame:
    return kpi.target_variance(m.fact_sales(), m.fact_targets(), RC)


# Periods, trends, variances.


@query(
    """SELECT period_start, period_type, period_end, expected_days, period_start >= a AND period_end <= z AS is_complete FROM c2, ends""",
    f"""ends AS (SELECT min(date) AS a, max(date) AS z FROM line), c1 AS (SELECT CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS DATE) AS period_start FROM ends),
c2 AS (SELECT period_start, 'month' AS period_type, last_day(period_start) AS period_end, CAST(last_day(period_start) - period_start + 1 AS INTEGER) AS expected_days FROM c1)""",
)
def period_calendar(m: Model) -> DataFrame:
    return mart.period_calendar(mart.date_range(m.fact_orders()), "month")


@query("SELECT * FROM p", _summary(["region_code"], "week"))
def period_summary_week(m: Model) -> DataFrame:
    return mart.summarise_by_period(m.tables(), "week", ["region_code"])


@query("SELECT * FROM p", _summary(RC, "month", partial=True))
def period_summary_month(m: Model) -> DataFrame:
    return mart.summarise_by_period(m.tables(), "month", RC, include_partial=True)


_TREND = (
    _summary(["region_code"])
    + f""",
t0 AS (SELECT 'net_sales' AS metric, region_code, period_type, period_start, lag(period_start) OVER w AS previous_period_start, CAST(net_sales AS DOUBLE) AS value, CAST(lag(net_sales) OVER w AS DOUBLE) AS previous_value FROM p WINDOW w AS (PARTITION BY region_code ORDER BY period_start)),
t1 AS (SELECT *, {_R("value - previous_value", 6)} AS absolute_change FROM t0 WHERE previous_value IS NOT NULL), tr AS (SELECT *, {_R("absolute_change / nullif(previous_value, 0)")} AS pct_change FROM t1)"""
)


@query("SELECT * FROM tr", _TREND)
def trend_net_sales(m: Model) -> DataFrame:
    return variance.trend(_months(m, ["region_code"]), "net_sales", ["region_code"])


@query("SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY region_code ORDER BY period_start DESC) = 1", _TREND)
def latest_movement(m: Model) -> DataFrame:
    return variance.latest_movement(trend_net_sales(m), ["region_code"])


_VARIANCE = "metric, segment, period_type, period_start, comparison_period, actual, comparison_value, variance, variance_pct, comparison_type, region_code"
_VPREV = _TREND + ", vp AS (SELECT metric, region_code AS segment, period_type, period_start, previous_period_start AS comparison_period, value AS actual, previous_value AS comparison_value, absolute_change AS variance, pct_change AS variance_pct, 'previous_period' AS comparison_type, region_code FROM tr)"
_VTARGET = f""",
vt0 AS (SELECT {_MONTH} AS period_start, region_code, {_D("sales_target")} AS comparison_value FROM fact_targets GROUP BY ALL),
vt1 AS (SELECT 'net_sales' AS metric, region_code AS segment, 'month' AS period_type, period_start, period_start AS comparison_period, net_sales AS actual, comparison_value, {_R("net_sales - comparison_value", 6)} AS variance, region_code FROM p JOIN vt0 USING (period_start, region_code)),
vt AS (SELECT metric, segment, period_type, period_start, comparison_period, actual, comparison_value, variance, {_R("variance / nullif(comparison_value, 0)")} AS variance_pct, 'target' AS comparison_type, region_code FROM vt1)"""


@query(f"SELECT {_VARIANCE} FROM vp", _VPREV)
def variance_prev(m: Model) -> DataFrame:
    return variance.versus_previous(_months(m, ["region_code"]), "net_sales", ["region_code"])


@query(f"SELECT {_VARIANCE} FROM vt", _summary(["region_code"]) + _VTARGET)
def variance_target(m: Model) -> DataFrame:
    return variance.versus_target(_months(m, ["region_code"]), m.fact_targets(), "net_sales", "sales_target", "month", ["region_code"])


@query(f"SELECT {_VARIANCE} FROM vp UNION ALL SELECT {_VARIANCE} FROM vt", _VPREV + _VTARGET)
def combine_variances(m: Model) -> DataFrame:
    return variance.combine(variance_prev(m), variance_target(m))


@query(f"SELECT {_VARIANCE} FROM vp WHERE variance < 0 ORDER BY variance, segment, period_start LIMIT 10", _VPREV)
def rank_variances(m: Model) -> DataFrame:
    return variance.rank(variance_prev(m))


_SERIES = f"""
ds AS (SELECT date, {_D("net_sales")} AS net_sales, {_L("units")} AS units FROM fact_sales GROUP BY date), dp AS (SELECT date, count(DISTINCT order_id) AS orders FROM fact_orders GROUP BY date),
cal AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) AS a, max(date) AS z FROM line)),
ser AS (SELECT date, coalesce(net_sales, 0.0) AS net_sales, coalesce(units, 0) AS units, coalesce(orders, 0) AS orders FROM cal LEFT JOIN ds USING (date) LEFT JOIN dp USING (date))"""


def _daily(m: Model) -> DataFrame:
    return forecast.daily_series(m.fact_sales(), m.fact_orders())


@query("SELECT * FROM ser", _SERIES)
def daily_series(m: Model) -> DataFrame:
    return _daily(m)


def _backtest_sql(initial: int, step: int, horizon: int, last: bool = False) -> str:
    origins = f"[len(ys) - {horizon}]" if last else f"range({initial}, len(ys) - {horizon} + 1, {step})"
    mean = lambda x: f"(list_reduce({x}, lambda a, b: a + b) / len({x}))"
    ses = "list_reduce(list_transform(h, lambda y: {'level': y, 'sse': CAST(0 AS DOUBLE), 'y': y}), lambda a, b: {'level': al * b.y + (1 - al) * a.level, 'sse': a.sse + (b.y - a.level) * (b.y - a.level), 'y': b.y})"
    return (
        _SERIES
        + f""",
pk AS (SELECT list(CAST(orders AS DOUBLE) ORDER BY date) AS ys, list(date ORDER BY date) AS ds_ FROM ser),
fo AS (SELECT ys, ds_, unnest({origins}) AS o, generate_subscripts({origins}, 1) AS fold FROM pk),
fh AS (SELECT CAST(fold AS INTEGER) AS fold, o, ds_[o] AS origin_date, ys[o + 1:o + {horizon}] AS fy, ds_[o + 1:o + {horizon}] AS fd, ys[1:o] AS h FROM fo),
gr AS (SELECT fold, i / CAST(20 AS DOUBLE) AS al, h FROM fh, range(1, 20) t(i)), gs AS (SELECT fold, al, {ses} AS r FROM gr),
best AS (SELECT fold, arg_min(r.level, struct_pack(s := r.sse, a := al)) AS level FROM gs GROUP BY fold),
stp AS (SELECT fh.*, level, CAST(s AS BIGINT) AS s FROM fh JOIN best USING (fold), range(0, {horizon}) t(s)),
pr AS (SELECT fold, origin_date, fd[s + 1] AS date, fy[s + 1] AS actual, h[o] AS naive, {mean("h[o - 6:o]")} AS moving_average_7, level AS ses, h[o - 7 + s % 7 + 1] AS seasonal_naive_7,
  {mean("list_transform(range((o + s) % 7, o, 7), lambda i: h[i + 1])")} AS seasonal_mean_7 FROM stp),
bt AS (UNPIVOT pr ON naive, moving_average_7, ses, seasonal_naive_7, seasonal_mean_7 INTO NAME model VALUE forecast)"""
    )


_SCORES = f"""
sc0 AS (SELECT model, count(*) AS n, count(DISTINCT fold) AS folds, sum(abs(forecast - actual)) AS ae, sum((forecast - actual) * (forecast - actual)) AS se, sum(abs(actual)) AS ab, sum(CASE WHEN abs(actual) > 0 THEN abs(forecast - actual) / abs(actual) END) AS pe, min(abs(actual)) AS low, sum(forecast - actual) AS er FROM bt GROUP BY model),
sc AS (SELECT model, n, folds, {_R("ae / n")} AS mae, {_R("sqrt(se / n)")} AS rmse, {_R("ae / nullif(ab, 0)")} AS wape, CASE WHEN low > 0 AND low >= CAST(0.01 AS DOUBLE) * ab / n THEN {_R("pe / n")} END AS mape, {_R("er / n")} AS bias FROM sc0)"""


def _backtest(m: Model) -> DataFrame:
    return forecast.backtest(forecast.extract_metric(_daily(m), "orders"), horizon=7, initial=56, step=14)


@query("SELECT model, fold, origin_date, date, actual, forecast FROM bt", _backtest_sql(56, 14, 7))
def backtest_predictions(m: Model) -> DataFrame:
    return _backtest(m)


@query("SELECT * FROM sc", _backtest_sql(56, 14, 7) + "," + _SCORES)
def backtest_summary(m: Model) -> DataFrame:
    return forecast.scores(_backtest(m))


class Drift(forecast.Forecaster):
    """The last value, and on along the line from the first one: a forecaster as a user would write it."""

    def fit(self, y):
        self.last, self.slope = y.iloc[-1], (y.iloc[-1] - y.iloc[0]) / (len(y) - 1)
        return self

    def predict(self, horizon):
        return [self.last + self.slope * (k + 1) for k in range(horizon)]


_DRIFT = """
rd AS (SELECT coalesce(a.region_code, b.region_code) AS region_code, coalesce(a.date, b.date) AS date, coalesce(orders, 0) AS orders FROM (SELECT DISTINCT region_code, date FROM fact_sales) a FULL JOIN (SELECT region_code, date, count(DISTINCT order_id) AS orders FROM line GROUP BY 1, 2) b ON a.region_code = b.region_code AND a.date = b.date),
rc AS (SELECT region_code, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM rd GROUP BY 1),
ry AS (SELECT region_code, date, CAST(coalesce(orders, 0) AS DOUBLE) AS y, CAST(row_number() OVER (PARTITION BY region_code ORDER BY date) AS INTEGER) AS n, count(*) OVER (PARTITION BY region_code) AS t, first_value(coalesce(orders, 0)) OVER (PARTITION BY region_code ORDER BY date) AS y1 FROM rc LEFT JOIN rd USING (region_code, date)),
ro AS (SELECT *, CAST((n - 56) / 28 AS INTEGER) + 1 AS fold FROM ry WHERE n >= 56 AND (n - 56) % 28 = 0 AND n <= t - 7),
rf AS (SELECT o.region_code, o.fold, o.date AS origin_date, a.date, a.y AS actual, round_even(o.y + ((o.y - o.y1) / (o.n - 1)) * (a.n - o.n), 6) + 0.0 AS drift, round_even(o.y, 6) + 0.0 AS naive FROM ro o JOIN ry a ON a.region_code = o.region_code AND a.n > o.n AND a.n <= o.n + 7)"""


@query("SELECT region_code, 'drift' AS model, fold, origin_date, date, actual, drift AS forecast FROM rf UNION ALL SELECT region_code, 'naive', fold, origin_date, date, actual, naive FROM rf", _DRIFT)
def backtest_of_a_users_model(m: Model) -> DataFrame:
    """Daily orders of each region, forecast by a Python class beside a column model."""
    daily = forecast.daily_series(m.fact_sales(), m.fact_orders(), ["region_code"])
    tested = forecast.backtest(forecast.extract_metric(daily, "orders", ["region_code"]), {"drift": Drift(), "naive": forecast.naive}, 7, 56, 28, ["region_code"])
    return tested.withColumn("forecast", half_even("forecast", 6))


@query(f"SELECT *, {_R('((SELECT wape FROM sc WHERE model = ' + chr(39) + 'naive' + chr(39) + ') - wape) / nullif((SELECT wape FROM sc WHERE model = ' + chr(39) + 'naive' + chr(39) + '), 0)')} AS wape_gain FROM sc", _backtest_sql(56, 14, 7) + "," + _SCORES)
def vs_baseline(m: Model) -> DataFrame:
    return forecast.against_baseline(backtest_summary(m))


@query("SELECT model, fold, origin_date, date, actual, forecast FROM bt", _backtest_sql(0, 1, 14, last=True))
def holdout(m: Model) -> DataFrame:
    return forecast.holdout(forecast.extract_metric(_daily(m), "orders"), days=14)


@query("SELECT date AS period_start, 'orders' AS metric, 'TOTAL' AS segment, 'day' AS period_type, date AS comparison_period, actual, forecast AS comparison_value, " + _R("actual - forecast", 6) + " AS variance, " + _R(_R("actual - forecast", 6) + " / nullif(forecast, 0)") + " AS variance_pct, 'forecast' AS comparison_type FROM bt WHERE model = 'seasonal_mean_7'", _backtest_sql(0, 1, 14, last=True))
def variance_forecast(m: Model) -> DataFrame:
    plan = holdout(m).where("model = 'seasonal_mean_7'")
    return variance.versus_forecast(plan.select("date", F.col("actual").alias("value")), plan.select("date", "forecast"), "orders")


# Decomposition. The two latest complete months.

_TWO = "tw AS (SELECT max(period_start) AS c1, max(period_start) FILTER (WHERE period_start < (SELECT max(period_start) FROM p)) AS c0 FROM p)"


def _finished(dims: str, segment: str, metric: str, source: str, extra: str) -> str:
    return f"""SELECT '{metric}' AS metric, '{dims}' AS dimension, {segment} AS segment, c1 AS period_start, c0 AS comparison_period, contribution,
  CASE WHEN net <> 0 AND abs(net) >= CAST(0.05 AS DOUBLE) * gross THEN {_R("contribution / nullif(net, 0)")} END AS contribution_share, CASE WHEN gross > 0 THEN {_R("abs(contribution) / nullif(gross, 0)")} END AS share_of_absolute_movement, {extra}
FROM (SELECT *, {_R("sum(contribution) OVER ()", 10)} AS net, {_R("sum(abs(contribution)) OVER ()", 10)} AS gross FROM {source}), tw"""


def _additive_sql(dims: list[str]) -> str:
    at = lambda k, n: f"CAST(coalesce(sum(CASE WHEN period_start = c{k} THEN net_sales END), 0) AS DOUBLE) AS {n}"
    return _summary(dims) + f", {_TWO}, ad0 AS (SELECT {', '.join(dims)}, {at(0, 'previous_value')}, {at(1, 'current_value')} FROM p, tw WHERE period_start IN (c0, c1) GROUP BY {', '.join(dims)}), ad AS (SELECT *, {_R('current_value - previous_value', 6)} AS contribution FROM ad0)"


_ADDITIVE = _additive_sql(RC) + ", dec AS (" + _finished("region_code | category", "region_code || ' | ' || category", "net_sales", "ad", "region_code, category, previous_value, current_value") + ")"


@query("SELECT * FROM dec", _ADDITIVE)
def decompose_additive(m: Model) -> DataFrame:
    return decompose.decompose_additive(_months(m, RC), "net_sales", RC)


def _rate_sql(base: str, dims: list[str], top: str, bottom: str, metric: str, fold: str = "") -> str:
    keys = ", ".join(dims)
    at = lambda c, k, n: f"CAST(coalesce(sum(CASE WHEN period_start = c{k} THEN {c} END), 0) AS DOUBLE) AS {n}"
    out = base + f", {_TWO}, ra AS (SELECT {keys}, {at(top, 0, 'n0')}, {at(top, 1, 'n1')}, {at(bottom, 0, 'd0')}, {at(bottom, 1, 'd1')} FROM p, tw WHERE period_start IN (c0, c1) GROUP BY {keys})"
    source = "ra"
    if fold:
        out += f""", rf AS (SELECT *, coalesce(d0 / nullif(sum(d0) OVER (), 0) < CAST({fold} AS DOUBLE) AND d1 / nullif(sum(d1) OVER (), 0) < CAST({fold} AS DOUBLE), false) AS thin FROM ra), rg AS (SELECT *, sum(CASE WHEN thin THEN 1 ELSE 0 END) OVER () AS many FROM rf),
rh AS (SELECT {", ".join(f"CASE WHEN thin AND many >= 2 THEN 'Other (below volume floor)' ELSE {d} END AS {d}" for d in dims)}, n0, n1, d0, d1 FROM rg), ri AS (SELECT {keys}, sum(n0) AS n0, sum(n1) AS n1, sum(d0) AS d0, sum(d1) AS d1 FROM rh GROUP BY {keys})"""
        source = "ri"
    out += f""", rb AS (SELECT *, d0 / nullif(sum(d0) OVER (), 0) AS w0, d1 / nullif(sum(d1) OVER (), 0) AS w1, n0 / nullif(d0, 0) AS previous_value, n1 / nullif(d1, 0) AS current_value FROM {source}),
rc AS (SELECT *, coalesce(previous_value, current_value, 0) AS r0, coalesce(current_value, previous_value, 0) AS r1 FROM rb),
rd AS (SELECT *, {_R("w0 * (r1 - r0)", 10)} AS rate_effect, {_R("(w1 - w0) * r0", 10)} AS mix_effect, {_R("(w1 - w0) * (r1 - r0)", 10)} AS interaction_effect, {_R("w1 * r1 - w0 * r0", 10)} AS contribution FROM rc)"""
    return out + ", dec AS (" + _finished(" | ".join(dims), " || ' | ' || ".join(dims), metric, "rd", f"{keys}, rate_effect, mix_effect, interaction_effect, previous_value, current_value") + ")"


_RATE = _rate_sql(_summary(RC), RC, "fulfilled_units", "ordered_units", "fill_rate")


@query("SELECT * FROM dec", _RATE)
def decompose_rate(m: Model) -> DataFrame:
    return decompose.decompose_rate(_months(m, RC), "fill_rate", RC)


@query("SELECT * FROM dec", _rate_sql(_summary(RC), RC, "fulfilled_units", "ordered_units", "fill_rate", "0.03"))
def decompose_rate_folded(m: Model) -> DataFrame:
    return decompose.decompose_rate(_months(m, RC), "fill_rate", RC, min_share=0.03)


_RETURNS = f"""
rs AS (SELECT {_MONTH} AS period_start, category, {_L("units")} AS sold_units FROM fact_sales GROUP BY ALL), rr AS (SELECT {_MONTH} AS period_start, category, {_L("returned_units")} AS returned_units FROM sold_back GROUP BY ALL),
rj AS (SELECT period_start, category, coalesce(sold_units, 0) AS sold_units, coalesce(returned_units, 0) AS returned_units FROM rs FULL JOIN rr USING (period_start, category)),
re AS (SELECT min(d) AS a, max(d) AS z FROM (SELECT date AS d FROM fact_sales UNION ALL SELECT date FROM sold_back)),
rp AS (SELECT *, {_R(_Q("returned_units", "sold_units"))} AS return_rate, 'month' AS period_type, last_day(period_start) AS period_end, CAST(last_day(period_start) - period_start + 1 AS INTEGER) AS expected_days FROM rj),
p AS (SELECT rp.*, period_start >= a AND period_end <= z AS is_complete FROM rp, re WHERE period_start >= a AND period_end <= z)"""


@query("SELECT * FROM p", _RETURNS)
def returns_by_period(m: Model) -> DataFrame:
    return mart.returns_by_period(m.fact_sales(), m.returns(), "month", ["category"])


@query("SELECT * FROM dec", _rate_sql(_RETURNS, ["category"], "returned_units", "sold_units", "return_rate"))
def return_rate_split(m: Model) -> DataFrame:
    return decompose.decompose_rate(returns_by_period(m), "return_rate", ["category"])


_COHERENCE = (
    _RATE
    + f""", lo AS (UNPIVOT (SELECT rate_effect, mix_effect, interaction_effect FROM dec) ON rate_effect, mix_effect, interaction_effect INTO NAME component VALUE e),
co AS (SELECT component, {_R("sum(e)", 6)} AS net, {_R("sum(abs(e))", 6)} AS gross, {_R("abs(sum(e)) / nullif(sum(abs(e)), 0)")} AS coherence FROM lo GROUP BY component)"""
)


@query(f"SELECT *, {_R('abs(net) / nullif(' + _R('sum(abs(net)) OVER ()', 6) + ', 0)')} AS share_of_net_movement FROM co", _COHERENCE)
def coherence(m: Model) -> DataFrame:
    return decompose.coherence(decompose_rate(m))


_TOP3 = f"{_R(_R('sum(CASE WHEN rn <= 3 THEN a END)', 10) + ' / nullif(' + _R('sum(a)', 10) + ', 0)')}"


@query(f"SELECT {_TOP3} AS concentration FROM (SELECT abs(contribution) AS a, row_number() OVER (ORDER BY abs(contribution) DESC, segment) AS rn FROM dec)", _ADDITIVE)
def concentration(m: Model) -> DataFrame:
    return decompose.concentration(decompose_additive(m))


@query("SELECT CAST(row_number() OVER (ORDER BY contribution, segment) AS INTEGER) AS rank, 'contribution' AS ranked_by, * FROM dec WHERE contribution < 0 ORDER BY contribution, segment LIMIT 5", _ADDITIVE)
def rank_drivers(m: Model) -> DataFrame:
    return decompose.rank_drivers(decompose_additive(m))


def _cut_sql(dim: str) -> str:
    return f"""(WITH {_additive_sql([dim])}, dec AS ({_finished(dim, dim, "net_sales", "ad", "previous_value")}), rk AS (SELECT *, abs(contribution) AS a, row_number() OVER (ORDER BY abs(contribution) DESC, segment DESC) AS rm, row_number() OVER (ORDER BY abs(contribution) DESC, segment) AS rn FROM dec)
SELECT '{dim}' AS dimension, count(*) AS segments, {_R("sum(contribution)")} AS total_movement, max(segment) FILTER (WHERE rm = 1) AS top_segment, {_R("max(contribution) FILTER (WHERE rm = 1)")} AS top_contribution, max(share_of_absolute_movement) FILTER (WHERE rm = 1) AS top_share_of_absolute_movement, {_TOP3} AS top_3_concentration FROM rk)"""


@query(f"SELECT * FROM {_cut_sql('region_code')} UNION ALL SELECT * FROM {_cut_sql('category')} UNION ALL SELECT * FROM {_cut_sql('channel')}")
def compare_dimensions(m: Model) -> DataFrame:
    cuts = ["region_code", "category", "channel"]
    cells = mart.Summaries(m.tables(), cuts)
    return decompose.compare_dimensions({c: cells.by("month", [c]) for c in cuts}, "net_sales", [[c] for c in cuts])


@query(
    "SELECT CASE WHEN k > 3 AND n >= 3 THEN 'Other' ELSE category END AS category, region_code, net_sales FROM (SELECT region_code, category, net_sales FROM ad1) JOIN (SELECT category, row_number() OVER (ORDER BY abs(t) DESC, category) AS n, count(*) OVER () AS k FROM (SELECT category, sum(net_sales) AS t FROM ad1 GROUP BY category)) USING (category)",
    f"ad1 AS (SELECT region_code, category, {_D('net_sales')} AS net_sales FROM fact_sales GROUP BY ALL)",
)
def fold_small_series(m: Model) -> DataFrame:
    from ..functions.exprs import money_sum

    return decompose.fold_small(m.fact_sales().groupBy(*RC).agg(money_sum("net_sales").alias("net_sales")), "category", "net_sales", 3)


@query(
    "SELECT region_code, fill_rate, fill_rate_target, CASE WHEN g IS NULL THEN 'No demand' WHEN g >= 0 THEN 'On target' WHEN g >= CAST(-0.05 AS DOUBLE) THEN 'Slightly below' WHEN g >= CAST(-0.15 AS DOUBLE) THEN 'Below target' ELSE 'Well below' END AS status, period_start FROM (SELECT *, fill_rate - fill_rate_target AS g FROM p JOIN st USING (period_start, region_code))",
    _summary(["region_code"]) + f", st AS (SELECT {_MONTH} AS period_start, region_code, {_R('avg(fill_rate_target)', 6)} AS fill_rate_target FROM fact_targets GROUP BY ALL)",
)
def service_status(m: Model) -> DataFrame:
    plan = mart.with_period(m.fact_targets(), "month").groupBy("period_start", "region_code").agg(half_even(F.avg("fill_rate_target"), 6).alias("fill_rate_target"))
    return _months(m, ["region_code"]).join(plan, ["period_start", "region_code"]).select("period_start", "region_code", "fill_rate", "fill_rate_target", decompose.service_status("fill_rate", "fill_rate_target").alias("status"))


# Signals.

_INVENTORY = f"""iv AS (SELECT {_MONTH} AS period_start, region_code, category, {_R("avg(opening_stock)", 2)} AS opening_stock, {_R("avg(available_stock)", 2)} AS available_stock, {_L("received_units")} AS received_units, {_L("ordered_units")} AS ordered_units, {_L("fulfilled_units")} AS fulfilled_units, {_R("avg(stockout_flag)")} AS stockout_rate FROM fact_inventory JOIN dim_sku USING (sku_id) GROUP BY ALL)"""


def _stock(m: Model) -> DataFrame:
    return mart.inventory_by_period(m.fact_inventory(), m.dim_sku(), "month", RC)


@query("SELECT * FROM iv", _INVENTORY)
def inventory_by_period(m: Model) -> DataFrame:
    return _stock(m)


_NAMES = [*signals.COMMERCIAL, *signals.RATES, *signals.STOCK]


def _evidence_sql() -> str:
    at = lambda n, k, s: f"CAST(max(CASE WHEN period_start = c{k} THEN {n} END) AS DOUBLE) AS {n}_{s}"
    pick = lambda names: ", ".join(at(n, k, s) for n in names for k, s in ((0, "before"), (1, "after")))
    zero = lambda n: ", ".join(f"{n}_{s}" if n in signals.RATES else f"coalesce({n}_{s}, 0) AS {n}_{s}" for s in ("before", "after"))

    def direction(n: str) -> str:
        b, a = f"{n}_before", f"{n}_after"
        moved = f"CASE WHEN {a} - {b} > 0 THEN 'up' WHEN {a} - {b} < 0 THEN 'down' ELSE 'flat' END"
        return f"CASE WHEN {b} IS NULL OR {a} IS NULL THEN 'unknown' WHEN {b} = 0 THEN {moved} WHEN abs(({a} - {b}) / nullif(abs({b}), 0)) < CAST(0.05 AS DOUBLE) THEN 'flat' ELSE {moved} END AS {n}_dir"

    return f"""
ev0 AS (SELECT region_code, category, {pick(signals.COMMERCIAL + signals.RATES)} FROM p, tw WHERE period_start IN (c0, c1) GROUP BY 1, 2), ev1 AS (SELECT region_code, category, {pick(signals.STOCK)} FROM iv, tw WHERE period_start IN (c0, c1) GROUP BY 1, 2),
ev2 AS (SELECT region_code, category, {", ".join(map(zero, _NAMES))} FROM ev0 LEFT JOIN ev1 USING (region_code, category)), ev AS (SELECT *, {", ".join(map(direction, _NAMES))} FROM ev2)"""


_EVIDENCE = _summary(RC) + f", {_TWO}, {_INVENTORY}, {_evidence_sql()}"
_EV_ROWS = " UNION ALL ".join(f"SELECT region_code, category, '{n}' AS observation, {n}_before AS before, {n}_after AS after, {_R(f'{n}_after - {n}_before', 6)} AS change, {_R(f'({n}_after - {n}_before) / nullif(abs({n}_before), 0)')} AS change_pct, {n}_dir AS direction FROM ev" for n in _NAMES)


@query(_EV_ROWS, _EVIDENCE)
def segment_evidence(m: Model) -> DataFrame:
    summary = _months(m, RC)
    return signals.evidence_rows(signals.evidence(summary, RC, *decompose.resolve_periods(summary), _stock(m)), RC)


_STREAK = """sg AS (SELECT region_code, category, period_start, sign(net_sales - lag(net_sales) OVER (PARTITION BY region_code, category ORDER BY period_start)) AS s FROM p),
sh AS (SELECT *, first_value(s) OVER w AS l, row_number() OVER w AS rn FROM sg WHERE s IS NOT NULL WINDOW w AS (PARTITION BY region_code, category ORDER BY period_start DESC)),
si AS (SELECT *, sum(CASE WHEN s <> l THEN 1 ELSE 0 END) OVER (PARTITION BY region_code, category ORDER BY rn) AS broken FROM sh), stk AS (SELECT region_code, category, CAST(sum(CASE WHEN broken = 0 AND l <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS streak FROM si GROUP BY 1, 2)"""
_SWING = f"""sw0 AS (SELECT region_code, category, abs(net_sales - lag(net_sales) OVER (PARTITION BY region_code, category ORDER BY period_start)) AS d FROM p), sw AS (SELECT region_code, category, CASE WHEN count(*) >= 3 AND quantile_cont(d, 0.5) > 0 THEN {_R("quantile_cont(d, 0.5)", 6)} END AS typical FROM sw0 GROUP BY 1, 2)"""


@query("SELECT * FROM stk", _summary(RC) + "," + _STREAK)
def persistence(m: Model) -> DataFrame:
    summary = _months(m, RC)
    return signals.persistence(summary, "net_sales", RC, decompose.resolve_periods(summary)[0])


@query("SELECT * FROM sw", _summary(RC) + "," + _SWING)
def typical_swing(m: Model) -> DataFrame:
    return signals.typical_swing(_months(m, RC), "net_sales", RC)


_PRICE = "coalesce(net_sales_after / nullif(fulfilled_units_after, 0), 0)"
_SHORT = _R(f"greatest(0, ordered_units_after * least(greatest(fill_rate_before, 0), 1) - fulfilled_units_after) * {_PRICE}", 2)


def _ev(m: Model) -> DataFrame:
    summary = _months(m, RC)
    return signals.evidence(summary, RC, *decompose.resolve_periods(summary))


@query(f"SELECT region_code, category, {_SHORT} AS impact FROM ev WHERE fill_rate_before IS NOT NULL", _EVIDENCE)
def shortfall_impact(m: Model) -> DataFrame:
    c = F.col
    return _ev(m).where("fill_rate_before IS NOT NULL").select(*RC, signals.shortfall(c("ordered_units_after"), c("fulfilled_units_after"), c("fill_rate_before"), c("net_sales_after")).alias("impact"))


@query(f"SELECT region_code, category, {_R(f'greatest(0, ordered_units_after - fulfilled_units_after) * {_PRICE}', 2)} AS impact FROM ev", _EVIDENCE)
def unfulfilled_impact(m: Model) -> DataFrame:
    c = F.col
    return _ev(m).select(*RC, signals.unfulfilled(c("ordered_units_after"), c("fulfilled_units_after"), c("net_sales_after")).alias("impact"))


_B = lambda x: f"coalesce({x}, false)"
_LAG = "(fill_rate_dir = 'down' OR (fulfilled_units_dir = 'down' AND ordered_units_dir IN ('up', 'flat')))"
_SIGNALS = (
    _EVIDENCE
    + f""", {_STREAK}, {_SWING},
ad0 AS (SELECT region_code, category, CAST(coalesce(sum(CASE WHEN period_start = c0 THEN net_sales END), 0) AS DOUBLE) AS pv, CAST(coalesce(sum(CASE WHEN period_start = c1 THEN net_sales END), 0) AS DOUBLE) AS cv FROM p, tw WHERE period_start IN (c0, c1) GROUP BY 1, 2),
ad1 AS (SELECT *, {_R("cv - pv", 6)} AS contribution, region_code || ' | ' || category AS segment FROM ad0), ad2 AS (SELECT *, {_R("sum(abs(contribution)) OVER ()", 10)} AS gross FROM ad1),
ld AS (SELECT *, {_R("abs(contribution) / nullif(gross, 0)")} AS share FROM ad2 WHERE contribution < 0 ORDER BY contribution, segment LIMIT 5),
ow AS (SELECT region_code, category, CAST(max(CASE WHEN period_start = c0 THEN net_sales END) AS DOUBLE) AS vb, CAST(max(CASE WHEN period_start = c1 THEN net_sales END) AS DOUBLE) AS va FROM p, tw GROUP BY 1, 2),
x0 AS (SELECT * FROM ld LEFT JOIN ev USING (region_code, category) LEFT JOIN ow USING (region_code, category) LEFT JOIN stk USING (region_code, category) LEFT JOIN sw USING (region_code, category)),
x1 AS (SELECT *, CASE WHEN {_LAG} THEN 'fulfilment_constraint' WHEN ordered_units_dir = 'down' THEN 'demand_softness' ELSE 'unclassified' END AS likely_driver,
  CASE WHEN {_LAG} THEN NOT (ordered_units_dir IN ('up', 'flat')) WHEN ordered_units_dir = 'down' THEN available_stock_dir = 'down' OR stockout_rate_dir = 'up' END AS alternative_supported,
  CAST(CASE WHEN {_LAG} THEN 2 + CAST(available_stock_dir = 'down' AS INTEGER) + CAST(stockout_rate_dir = 'up' AS INTEGER) WHEN ordered_units_dir = 'down' THEN 1 + CAST(fulfilled_units_dir = 'down' AS INTEGER) + CAST(available_stock_dir IN ('up', 'flat') AS INTEGER) ELSE 0 END AS INTEGER) AS corroborating,
  CASE WHEN fill_rate_before IS NOT NULL THEN {_SHORT} END AS impact FROM x0),
x2 AS (SELECT *, {_B("abs(va - vb) >= CAST(1.5 AS DOUBLE) * typical")} AS movement_is_material, {_B("streak >= 2")} AS movement_persisted, {_B("share >= CAST(0.15 AS DOUBLE)")} AS segment_carries_the_movement, corroborating >= 2 AS other_metrics_agree, {_B("NOT alternative_supported")} AS alternative_not_supported, true AS movement_is_directional FROM x1),
x3 AS (SELECT *, CAST(movement_is_material AS INTEGER) + CAST(movement_persisted AS INTEGER) + CAST(segment_carries_the_movement AS INTEGER) + CAST(other_metrics_agree AS INTEGER) + CAST(alternative_not_supported AS INTEGER) + CAST(movement_is_directional AS INTEGER) AS criteria_met FROM x2),
x4 AS (SELECT *, CASE WHEN criteria_met >= 5 THEN 'high' WHEN criteria_met >= 3 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN criteria_met >= 5 THEN CAST(1 AS DOUBLE) WHEN criteria_met >= 3 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS weight FROM x3)"""
)


@query(
    f"""SELECT 'net_sales' AS metric, 'region_code | category' AS dimension, segment, c1 AS period, c0 AS comparison_period, {_R("va - vb")} AS movement, {_R("(va - vb) / nullif(abs(vb), 0)")} AS movement_pct, contribution, share AS share_of_absolute_movement, 'contribution' AS ranked_by,
likely_driver, alternative_supported, corroborating, impact, movement_is_material, movement_persisted, segment_carries_the_movement, other_metrics_agree, alternative_not_supported, movement_is_directional, criteria_met, confidence, {_R("coalesce(abs(impact), 0) * weight", 2)} AS priority_score FROM x4, tw""",
    _SIGNALS,
)
def detect_signals(m: Model) -> DataFrame:
    return signals.detect(_months(m, RC), "net_sales", RC, _stock(m), top_n=5).drop("recommended_investigation", "inventory_note")


# Validation, cleaning, adapters.


@query("""SELECT * FROM (
  SELECT 'fact_sales' AS "table", 'duplicate_key' AS "check", 'ERROR' AS severity, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM fact_sales GROUP BY order_id, sku_id, sales_type HAVING count(*) > 1)
  UNION ALL SELECT 'fact_orders', 'duplicate_key', 'ERROR', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM fact_orders GROUP BY order_id, sku_id, sales_type HAVING count(*) > 1)
  UNION ALL SELECT 'fact_inventory', 'fk_date', 'ERROR', count(*) FROM fact_inventory WHERE date NOT IN (SELECT date FROM dim_date)
  UNION ALL SELECT 'fact_targets', 'fk_date', 'ERROR', count(*) FROM fact_targets WHERE date NOT IN (SELECT date FROM dim_date)
  UNION ALL SELECT 'fact_kam_targets', 'fk_date', 'ERROR', count(*) FROM fact_kam_targets WHERE date NOT IN (SELECT date FROM dim_date)
) WHERE rows > 0""")
def validate_issues(m: Model) -> DataFrame:
    return validate.validate(m.spark, m.tables())


def _damaged(m: Model, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The model, or tables made of it, with planted defects, by plain arithmetic on keys."""
    t = tables or m.tables()
    k = (F.col("order_id") * 31 + F.col("sku_id")) % 97
    sales = t["fact_sales"].withColumns({"discount_pct": F.when(k != 1, F.col("discount_pct")), "unit_price": F.when(k == 2, F.lit(None).cast("double")).when(k == 3, F.lit(0.0)).otherwise(F.col("unit_price")), "units": F.when(k == 4, F.lit(0).cast("long")).otherwise(F.col("units"))})
    sales = sales.unionByName(sales.where((F.col("order_id") * 31 + F.col("sku_id")) % 97 == 7))  # repeated rows
    orders = t["fact_orders"].withColumns({"fulfilled_units": F.when(k == 5, F.col("ordered_units") + 1).otherwise(F.col("fulfilled_units")), "channel": F.when(k != 6, F.col("channel"))})
    return t | {"fact_sales": sales, "fact_orders": orders, "fact_kam_targets": t["fact_kam_targets"].unionByName(t["fact_kam_targets"].where("kam_id = 'K1'"))}


_DAMAGED = """
dk AS (SELECT *, (order_id * 31 + sku_id) % 97 AS k FROM fact_sales), dx AS (SELECT order_id, date, customer_id, region_code, channel, kam_id, sku_id, category, sales_type, CASE WHEN k = 4 THEN 0 ELSE units END AS units, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN 0.0 ELSE unit_price END AS unit_price, CASE WHEN k <> 1 THEN discount_pct END AS discount_pct, net_sales FROM (SELECT * FROM dk UNION ALL SELECT * FROM dk WHERE k = 7)),
du AS (SELECT DISTINCT * FROM dx), ok_ AS (SELECT *, (order_id * 31 + sku_id) % 97 AS k FROM line)"""


@query(
    """SELECT * FROM (
  SELECT 'fact_sales' AS "table", 'drop_exact_duplicates' AS action, (SELECT count(*) FROM dx) - (SELECT count(*) FROM du) AS rows, 'whole rows' AS detail
  UNION ALL SELECT 'fact_sales', 'impute_discount_pct', (SELECT count(*) FROM du WHERE discount_pct IS NULL), 'null becomes 0'
  UNION ALL SELECT 'fact_sales', 'impute_unit_price', (SELECT count(*) FROM du WHERE unit_price IS NULL), 'from dim_sku.list_price'
  UNION ALL SELECT 'fact_sales', 'quarantine_unsellable_lines', (SELECT count(*) FROM du WHERE unit_price <= 0 OR units <= 0), 'price or units not positive'
  UNION ALL SELECT 'fact_orders', 'impute_channel', (SELECT count(*) FROM ok_ WHERE k = 6), 'from dim_customer.channel'
  UNION ALL SELECT 'fact_orders', 'quarantine_invalid_quantities', (SELECT count(*) FROM ok_ WHERE k = 5), 'fulfilled above ordered'
  UNION ALL SELECT 'fact_kam_targets', 'drop_duplicate_key', (SELECT count(*) FROM fact_kam_targets WHERE kam_id = 'K1'), 'first row kept'
) WHERE rows > 0""",
    _DAMAGED,
)
def clean_audit(m: Model) -> DataFrame:
    return clean.clean(m.spark, _damaged(m)).audit


@query("SELECT region_code, category, count(*) AS rows, CAST(sum(units) AS BIGINT) AS units FROM du WHERE unit_price <= 0 OR units <= 0 GROUP BY ALL", _DAMAGED)
def quarantine(m: Model) -> DataFrame:
    return clean.clean(m.spark, _damaged(m)).quarantined["fact_sales"].groupBy(*RC).agg(F.count("*").alias("rows"), F.sum("units").alias("units"))


@query("SELECT order_id, sku_id, sales_type, CAST(sum(units) AS BIGINT) AS units, CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) AS net_sales, " + _R("CAST(sum(CAST(net_sales AS DECIMAL(18, 2))) AS DOUBLE) / nullif(sum(units), 0)") + " AS unit_price FROM fact_sales GROUP BY ALL")
def repeated_lines(m: Model) -> DataFrame:
    lines = m.fact_sales().select("order_id", "sku_id", "sales_type", "units", "unit_price", "net_sales").withColumn("_row", F.monotonically_increasing_id())
    return invoices.consolidated(lines).select("order_id", "sku_id", "sales_type", "units", "net_sales", "unit_price")


@query("SELECT DISTINCT date, CAST(weekofyear(date) AS INTEGER) AS week, CAST(month(date) AS INTEGER) AS month, 'Q' || quarter(date) AS quarter, CAST(year(date) AS INTEGER) AS year FROM dim_date")
def dim_date(m: Model) -> DataFrame:
    return m.dim_date()


@query("SELECT sku_id, quantile_cont(unit_price, 0.5) AS list_price FROM fact_sales WHERE unit_price > 0 GROUP BY 1")
def dim_sku_median(m: Model) -> DataFrame:
    return invoices.list_prices(m.fact_sales())


@query("""SELECT 'fact_sales' AS "table", 'sku_id' AS "column", count(*) AS rows FROM fact_sales WHERE sku_id NOT IN (SELECT sku_id FROM dim_sku WHERE sub_category <> (SELECT min(sub_category) FROM dim_sku))
UNION ALL SELECT 'fact_orders', 'sku_id', count(*) FROM fact_orders WHERE sku_id NOT IN (SELECT sku_id FROM dim_sku WHERE sub_category <> (SELECT min(sub_category) FROM dim_sku))""")
def fk_violations(m: Model) -> DataFrame:
    """Against a product table that lacks one brand."""
    t = m.tables()
    lowest = t["dim_sku"].agg(F.min("sub_category").alias("low"))
    few = t["dim_sku"].crossJoin(F.broadcast(lowest)).where("sub_category <> low").drop("low")  # one row
    return store.foreign_key_violations({"fact_sales": t["fact_sales"], "fact_orders": t["fact_orders"], "dim_sku": few})


from . import chart_queries, more_queries, report_queries, store_queries  # noqa: E402, F401  register their queries here
