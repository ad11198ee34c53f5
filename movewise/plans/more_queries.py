"""More registered queries: the invoice adapter, stores, cleaned tables, every validator check, reports and views, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import scratch, settled
from ..operators import clean, compare, decompose, mart, signals, validate
from ..sources import invoices, schema, store
from ..sources.testbed import INVOICE_SQL, Model
from ..streaming import periods
from . import queries as q
from . import reports
from .queries import _D, _MONTH, _Q, _R, _SIGNALS, _VARIANCE, RC, query

# The invoice adapter.


def _sheet(m: Model) -> invoices.Adapted:
    return invoices.adapt(m.spark, m.invoices())


@query("SELECT order_id, sku_id, sku_name, category, date, units, unit_price, customer_id, region_code, is_return, net_sales FROM il", INVOICE_SQL)
def invoice_lines(m: Model) -> DataFrame:
    return invoices.lines_of(m.invoices()).select("order_id", "sku_id", "sku_name", "category", "date", "units", "unit_price", "customer_id", "region_code", "is_return", "net_sales")


def _first(*columns: str) -> str:
    return ", ".join(f"struct_extract(min(struct_pack(a := rn, v := {c})) FILTER (WHERE {c} IS NOT NULL), 'v') AS {c}" for c in columns)


_FACT = f"""{INVOICE_SQL},
ig AS (SELECT order_id, sku_id, {_first("date", "customer_id", "region_code", "category")}, CAST(sum(units) AS BIGINT) AS units, {_D("net_sales")} AS net_sales FROM isl GROUP BY order_id, sku_id),
ifs AS (SELECT order_id, date, customer_id, region_code, 'Online' AS channel, 'UNASSIGNED' AS kam_id, sku_id, category, 'PRIMARY' AS sales_type, units, {_R(_Q("net_sales", "units"))} AS unit_price, CAST(0 AS DOUBLE) AS discount_pct, net_sales FROM ig)"""


@query("SELECT * FROM ifs", _FACT)
def invoice_sales(m: Model) -> DataFrame:
    return _sheet(m).tables["fact_sales"]


@query("SELECT order_id, sku_id, region_code, customer_id, date, units, abs(units) AS returned_units FROM il WHERE is_return", INVOICE_SQL)
def invoice_returns(m: Model) -> DataFrame:
    return _sheet(m).returns


@query(
    f"SELECT sku_id, coalesce(sku_name, 'Not recorded') AS sku_name, category, 'Standard' AS sub_category, CAST(1 AS DOUBLE) AS pack_size_kg, {_R('coalesce(list_price, 0) * CAST(0.7 AS DOUBLE)')} AS unit_cost, coalesce(list_price, 0) AS list_price, 1 AS active_flag FROM ik LEFT JOIN im USING (sku_id)",
    f"{INVOICE_SQL}, ik AS (SELECT sku_id, {_first('sku_name', 'category')} FROM isl GROUP BY sku_id), im AS (SELECT sku_id, quantile_cont(unit_price, 0.5) AS list_price FROM isl WHERE unit_price > 0 GROUP BY sku_id)",
)
def invoice_dim_sku(m: Model) -> DataFrame:
    return _sheet(m).tables["dim_sku"]


@query(
    "SELECT customer_id, CASE WHEN customer_id = 'UNKNOWN' THEN 'Unidentified customer' ELSE 'Customer ' || customer_id END AS customer_name, 'Retail' AS customer_type, 'Online' AS channel, region_code, region_code AS city, region_code AS zone, 'UNASSIGNED' AS kam_id FROM ib",
    f"{INVOICE_SQL}, ib AS (SELECT customer_id, {_first('region_code')} FROM isl GROUP BY customer_id)",
)
def invoice_dim_customer(m: Model) -> DataFrame:
    return _sheet(m).tables["dim_customer"]


@query("SELECT DISTINCT region_code, region_code AS city, region_code AS zone FROM isl WHERE region_code IS NOT NULL", INVOICE_SQL)
def invoice_dim_region(m: Model) -> DataFrame:
    return _sheet(m).tables["dim_region"]


@query("SELECT DISTINCT date, CAST(weekofyear(date) AS INTEGER) AS week, CAST(month(date) AS INTEGER) AS month, 'Q' || quarter(date) AS quarter, CAST(year(date) AS INTEGER) AS year FROM isl", INVOICE_SQL)
def invoice_dim_date(m: Model) -> DataFrame:
    return _sheet(m).tables["dim_date"]


@query("SELECT 'UNASSIGNED' AS kam_id, 'Not recorded' AS kam_name")
def invoice_dim_kam(m: Model) -> DataFrame:
    return _sheet(m).tables["dim_kam"]


@query(
    """SELECT 'source_lines' AS name, count(*) AS rows FROM il UNION ALL SELECT 'return_lines', count(*) FROM il WHERE is_return UNION ALL SELECT 'returns', count(*) FROM il WHERE is_return
UNION ALL SELECT 'consolidated_lines', (SELECT count(*) FROM isl) - (SELECT count(*) FROM ifs) UNION ALL SELECT 'fact_sales', count(*) FROM ifs
UNION ALL SELECT 'dim_date', count(DISTINCT date) FROM isl UNION ALL SELECT 'dim_kam', 1 UNION ALL SELECT 'dim_region', count(DISTINCT region_code) FROM isl UNION ALL SELECT 'dim_sku', count(DISTINCT sku_id) FROM isl
UNION ALL SELECT 'dim_customer', count(DISTINCT customer_id) FROM isl UNION ALL SELECT 'fact_orders', 0 UNION ALL SELECT 'fact_inventory', 0 UNION ALL SELECT 'fact_targets', 0 UNION ALL SELECT 'fact_kam_targets', 0""",
    _FACT,
)
def invoice_summary(m: Model) -> DataFrame:
    return _sheet(m).summary()


# Stores.


def _folder(m: Model) -> str:
    return scratch(m.spark, "store")


@query("SELECT sku_id, sku_name, category, sub_category, pack_size_kg, unit_cost, list_price, CAST(1 AS INTEGER) AS active_flag FROM (SELECT * REPLACE (CAST(sku_id AS VARCHAR) AS sku_id) FROM dim_sku)")
def lake_round_trip(m: Model) -> DataFrame:
    """Written typed into the clean zone, and read back with typed empty tables for the rest."""
    lake = store.Lake(m.spark, _folder(m))
    lake.write(m.dim_sku(), "clean", "dim_sku", typed=True)
    return lake.read_curated("clean")["dim_sku"]


@query("SELECT date, region_code, category, channel, sales_target, order_target, fill_rate_target FROM fact_targets")
def csv_round_trip(m: Model) -> DataFrame:
    """Written as CSV, read as text, typed by the declared schema."""
    folder = _folder(m)
    m.fact_targets().select(*[x.split()[0] for x in schema.TABLES["fact_targets"].split(", ")]).write.csv(f"{folder}/fact_targets.csv", header=True)
    return store.load_dataset(m.spark, folder, typed=True)["fact_targets"]


@query("SELECT CAST(NULL AS DATE) AS date, '' AS kam_id, CAST(0 AS DOUBLE) AS sales_target, CAST(0 AS INTEGER) AS order_target WHERE false")
def empty_fact(m: Model) -> DataFrame:
    return schema.empty(m.spark, "fact_kam_targets")


@query("SELECT name FROM (VALUES ('dim_customer'), ('dim_date'), ('dim_kam'), ('dim_region'), ('dim_sku'), ('fact_inventory'), ('fact_kam_targets'), ('fact_orders'), ('fact_sales'), ('fact_targets'), ('mart_commercial_daily'), ('stg_inventory'), ('stg_kam_targets'), ('stg_orders'), ('stg_sales'), ('stg_targets')) t(name)")
def available_tables(m: Model) -> DataFrame:
    store.build_database(m.spark, m.tables(), suffix=m.suffix)
    found = [n.removesuffix(m.suffix) for n in store.available_tables(m.spark) if n.endswith(m.suffix)]
    return m.spark.createDataFrame([(n,) for n in found], "name string")


# Enrichment, cleaning, validation, comparison.


@query("SELECT sub_category, count(*) AS rows, count(sku_name) AS named, CAST(sum(units) AS BIGINT) AS units FROM fact_sales LEFT JOIN (SELECT * FROM dim_sku WHERE sku_id % 3 <> 0) USING (sku_id) GROUP BY sub_category")
def left_enrich(m: Model) -> DataFrame:
    """Against a product table that lacks every third product: their lines stay, without a name."""
    out = mart.left_enrich(m.fact_sales(), m.dim_sku().where("sku_id % 3 <> 0"), "sku_id", ["sku_name", "sub_category"])
    return out.groupBy("sub_category").agg(F.count("*").alias("rows"), F.count("sku_name").alias("named"), F.sum("units").alias("units"))


@query(
    f"SELECT order_id, sku_id, customer_id, kam_id, sales_type, units, price AS unit_price, coalesce(discount_pct, 0) AS discount_pct, {_R('units * price * (1 - coalesce(discount_pct, 0))', 2)} AS net_sales FROM (SELECT du.*, coalesce(unit_price, list_price) AS price FROM du LEFT JOIN dim_sku USING (sku_id)) WHERE price > 0 AND units > 0",
    q._DAMAGED,
)
def cleaned_sales(m: Model) -> DataFrame:
    return clean.clean(m.spark, q._damaged(m)).tables["fact_sales"].select("order_id", "sku_id", "customer_id", "kam_id", "sales_type", "units", "unit_price", "discount_pct", "net_sales")


@query("SELECT order_id, sku_id, CASE WHEN k = 6 THEN c.channel ELSE o.channel END AS channel, ordered_units, fulfilled_units, cancelled_units FROM ok_ o JOIN dim_customer c USING (customer_id) WHERE k <> 5", q._DAMAGED)
def cleaned_orders(m: Model) -> DataFrame:
    return clean.clean(m.spark, q._damaged(m)).tables["fact_orders"].select("order_id", "sku_id", "channel", "ordered_units", "fulfilled_units", "cancelled_units")


@query("SELECT date, kam_id, sales_target, order_target FROM fact_kam_targets")
def cleaned_kam_targets(m: Model) -> DataFrame:
    return clean.clean(m.spark, q._damaged(m)).tables["fact_kam_targets"].select("date", "kam_id", "sales_target", "order_target")


_BROKEN = """
vs AS (SELECT order_id, date, customer_id, region_code, channel, CASE WHEN k = 5 THEN 'K9' ELSE kam_id END AS kam_id, sku_id, category, CASE WHEN k = 8 THEN NULL ELSE sales_type END AS sales_type, CASE WHEN k = 2 THEN -units ELSE units END AS units, unit_price,
  CASE WHEN k = 3 THEN 1.5 ELSE discount_pct END AS discount_pct, CASE WHEN k = 1 THEN NULL WHEN k = 4 THEN net_sales + 1 ELSE net_sales END AS net_sales FROM (SELECT *, (order_id * 31 + sku_id) % 97 AS k FROM fact_sales)),
vo AS (SELECT order_id, date, customer_id, region_code, channel, sku_id, ordered_units, CASE WHEN k = 6 THEN ordered_units + 1 ELSE fulfilled_units END AS fulfilled_units, cancelled_units, sales_type FROM (SELECT *, (order_id * 31 + sku_id) % 97 AS k FROM line)),
vi AS (SELECT date, sku_id, warehouse, region_code, opening_stock, available_stock, CASE WHEN sku_id % 50 = 0 THEN 1 WHEN sku_id % 50 = 1 THEN 2 ELSE stockout_flag END AS stockout_flag FROM fact_inventory)"""
_BAD = {
    ("fact_sales", "required_values", "ERROR"): "SELECT count(*) FROM vs WHERE net_sales IS NULL OR sales_type IS NULL", ("fact_sales", "numeric_net_sales", "ERROR"): "SELECT count(*) FROM vs WHERE net_sales IS NULL",
    ("fact_sales", "non_negative_units", "ERROR"): "SELECT count(*) FROM vs WHERE units < 0", ("fact_sales", "bounds_discount_pct", "ERROR"): "SELECT count(*) FROM vs WHERE discount_pct > 1",
    ("fact_sales", "sales_value_reconciliation", "ERROR"): "SELECT count(*) FROM vs WHERE abs(round_even(units * unit_price * (1 - discount_pct), 2) - net_sales) > CAST(0.02 AS DOUBLE)",
    ("fact_sales", "fk_kam_id", "ERROR"): "SELECT count(*) FROM vs WHERE kam_id = 'K9'", ("fact_sales", "duplicate_key", "ERROR"): "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM vs GROUP BY order_id, sku_id, sales_type HAVING count(*) > 1)",
    ("fact_orders", "fulfilled_not_greater_than_ordered", "ERROR"): "SELECT count(*) FROM vo WHERE fulfilled_units > ordered_units", ("fact_orders", "order_quantity_reconciliation", "ERROR"): "SELECT count(*) FROM vo WHERE fulfilled_units + cancelled_units <> ordered_units",
    ("fact_orders", "duplicate_key", "ERROR"): "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM vo GROUP BY order_id, sku_id, sales_type HAVING count(*) > 1)",
    ("fact_inventory", "bounds_stockout_flag", "ERROR"): "SELECT count(*) FROM vi WHERE stockout_flag > 1", ("fact_inventory", "stockout_flag_consistency", "WARNING"): "SELECT count(*) FROM vi WHERE stockout_flag = 1 AND available_stock > 2",
    ("fact_inventory", "fk_date", "ERROR"): "SELECT count(*) FROM vi WHERE date NOT IN (SELECT date FROM dim_date)", ("fact_inventory", "duplicate_key", "ERROR"): "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM vi GROUP BY date, sku_id, warehouse HAVING count(*) > 1)",
    ("fact_targets", "bounds_fill_rate_target", "ERROR"): "SELECT count(*) FROM fact_targets WHERE channel = (SELECT min(channel) FROM fact_targets)", ("fact_targets", "fk_date", "ERROR"): "SELECT count(*) FROM fact_targets WHERE date NOT IN (SELECT date FROM dim_date)",
    ("fact_kam_targets", "table_present", "ERROR"): "SELECT 1", ("dim_region", "required_columns", "ERROR"): "SELECT 1",
}


def _broken(m: Model) -> dict[str, DataFrame]:
    """The model with defects of every kind that the validator knows."""
    t = m.tables()
    k, c = (F.col("order_id") * 31 + F.col("sku_id")) % 97, F.col
    t["fact_sales"] = t["fact_sales"].withColumn("k", k).withColumns({
        "net_sales": F.when(c("k") == 1, F.lit(None)).when(c("k") == 4, c("net_sales") + 1).otherwise(c("net_sales")), "units": F.when(c("k") == 2, -c("units")).otherwise(c("units")),
        "discount_pct": F.when(c("k") == 3, 1.5).otherwise(c("discount_pct")), "kam_id": F.when(c("k") == 5, "K9").otherwise(c("kam_id")), "sales_type": F.when(c("k") != 8, c("sales_type")),
    }).drop("k")
    t["fact_orders"] = t["fact_orders"].withColumn("fulfilled_units", F.when(k == 6, c("ordered_units") + 1).otherwise(c("fulfilled_units")))
    t["fact_inventory"] = t["fact_inventory"].withColumn("stockout_flag", F.when(c("sku_id") % 50 == 0, 1).when(c("sku_id") % 50 == 1, 2).otherwise(c("stockout_flag")))
    lowest = t["fact_targets"].agg(F.min("channel").alias("low"))  # one row
    t["fact_targets"] = t["fact_targets"].crossJoin(F.broadcast(lowest)).withColumn("fill_rate_target", F.when(c("channel") == c("low"), 1.2).otherwise(c("fill_rate_target"))).drop("low")
    t["dim_region"] = t["dim_region"].drop("zone")
    del t["fact_kam_targets"]
    return t


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"check\", '{s}' AS severity, CAST(({n}) AS BIGINT) AS rows" for (t, c, s), n in _BAD.items()) + ") WHERE rows > 0", _BROKEN)
def validate_planted(m: Model) -> DataFrame:
    return validate.validate(m.spark, _broken(m))


@query("SELECT severity, count(*) AS checks, CAST(sum(rows) AS BIGINT) AS rows FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS severity, CAST(({n}) AS BIGINT) AS rows" for (_, _, s), n in _BAD.items()) + ") WHERE rows > 0 GROUP BY severity", _BROKEN)
def validation_by_severity(m: Model) -> DataFrame:
    issues = settled(validate.validate(m.spark, _broken(m)))
    count = lambda df: df.groupBy("severity").agg(F.count("*").alias("checks"), F.sum("rows").alias("rows"))
    return count(validate.errors(issues)).unionByName(count(validate.warnings(issues)))


@query(
    "SELECT coalesce(a.region_code, b.region_code) AS region_code, CASE WHEN b.region_code IS NULL THEN 'left' WHEN a.region_code IS NULL THEN 'right' ELSE 'both' END AS side, CASE WHEN a.region_code IS NOT NULL AND b.region_code IS NOT NULL THEN 'net_sales' END AS columns FROM ca a FULL JOIN cb b ON a.region_code = b.region_code WHERE a.region_code IS NULL OR b.region_code IS NULL OR abs(a.net_sales - b.net_sales) > CAST(0.001 AS DOUBLE)",
    f"""ca AS (SELECT region_code, {_D("net_sales")} AS net_sales FROM fact_sales GROUP BY 1),
cb AS (SELECT CASE WHEN region_code = (SELECT min(region_code) FROM ca) THEN 'elsewhere' ELSE region_code END AS region_code, net_sales + CASE WHEN region_code = (SELECT max(region_code) FROM ca) THEN 1 ELSE CAST(0.0001 AS DOUBLE) END AS net_sales FROM ca)""",
)
def compare_tables(m: Model) -> DataFrame:
    """Totals by region against a copy with one region renamed, one changed, and the others off by less than the tolerance."""
    left = settled(m.fact_sales().groupBy("region_code").agg(q.half_even(F.sum(q.half_even("net_sales", 2).cast("decimal(18,2)")).cast("double"), 2).alias("net_sales")))
    ends = left.agg(F.min("region_code").alias("low"), F.max("region_code").alias("high"))  # one row
    right = left.crossJoin(F.broadcast(ends)).select(
        F.when(F.col("region_code") == F.col("low"), "elsewhere").otherwise(F.col("region_code")).alias("region_code"), (F.col("net_sales") + F.when(F.col("region_code") == F.col("high"), 1.0).otherwise(0.0001)).alias("net_sales")
    )
    return compare.differences(left, right, ["region_code"], 0.001).withColumn("columns", F.array_join("columns", ","))


# Decomposition and signals, further.


@query("SELECT component FROM co ORDER BY abs(net) DESC, component LIMIT 1", q._COHERENCE)
def dominant_component(m: Model) -> DataFrame:
    return m.spark.createDataFrame([(decompose.dominant_component(q.decompose_rate(m)),)], "component string")


@query("SELECT CAST(row_number() OVER (ORDER BY abs(contribution) DESC, segment) AS INTEGER) AS rank, 'contribution' AS ranked_by, * FROM dec WHERE contribution IS NOT NULL ORDER BY abs(contribution) DESC, segment LIMIT 4", q._ADDITIVE)
def rank_drivers_absolute(m: Model) -> DataFrame:
    return decompose.rank_drivers(q.decompose_additive(m), "absolute", 4)


@query(
    "SELECT segment, contribution, direction FROM (SELECT *, CASE WHEN t < 0 THEN 'negative' ELSE 'positive' END AS direction FROM dec, (SELECT sum(contribution) AS t FROM dec)) WHERE (t < 0 AND contribution < 0) OR (t >= 0 AND contribution > 0) ORDER BY CASE WHEN t < 0 THEN contribution ELSE -contribution END, segment LIMIT 3",
    q._ADDITIVE,
)
def explain_movement(m: Model) -> DataFrame:
    told = decompose.explain_movement(q._months(m, RC), "net_sales", RC)
    return m.spark.createDataFrame([(r["segment"], r["contribution"], told["direction"]) for r in told["leaders"]], "segment string, contribution double, direction string")


_SIGNAL_COLUMNS = f"""'net_sales' AS metric, 'region_code | category' AS dimension, segment, c1 AS period, c0 AS comparison_period, {_R("va - vb")} AS movement, {_R("(va - vb) / nullif(abs(vb), 0)")} AS movement_pct, contribution, share AS share_of_absolute_movement, 'contribution' AS ranked_by,
likely_driver, alternative_supported, corroborating, impact, movement_is_material, movement_persisted, segment_carries_the_movement, other_metrics_agree, alternative_not_supported, movement_is_directional, criteria_met, confidence, {_R("coalesce(abs(impact), 0) * weight", 2)} AS priority_score"""


@query(f"SELECT {_SIGNAL_COLUMNS} FROM x4, tw WHERE weight >= CAST(0.6 AS DOUBLE)", _SIGNALS)
def signals_over_a_floor(m: Model) -> DataFrame:
    return signals.detect(q._months(m, RC), "net_sales", RC, q._stock(m), top_n=5, min_confidence="medium").drop("recommended_investigation", "inventory_note")


def _report(m: Model, name: str, sheet: str, **options) -> DataFrame:
    return reports.build_report(name, m.tables(), **options)[sheet]


@query(f"SELECT {_SIGNAL_COLUMNS} FROM x4, tw", _SIGNALS)
def report_signals(m: Model) -> DataFrame:
    return _report(m, "signal_report", "Signals", period="month").drop("recommended_investigation", "inventory_note")


_CRITERIA = ["movement_is_material", "movement_persisted", "segment_carries_the_movement", "other_metrics_agree", "alternative_not_supported", "movement_is_directional"]


@query(" UNION ALL ".join(f"SELECT segment, '{c}' AS criterion, {c} AS met FROM x4" for c in _CRITERIA), _SIGNALS)
def report_signal_criteria(m: Model) -> DataFrame:
    return _report(m, "signal_report", "Criteria", period="month")


@query(f"SELECT r.*, r.region_code || ' | ' || r.category AS segment FROM ({q._EV_ROWS}) r JOIN x4 ON x4.region_code = r.region_code AND x4.category = r.category", _SIGNALS)
def report_signal_evidence(m: Model) -> DataFrame:
    return _report(m, "signal_report", "Evidence", period="month")


# A rate metric: leaders by the effect that moves most.


def _for_rate(text: str) -> str:
    return text.replace("net_sales - lag(net_sales)", "fill_rate - lag(fill_rate)")


_RATE_SIGNALS = (
    q._COHERENCE
    + f""", {q._INVENTORY}, {q._evidence_sql()}, {_for_rate(q._STREAK)}, {_for_rate(q._SWING)},
top AS (SELECT component, coalesce(coherence, 0) >= CAST(0.3 AS DOUBLE) AS steady FROM co ORDER BY abs(net) DESC, component LIMIT 1),
rv0 AS (SELECT dec.*, component, steady, CASE component WHEN 'rate_effect' THEN rate_effect WHEN 'mix_effect' THEN mix_effect ELSE interaction_effect END AS v FROM dec, top), rv AS (SELECT *, {_R("sum(abs(v)) OVER ()", 10)} AS gross FROM rv0),
ld AS (SELECT segment, region_code, category, contribution, share_of_absolute_movement, component, steady, {_R("abs(v) / nullif(gross, 0)")} AS share FROM rv WHERE v < 0 ORDER BY v, segment LIMIT 5),
ow AS (SELECT region_code, category, max(CASE WHEN period_start = c0 THEN fill_rate END) AS vb, max(CASE WHEN period_start = c1 THEN fill_rate END) AS va FROM p, tw GROUP BY 1, 2),
x0 AS (SELECT * FROM ld LEFT JOIN ev USING (region_code, category) LEFT JOIN ow USING (region_code, category) LEFT JOIN stk USING (region_code, category) LEFT JOIN sw USING (region_code, category)),
x1 AS (SELECT *, CASE WHEN component = 'mix_effect' THEN 'portfolio_mix_shift' WHEN {q._LAG} THEN 'fulfilment_constraint' WHEN ordered_units_dir = 'down' THEN 'demand_softness' ELSE 'unclassified' END AS likely_driver,
  CASE WHEN component = 'mix_effect' THEN fulfilled_units_dir = 'down' AND ordered_units_dir <> 'down' WHEN {q._LAG} THEN NOT (ordered_units_dir IN ('up', 'flat')) WHEN ordered_units_dir = 'down' THEN available_stock_dir = 'down' OR stockout_rate_dir = 'up' END AS alternative_supported,
  CAST(CASE WHEN component = 'mix_effect' THEN 0 WHEN {q._LAG} THEN 2 + CAST(available_stock_dir = 'down' AS INTEGER) + CAST(stockout_rate_dir = 'up' AS INTEGER) WHEN ordered_units_dir = 'down' THEN 1 + CAST(fulfilled_units_dir = 'down' AS INTEGER) + CAST(available_stock_dir IN ('up', 'flat') AS INTEGER) ELSE 0 END AS INTEGER) AS corroborating,
  CASE WHEN fill_rate_before IS NOT NULL THEN {q._SHORT} END AS impact FROM x0),
x2 AS (SELECT *, {q._B("abs(va - vb) >= CAST(1.5 AS DOUBLE) * typical")} AS movement_is_material, {q._B("streak >= 2")} AS movement_persisted, {q._B("share >= CAST(0.15 AS DOUBLE)")} AS segment_carries_the_movement, corroborating >= 2 AS other_metrics_agree, {q._B("NOT alternative_supported")} AS alternative_not_supported, steady AS movement_is_directional FROM x1),
x3 AS (SELECT *, {" + ".join(f"CAST({c} AS INTEGER)" for c in _CRITERIA)} AS criteria_met FROM x2),
x4 AS (SELECT *, CASE WHEN criteria_met >= 5 THEN 'high' WHEN criteria_met >= 3 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN criteria_met >= 5 THEN CAST(1 AS DOUBLE) WHEN criteria_met >= 3 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS weight FROM x3)"""
)


@query(f"SELECT {_SIGNAL_COLUMNS} FROM x4, tw".replace("'net_sales' AS metric", "'fill_rate' AS metric").replace("share AS share_of_absolute_movement, 'contribution' AS ranked_by", "share_of_absolute_movement, component AS ranked_by"), _RATE_SIGNALS)
def signals_of_a_rate(m: Model) -> DataFrame:
    return signals.detect(q._months(m, RC), "fill_rate", RC, q._stock(m), top_n=5).drop("recommended_investigation", "inventory_note")


# Many movements in one plan, and scenarios judged by what is found.

_RATE_COLUMNS = _SIGNAL_COLUMNS.replace("'net_sales' AS metric", "'fill_rate' AS metric").replace("share AS share_of_absolute_movement, 'contribution' AS ranked_by", "share_of_absolute_movement, component AS ranked_by")
_BOTH = f"(WITH {q.MODEL_SQL},{_SIGNALS} SELECT 'money' AS \"case\", {_SIGNAL_COLUMNS}, region_code, category, weight FROM x4, tw) UNION ALL (WITH {q.MODEL_SQL},{_RATE_SIGNALS} SELECT 'service' AS \"case\", {_RATE_COLUMNS}, region_code, category, weight FROM x4, tw)"
_OUTCOMES = f"""both_ AS ({_BOTH}),
planted AS (SELECT k.c || ' ' || r_name AS scenario, CASE WHEN i % 3 = 1 THEN 'demand_softness' WHEN i % 3 = 2 THEN 'fulfilment_constraint' END AS expected_pattern, r_name AS region, k.metric, k.c FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region), (VALUES ('money', 'net_sales'), ('service', 'fill_rate')) k(c, metric)),
grid AS (SELECT * FROM planted, (VALUES ('high', CAST(1 AS DOUBLE)), ('medium', CAST(0.6 AS DOUBLE))) f(confidence_floor, least)),
loud AS (SELECT grid.*, b.segment, b.likely_driver, b.region_code, row_number() OVER (PARTITION BY scenario, confidence_floor ORDER BY b.priority_score DESC, b.segment) AS n FROM grid JOIN both_ b ON b."case" = grid.c AND b.weight >= least),
told AS (SELECT scenario, confidence_floor, count(*) AS signals_returned, string_agg(segment, '; ' ORDER BY n) FILTER (WHERE region_code NOT IN (SELECT region FROM planted WHERE expected_pattern IS NOT NULL)) AS false_positives,
  arg_min(segment, n) FILTER (WHERE expected_pattern IS NOT NULL AND region_code = region) AS matched_segment, arg_min(likely_driver, n) FILTER (WHERE expected_pattern IS NOT NULL AND region_code = region) AS matched_pattern, min(n) FILTER (WHERE expected_pattern IS NOT NULL AND region_code = region) AS rank FROM loud GROUP BY 1, 2),
judged AS (SELECT scenario, expected_pattern, region, metric, confidence_floor, CASE WHEN expected_pattern IS NULL THEN CASE WHEN false_positives IS NULL THEN 'correct_silence' ELSE 'false_alarm' END WHEN matched_segment IS NULL THEN 'miss' WHEN matched_pattern = expected_pattern THEN 'hit' ELSE 'wrong_pattern' END AS outcome,
  matched_segment, matched_pattern, CAST(rank AS INTEGER) AS rank, CAST(coalesce(signals_returned, 0) AS INTEGER) AS signals_returned, coalesce(false_positives, '') AS false_positives FROM grid LEFT JOIN told USING (scenario, confidence_floor))"""


@query(f"SELECT * EXCLUDE (region_code, category, weight) FROM ({_BOTH})")
def signals_of_many_cases(m: Model) -> DataFrame:
    summary = q._months(m, RC)
    current, before = decompose.resolve_periods(summary)
    cases = [signals.Case("money", "net_sales", current, before), signals.Case("service", "fill_rate", current, before)]
    return signals.detect_cases(summary, cases, RC, q._stock(m), top_n=5).drop("recommended_investigation", "inventory_note", *RC)


def _outcomes(m: Model) -> DataFrame:
    """Each region is said to hold something, in money and in service; every third one is a control."""
    summary = q._months(m, RC)
    current, before = decompose.resolve_periods(summary)
    regions = [r["region_code"] for r in m.dim_region().orderBy("region_code").collect()]  # five rows
    patterns = {1: signals.DEMAND, 2: signals.SUPPLY}
    planted = [
        {"name": f"{c} {region}", "region_code": region, "metric": metric, "expected_pattern": patterns.get(i % 3), "starts": str(before) if i % 3 else None, "current_period": str(current), "comparison_period": str(before)}
        for c, metric in (("money", "net_sales"), ("service", "fill_rate")) for i, region in enumerate(regions, 1)
    ]
    return signals.evaluate_scenarios(planted, summary, RC, q._stock(m), top_n=5)


@query("SELECT * FROM judged", _OUTCOMES)
def scenario_outcomes(m: Model) -> DataFrame:
    return _outcomes(m).withColumn("false_positives", F.array_join("false_positives", "; "))


@query(
    f"""SELECT confidence_floor, count(expected_pattern) AS planted_scenarios, count(*) FILTER (WHERE outcome = 'hit') AS correctly_classified, count(*) FILTER (WHERE outcome = 'wrong_pattern') AS found_but_misclassified, count(*) FILTER (WHERE outcome = 'miss') AS missed,
{q._R(q._Q("count(*) FILTER (WHERE outcome = 'hit')", "count(expected_pattern)"))} AS recall, CAST(sum(CASE WHEN false_positives = '' THEN 0 ELSE len(string_split(false_positives, '; ')) END) AS BIGINT) AS false_alarm_signals, count(*) FILTER (WHERE outcome = 'correct_silence') AS controls_silent, count(*) - count(expected_pattern) AS controls FROM judged GROUP BY 1""",
    _OUTCOMES,
)
def scenario_rates(m: Model) -> DataFrame:
    return signals.summarise_evaluation(_outcomes(m))


@query(
    """SELECT segment, likely_driver, 'no inventory given' AS inventory_note, CASE likely_driver WHEN 'fulfilment_constraint' THEN 'Check stock and replenishment of ' || segment || ', largest unserved products first.'
WHEN 'demand_softness' THEN 'Check orders of ' || segment || ' by customer and channel, and that stock was there.' ELSE 'Look at ' || segment || ' at a finer grain or over a longer time.' END AS recommended_investigation FROM x4""",
    _SIGNALS,
)
def signals_without_stock(m: Model) -> DataFrame:
    """Without inventory each signal says so."""
    return signals.detect(q._months(m, RC), "net_sales", RC, top_n=5).select("segment", "likely_driver", "inventory_note", "recommended_investigation")


# Reports and views.


_DAY = q._summary([], "day").replace("GROUP BY ALL", "GROUP BY period_start")


@query(
    f"""SELECT p.*, lag(net_sales) OVER (ORDER BY period_start) AS prior_day_net_sales, {_R("net_sales - lag(net_sales) OVER (ORDER BY period_start)", 6)} AS day_over_day_change, sales_target, {_R("net_sales - sales_target", 6)} AS target_variance,
{_R(_R("net_sales - sales_target", 6) + " / nullif(sales_target, 0)")} AS target_variance_pct FROM p LEFT JOIN (SELECT date AS period_start, {_D("sales_target")} AS sales_target FROM fact_targets GROUP BY 1) USING (period_start)""",
    _DAY,
)
def report_daily_tracker(m: Model) -> DataFrame:
    return _report(m, "daily_sales_tracker", "Daily tracker")


@query("SELECT * FROM p", q._summary(["kam_id"], "week"))
def report_by_manager(m: Model) -> DataFrame:
    return _report(m, "sales_performance", "By manager")


_DIMS = ["region_code", "category", "channel"]


@query(
    f"SELECT {_VARIANCE}, category, channel FROM (SELECT *, {_R('variance / nullif(comparison_value, 0)')} AS variance_pct FROM pv)",
    q._summary(_DIMS, "week")
    + f""", pt AS (SELECT {q._WEEK} AS period_start, region_code, category, channel, {_D("sales_target")} AS comparison_value FROM fact_targets GROUP BY ALL),
pv AS (SELECT 'net_sales' AS metric, region_code || ' | ' || category || ' | ' || channel AS segment, 'week' AS period_type, period_start, period_start AS comparison_period, net_sales AS actual, comparison_value, {_R("net_sales - comparison_value", 6)} AS variance, 'target' AS comparison_type, region_code, category, channel FROM p JOIN pt USING (period_start, region_code, category, channel))""",
)
def report_plan_variance(m: Model) -> DataFrame:
    return _report(m, "sales_performance", "Plan variance")


@query("SELECT *, ordered_units - fulfilled_units AS unfulfilled_units FROM p", q._summary(RC, "week"))
def report_service(m: Model) -> DataFrame:
    return _report(m, "fill_rate_report", "Service detail")


@query(
    f"SELECT {_VARIANCE}, category FROM (SELECT *, {_R('variance / nullif(comparison_value, 0)')} AS variance_pct FROM pv)",
    q._summary(RC, "week")
    + f""", pt AS (SELECT {q._WEEK} AS period_start, region_code, category, {_R("avg(fill_rate_target)", 6)} AS comparison_value FROM fact_targets GROUP BY ALL),
pv AS (SELECT 'fill_rate' AS metric, region_code || ' | ' || category AS segment, 'week' AS period_type, period_start, period_start AS comparison_period, fill_rate AS actual, comparison_value, {_R("fill_rate - comparison_value", 6)} AS variance, 'target' AS comparison_type, region_code, category FROM p JOIN pt USING (period_start, region_code, category))""",
)
def report_fill_rate(m: Model) -> DataFrame:
    return _report(m, "fill_rate_report", "Against target")


@query(
    f"SELECT channel, primary_sales, secondary_sales, {_R('primary_sales + secondary_sales', 2)} AS total_sales, {_R('primary_sales / nullif(' + _R('primary_sales + secondary_sales', 2) + ', 0)')} AS primary_mix, {_R('secondary_sales / nullif(' + _R('primary_sales + secondary_sales', 2) + ', 0)')} AS secondary_mix FROM pm",
    "pm AS (SELECT channel, CAST(coalesce(sum(CAST(net_sales AS DECIMAL(18, 2))) FILTER (WHERE sales_type = 'PRIMARY'), 0) AS DOUBLE) AS primary_sales, CAST(coalesce(sum(CAST(net_sales AS DECIMAL(18, 2))) FILTER (WHERE sales_type = 'SECONDARY'), 0) AS DOUBLE) AS secondary_sales FROM fact_sales GROUP BY channel)",
)
def report_primary_secondary(m: Model) -> DataFrame:
    return _report(m, "primary_secondary", "By channel")


@query(
    f"SELECT *, {_R('((SELECT wape FROM sc WHERE model = ' + chr(39) + 'naive' + chr(39) + ') - wape) / nullif((SELECT wape FROM sc WHERE model = ' + chr(39) + 'naive' + chr(39) + '), 0)')} AS wape_gain, CAST(row_number() OVER (ORDER BY wape NULLS LAST, model) AS INTEGER) AS rank FROM sc",
    q._backtest_sql(56, 14, 7) + "," + q._SCORES,
)
def report_forecast_accuracy(m: Model) -> DataFrame:
    return _report(m, "forecast_report", "Accuracy orders", initial=56, step=14)


@query(
    "SELECT *, ordered_units - fulfilled_units AS unfulfilled_units FROM m ORDER BY ordered_units - fulfilled_units DESC, sku_id LIMIT 15",
    q._metrics(["sku_id"]),
)
def view_unserved_products(m: Model) -> DataFrame:
    return reports.supply_views(m.tables(), "month")["by_sku"]


@query(
    "SELECT p.*, fill_rate_target, CASE WHEN fill_rate - fill_rate_target IS NULL THEN 'No demand' WHEN fill_rate - fill_rate_target >= 0 THEN 'On target' WHEN fill_rate - fill_rate_target >= CAST(-0.05 AS DOUBLE) THEN 'Slightly below' WHEN fill_rate - fill_rate_target >= CAST(-0.15 AS DOUBLE) THEN 'Below target' ELSE 'Well below' END AS status FROM p LEFT JOIN pt USING (period_start, region_code, category)",
    q._summary(RC) + f", pt AS (SELECT {_MONTH} AS period_start, region_code, category, {_R('avg(fill_rate_target)', 6)} AS fill_rate_target FROM fact_targets GROUP BY ALL)",
)
def view_service(m: Model) -> DataFrame:
    return reports.supply_views(m.tables(), "month")["service"]


@query(
    "SELECT * FROM iq WHERE period_start IN (SELECT period_start FROM p)",
    q._summary(RC) + ", " + q._INVENTORY.replace("region_code, category,", "region_code,").replace("iv AS", "iq AS"),
)
def view_inventory(m: Model) -> DataFrame:
    """Levels of the periods that the commercial summary has."""
    return reports.supply_views(m.tables(), "month")["inventory"]


@query("SELECT 'month' AS period_type, period_start AS period, net_sales, lag(net_sales) OVER (ORDER BY period_start) AS previous, " + _R("net_sales - lag(net_sales) OVER (ORDER BY period_start)", 2) + " AS change FROM p ORDER BY period_start DESC LIMIT 1", q._summary([], "month").replace("GROUP BY ALL", "GROUP BY period_start"))
def view_overview(m: Model) -> DataFrame:
    o = reports.overview(m.tables(), "month")
    h = o["headline"]["net_sales"]
    return m.spark.createDataFrame([(o["period_type"], o["period"], h["value"], h["previous"], round(h["change"], 2))], "period_type string, period date, net_sales double, previous double, change double")


@query("SELECT DISTINCT period_start FROM p", q._summary(["region_code"], "week"))
def available_periods(m: Model) -> DataFrame:
    return reports.available_periods(mart.summarise_by_period(m.tables(), "week", ["region_code"], include_partial=True))


def _published(m: Model, name: str) -> DataFrame:
    return reports.flatten(reports.analysis_tables(m.tables(), m.returns())[name])


@query("SELECT * FROM p", q._summary([], "month").replace("GROUP BY ALL", "GROUP BY period_start"))
def published_monthly_trade(m: Model) -> DataFrame:
    return _published(m, "rpt_monthly_trade")


@query("SELECT * FROM dec", q._additive_sql(["region_code"]) + ", dec AS (" + q._finished("region_code", "region_code", "net_sales", "ad", "region_code, previous_value, current_value") + ")")
def published_region_contribution(m: Model) -> DataFrame:
    return _published(m, "rpt_country_contribution")


_REGION_RETURNS = q._RETURNS.replace("category", "region_code")


@query("SELECT * FROM dec", q._rate_sql(_REGION_RETURNS, ["region_code"], "returned_units", "sold_units", "return_rate", "0.01"))
def published_return_rate_split(m: Model) -> DataFrame:
    return _published(m, "rpt_return_rate_split")


# Calendar periods of the event stream's table, by the streaming operator run as a batch.


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS period_start, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_weeks(m: Model) -> DataFrame:
    return periods.period_totals(m.raw("events"), "week")
