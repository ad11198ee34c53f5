from datetime import date

import pytest
from pyspark.sql import functions as F

from movewise.operators import clean, mart, signals, validate
from movewise.plans import narrate, reports, sql
from movewise.sources import generator, invoices, schema, store, workbook
from movewise.streaming import periods

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


@pytest.fixture(scope="module")
def sample(spark):
    return {k: v.cache() for k, v in generator.generate(spark).items()}


def test_sample_keeps_its_contract(spark, sample):
    issues = validate.validate(spark, sample)
    assert [r for r in issues.collect() if r["severity"] == "ERROR"] == []
    assert sample["fact_inventory"].count() == 60 * 4 * 28


def test_defects_are_found_and_cleaned(spark, sample):
    bad = generator.with_defects(sample)
    assert not validate.passed(validate.validate(spark, bad))
    with pytest.raises(validate.DatasetContractError):
        validate.gate(validate.validate(spark, bad))
    result = clean.clean(spark, bad)
    audit = {(r["table"], r["action"]): r["rows"] for r in result.audit.collect()}
    assert audit == {("fact_sales", "drop_exact_duplicates"): 2, ("fact_sales", "impute_discount_pct"): 1, ("fact_sales", "impute_unit_price"): 1, ("fact_orders", "impute_channel"): 1, ("fact_orders", "quarantine_invalid_quantities"): 1}
    assert validate.passed(validate.validate(spark, result.tables))
    assert result.quarantined["fact_orders"].count() == 1


def test_missing_tables(spark, sample):
    issues = {(r["table"], r["check"]) for r in validate.validate(spark, {"dim_kam": sample["dim_kam"].drop("kam_name")}).collect()}
    assert ("dim_kam", "required_columns") in issues and ("fact_sales", "table_present") in issues
    with pytest.raises(ValueError):
        clean.clean(spark, {})


def test_mart_counts_an_order_once(spark, sample):
    m = mart.commercial_mart(sample)
    assert m.agg(F.sum("ordered_units")).first()[0] == sample["fact_orders"].agg(F.sum("ordered_units")).first()[0]
    total = mart.commercial_metrics(mart.enrich_sales(sample, check=True), mart.enrich_orders(sample), ["date"]).agg(F.sum("order_count")).first()[0]
    assert total == sample["fact_orders"].select("order_id").distinct().count()
    with pytest.raises(ValueError):
        mart.commercial_mart(sample, ["region_code"])
    with pytest.raises(ValueError):
        mart.left_enrich(sample["fact_sales"], sample["dim_sku"].unionByName(sample["dim_sku"]), "sku_id", ["sku_name"], check=True)


def test_sql_views_agree_with_the_operators(spark, sample):
    store.build_database(spark, sample)
    a, b = spark.table("mart_commercial_daily"), mart.commercial_mart(sample)
    columns = [c for c in a.columns if c in b.columns]
    assert a.select(columns).exceptAll(b.select(columns)).isEmpty() and a.count() == b.count()
    assert all(sql.run_query(spark, q).columns for q in sql.available_queries())
    with pytest.raises(ValueError):
        sql.run_query(spark, "drop everything")


def test_planted_supply_constraint(spark, sample):
    found = reports.signal_report(sample, "fill_rate", ("region_code", "category"))["Signals"].collect()
    assert any(r["segment"].startswith("BLR") and r["likely_driver"] == "fulfilment_constraint" for r in found)
    assert all(not r["segment"].startswith("MUM") for r in found if r["confidence"] == "high")
    text = narrate.briefing(reports.signal_report(sample, "fill_rate")["Signals"])
    assert narrate.verify(text, [r.asDict() for r in found]).ok


def test_reports_and_views(spark, sample):
    assert set(reports.available_reports()) >= {"daily_sales_tracker", "forecast_report", "signal_report"}
    for name in ("daily_sales_tracker", "sales_performance", "fill_rate_report", "primary_secondary"):
        assert all(df.columns for df in reports.build_report(name, sample).values())
    o = reports.overview(sample)
    assert o["available"] and set(o["headline"]) >= {"net_sales", "fill_rate", "target"}
    assert reports.supply_views(sample)["by_sku"].count() == 15
    with pytest.raises(ValueError):
        reports.build_report("nothing", sample)


def test_scenarios(spark, sample, tmp_path):
    generator.write_dataset(spark, {"dim_kam": sample["dim_kam"]}, f"{tmp_path}/set")
    planted = generator.load_scenarios(spark, f"{tmp_path}/set")
    assert [s["name"] for s in planted] == ["supply", "softness", "mix", "quiet region", "quiet week"]
    dims = ["region_code", "category"]
    rows = signals.evaluate_scenarios(planted, mart.summarise_by_period(sample, "week", dims), dims, mart.inventory_by_period(sample["fact_inventory"], sample["dim_sku"], "week", dims)).cache()
    outcome = {(r["scenario"], r["confidence_floor"]): r["outcome"] for r in rows.collect()}
    assert outcome["supply", "high"] == "hit" and outcome["quiet region", "high"] == outcome["quiet week", "high"] == "correct_silence"
    high, medium = signals.summarise_evaluation(rows).orderBy("confidence_floor").collect()
    assert high["planted_scenarios"] == 3 and high["controls"] == 2 and high["false_alarm_signals"] <= medium["false_alarm_signals"]
    with pytest.raises(ValueError):
        generator.load_scenarios(spark, f"{tmp_path}/set/dim_kam.csv")


def test_scenarios_are_judged_by_whole_fields(spark):
    planted = [{"name": "x", "region_code": "EU", "metric": "m", "expected_pattern": "demand_softness", "starts": "2026-01-01", "current_period": "2026-01-05"}, {"name": "q", "region_code": "US", "metric": "m", "expected_pattern": None, "starts": None, "current_period": "2025-12-01"}]

    def outcome(*rows, scenarios=planted, floors=("high",)):
        """rows: case, region, category, pattern, confidence, priority."""
        kinds = "case string, region_code string, category string, likely_driver string, confidence string, priority_score double"
        found = spark.createDataFrame(rows, kinds).withColumn("segment", F.concat_ws(" | ", "region_code", "category"))
        return {(r["scenario"], r["confidence_floor"]): r for r in signals.judged(found, scenarios, floors=floors).collect()}

    assert outcome(("x", "EUROPE", "a", "demand_softness", "high", 1.0))["x", "high"]["outcome"] == "miss"
    got = outcome(("x", "EU", "b", "demand_softness", "high", 1.0), ("x", "EUROPE", "a", "x", "high", 2.0), ("x", "EU", "a", "x", "medium", 3.0))["x", "high"]
    assert (got["outcome"], got["rank"], got["matched_segment"], got["false_positives"], got["signals_returned"]) == ("hit", 2, "EU | b", ["EUROPE | a"], 2)
    both = outcome(("x", "EU", "a", "unclassified", "medium", 1.0), ("q", "EU", "a", "x", "low", 1.0), floors=("high", "medium"))
    assert [both["x", f]["outcome"] for f in ("high", "medium")] == ["miss", "wrong_pattern"] and both["q", "medium"]["outcome"] == "correct_silence"
    assert outcome(("q", "EU", "b", "x", "high", 1.0))["q", "high"]["outcome"] == "false_alarm"
    kinds = [planted[0] | {"categories": ["b", "c"]}]
    assert outcome(("x", "EU", "a", "demand_softness", "high", 1.0), scenarios=kinds)["x", "high"]["outcome"] == "miss"
    assert outcome(("x", "EU", "c", "demand_softness", "high", 1.0), scenarios=kinds)["x", "high"]["outcome"] == "hit"
    assert outcome()["q", "high"]["outcome"] == "correct_silence"


def test_many_cases_at_once(spark, sample):
    """As many runs for one case each; refused are cases that the summary cannot answer."""
    dims = ["region_code", "category"]
    summary, stock = mart.summarise_by_period(sample, "week", dims), mart.inventory_by_period(sample["fact_inventory"], sample["dim_sku"], "week", dims)
    weeks = [r[0] for r in summary.select("period_start").distinct().orderBy("period_start").collect()]
    cases = [signals.Case(f"{m} {k}", m, weeks[k], weeks[k - d]) for m, k, d in (("net_sales", 5, 1), ("fill_rate", 7, 1), ("fill_rate", 4, 2), ("aov", 3, 1))]
    together = {(r["case"], r["segment"]): r for r in signals.detect_cases(summary, cases, dims, stock, 4, "absolute").drop(*dims).collect()}
    assert len(together) == 16
    for c in cases[1:]:
        alone = signals.detect(summary, c.metric, dims, stock, c.current, c.comparison, 4, "absolute").collect()
        assert all(tuple(together[c.name, r["segment"]])[1:] == tuple(r) for r in alone) and len(alone) == 4
    for bad in (signals.Case("a", "nothing", weeks[1], weeks[0]), signals.Case("a", "net_sales", weeks[0], weeks[1]), signals.Case("a", "net_sales", weeks[1], weeks[0].replace(year=2020))):
        with pytest.raises(ValueError):
            signals.detect_cases(summary, [bad], dims)
    with pytest.raises(ValueError):
        signals.detect_cases(summary, [cases[0], cases[0]], dims)


def test_datasets_side_by_side(spark, sample):
    store.build_database(spark, sample, suffix="_one")
    store.build_database(spark, sample | {"fact_sales": sample["fact_sales"].where("region_code = 'BLR'")}, suffix="_two")
    one, two = (sql.run_query(spark, "target_variance", s).agg(F.sum("net_sales")).first()[0] for s in ("_one", "_two"))
    assert two < one and {"fact_sales_one", "mart_commercial_daily_two"} <= set(store.available_tables(spark))


def test_bad_dates_and_lost_returns(spark, sample):
    with pytest.raises(Exception, match="no date"):
        mart.with_period(sample["fact_sales"].withColumn("date", F.lit(None).cast("date")), "week").collect()
    back = sample["fact_sales"].select("date", "region_code", (F.col("units") - 1).alias("returned_units"))
    full = mart.returns_by_period(sample["fact_sales"], back, "week", ["region_code"], include_partial=True)
    assert mart.lost_returns(full, back) == 0 and mart.lost_returns(full.where("region_code <> 'BLR'"), back) > 0


def test_command_line_parts(spark, sample, tmp_path):
    sheets = reports.build_report("primary_secondary", sample)
    assert {r["item"] for r in sheets["Cover"].collect()} >= {"report", "first date", "sheet", "note"}
    reports.write_csv(sheets, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out/by_region_code", header=True).count() == 4
    reports.write_workbook("primary_secondary", sample, f"{tmp_path}/report.xlsx")
    book = workbook.Book(f"{tmp_path}/report.xlsx")
    assert list(book.sheets) == ["Read me", *[s for s in sheets if s != "Cover"]]
    assert workbook.read_sheet(spark, f"{tmp_path}/report.xlsx", "By region_code").columns == sheets["By region_code"].columns
    found = reports.signal_report(sample)["Signals"]
    assert narrate.verify(narrate.summary(found), narrate.package(found)["signals"] + [{"n": found.count(), "sum": sum(r["impact"] or 0 for r in found.collect())}]).ok
    assert "claim no cause" in narrate.prompt(found.first().asDict())


def test_guard():
    package = {"impact": {"value": 8970.60}, "evidence": {"fulfilled_change": -0.162, "ordered_change": 0.182}}
    for text in ("fell 16%", "16.2%", "8,971", "8,970.60", "18%", "on 2026-02-23 and in 2025, 3 of 6"):
        assert narrate.verify(text, package).ok, text
    for text in ("19%", "17%", "99,999", "41.3%", "this led to a fall"):
        assert not narrate.verify(text, package).ok, text


INVOICES = (
    HEADER
    + '1,85123A,"WHITE, ""HEART"" HOLDER",6,2010-12-01 08:26:00,2.55,13085.0,United Kingdom\n'
    + "1,85123a ,,4,2010-12-01 08:26:00,2.75,13085.0,United Kingdom\n"
    + '2,15056bl,"EDWARDIAN\nPARASOL",2,2010-12-02 08:26:00,0.5025,,France\n'
    + "C3,15056BL,EDWARDIAN,3,2010-12-03 08:26:00,5.95,17850,France\n"
    + "4,15056BL,EDWARDIAN,-1,2010-12-03 08:26:00,5.95,17850,France\n"
    + "5,ZERO,   ,0,2010-12-04 08:26:00,0,17850,France\n"
)


def test_invoices(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(INVOICES)
    a = invoices.adapt(spark, invoices.read_raw(spark, str(path)))
    assert a.counts == {"source_lines": 6, "return_lines": 2, "consolidated_lines": 1}
    rows = {r["name"]: r["rows"] for r in a.summary().collect()}
    assert rows["fact_sales"] == 3 and rows["returns"] == 2 and rows["fact_orders"] == 0
    sales = {r["order_id"]: r for r in a.tables["fact_sales"].collect()}
    assert sales["1"]["units"] == 10 and sales["1"]["unit_price"] == round((6 * 2.55 + 4 * 2.75) / 10, 4) and sales["1"]["customer_id"] == "13085"
    assert sales["2"]["net_sales"] == 1.0 and sales["2"]["customer_id"] == "UNKNOWN" and sales["5"]["units"] == 0
    assert a.returns.agg(F.sum("returned_units")).first()[0] == 4
    skus = {r["sku_id"]: r for r in a.tables["dim_sku"].collect()}
    assert skus["85123A"]["category"] == "WHITE," and skus["ZERO"]["category"] == "UNKNOWN" and skus["ZERO"]["list_price"] == 0.0
    assert skus["85123A"]["list_price"] == 2.65 and skus["85123A"]["unit_cost"] == 1.855 and skus["85123A"]["pack_size_kg"] == 1.0
    assert {r["customer_id"]: r["customer_name"] for r in a.tables["dim_customer"].collect()} == {"13085": "Customer 13085", "UNKNOWN": "Unidentified customer", "17850": "Customer 17850"}
    c = a.capabilities
    assert c.supports("trend_analysis") and not c.supports("fulfilment_analysis") and "fact_orders" in c.why_unsupported("supply_signals") and c.why_unsupported("sales_kpis") == ""
    assert c.as_dict()["missing_facts"] == ["fact_orders", "fact_inventory", "fact_targets", "fact_kam_targets"] and any("1 lines repeat" in n for n in c.notes) and "can answer: forecasting" in c.describe()
    for call in (lambda: c.supports("astrology"), lambda: a.require("kam_performance")):
        with pytest.raises(ValueError):
            call()


def test_sheets_and_missing_keys(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,A,FIRST NAME,1,2010-12-01 08:26:00,2,1,UK\n")
    (tmp_path / "b.csv").write_text(HEADER + "1,a,LATER NAME,2,2010-12-01 08:26:00,3,1,UK\n")
    a = invoices.adapt(spark, invoices.read_raw(spark, f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"))
    assert a.counts["consolidated_lines"] == 1 and a.tables["dim_sku"].first()["sku_name"] == "FIRST NAME" and a.tables["fact_sales"].first()["net_sales"] == 8.0
    (tmp_path / "c.csv").write_text(HEADER + ",A,X,1,2010-12-01 08:26:00,2,1,UK\n")
    with pytest.raises(ValueError, match="1 lines"):
        invoices.adapt(spark, invoices.read_raw(spark, f"{tmp_path}/c.csv"))


def test_without_repeats_prices_stay(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + "1,A,X Y,3,2010-12-01 08:26:00,0.3333333,1,UK\n")
    a = invoices.adapt(spark, invoices.read_raw(spark, str(path)))
    assert a.tables["fact_sales"].first()["unit_price"] == 0.3333333


def test_lake_and_store(spark, tmp_path, sample):
    lake = store.Lake(spark, f"file://{tmp_path}/lake")
    lake.write(sample["dim_kam"], "clean", "dim_kam", typed=True)
    lake.write_summary({"rows": 4})
    assert lake.exists("clean", "dim_kam") and not lake.exists("clean", "dim_ka") and lake.read_summary() == {"rows": 4}
    assert lake.read_curated("clean")["fact_orders"].schema == schema.struct("fact_orders")
    with pytest.raises(ValueError):
        store.safe_name("x; drop")
    sample["dim_region"].write.csv(f"{tmp_path}/set/dim_region.csv", header=True)
    assert store.load_dataset(spark, f"{tmp_path}/set")["dim_region"].count() == 4
    with pytest.raises(FileNotFoundError):
        store.load_dataset(spark, f"{tmp_path}/none")
    result = clean.clean(spark, generator.with_defects(sample))
    clean.write_cleaned(result, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/quarantine/fact_orders").count() == 1


def test_streamed_periods(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(f"2026-01-{d:02d} 10:00:00", "buy", 1.5) for d in (5, 6, 12, 30)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    df = periods.period_totals(periods.stream_events(spark, src, spark.read.parquet(src).schema), "week")
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert {(r["period_start"], r["events"]) for r in spark.read.parquet(out).collect()} == {(date(2026, 1, 5), 2), (date(2026, 1, 12), 1)}


def test_a_repeated_key_is_refused_by_default(sample):
    twice = {**sample, "dim_sku": sample["dim_sku"].unionByName(sample["dim_sku"].limit(1))}
    for run in (mart.enrich_sales, mart.enrich_orders, mart.commercial_mart, lambda t: mart.summarise_by_period(t, "month", ["category"])):
        with pytest.raises(ValueError, match="sku_id repeats"):
            run(twice)
