"""Queries against their SQL on the small tables: rows, column names and values."""

import glob
import os

import duckdb
import pytest

from movewise.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SOME = ["commercial_mart", "mart_sql", "daily_sales_tracker", "supply_watchlist", "weekly_movers", "kam_scorecard", "sales_kpis", "mix_by_month", "growth", "trend_net_sales", "variance_target", "daily_series", "decompose_rate", "decompose_rate_folded", "coherence", "holdout", "persistence", "typical_swing", "detect_signals", "clean_audit", "validate_issues", "returns_by_period", "invoice_lines", "invoice_sales", "invoice_dim_sku", "invoice_summary", "cleaned_sales", "cleaned_orders", "validate_planted", "signals_of_a_rate", "report_daily_tracker", "report_plan_variance", "view_service", "csv_round_trip", "lake_round_trip", "compare_tables", "published_return_rate_split", "event_weeks", "invoice_csv_scan", "first_rows_in_file_order", "workbook_round_trip", "jdbc_scan", "mart_over_buckets", "scenario_outcomes", "signals_without_stock", "backtest_of_a_users_model", "sales_for_readers", "compare_dimensions", "view_overview_headline", "chart_service_over_time", "chart_stock_over_time", "chart_shortfalls", "guard_of_texts", "load_of_damaged_tables"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
