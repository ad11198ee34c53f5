"""Command line: python -m movewise <command> <dataset folder> <output folder> [--option value].

query NAME, report NAME, charts NAME (sales, supply or forecast), signals, forecast, scenarios, load, sample. Results are CSV folders, reports with
--workbook one .xlsx file; load publishes a warehouse under the output folder. The dataset is a folder of
<table>.csv, .parquet or .xlsx, cleaned and gated first.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import clean, mart, signals
from .plans import charts, reports, sql, stages
from .sources import generator, store
from .sources.warehouse import Warehouse


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="movewise", description=__doc__)
    parser.add_argument("command", choices=["query", "report", "charts", "signals", "forecast", "scenarios", "load", "sample"])
    parser.add_argument("dataset")
    parser.add_argument("output")
    parser.add_argument("--name", help="of a query, report or page of charts")
    parser.add_argument("--metric", default="net_sales")
    parser.add_argument("--period", default="week")
    parser.add_argument("--by", default="region_code,category")
    parser.add_argument("--top", type=int, default=5)
    parser.add_argument("--workbook", action="store_true")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("movewise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    dims = args.by.split(",")
    if args.command == "sample":
        generator.write_dataset(spark, generator.generate(spark), args.output)
        return
    if args.command == "load":
        raw = {t: df.drop("_row") for t, df in store.load_dataset(spark, args.dataset, typed=True).items()}
        done = stages.load(spark, raw, Warehouse(spark, args.output))
        done.tables.show(truncate=False)
        return
    cleaned, _ = clean.load_business_data(spark, args.dataset)
    t = cleaned.tables
    if args.command == "query":
        store.build_database(spark, t)
        out = {args.name: sql.run_query(spark, args.name)}
    elif args.command == "charts":
        out = charts.PAGES[args.name](t)
    elif args.command == "scenarios":
        planted = generator.load_scenarios(spark, args.dataset)
        rows = signals.evaluate_scenarios(planted, mart.summarise_by_period(t, "week", dims), dims, mart.inventory_by_period(t["fact_inventory"], t["dim_sku"], "week", dims))
        out = {"scenarios": rows, "rates": signals.summarise_evaluation(rows)}
    elif args.workbook:
        name = {"signals": "signal_report", "forecast": "forecast_report"}.get(args.command, args.name)
        reports.write_workbook(name, t, args.output)
        return
    elif args.command == "signals":
        out = reports.build_report("signal_report", t, metric=args.metric, dims=tuple(dims), period=args.period, top_n=args.top)
    else:
        out = reports.build_report("forecast_report" if args.command == "forecast" else args.name, t)
    reports.write_csv(out, args.output)


if __name__ == "__main__":
    main()
