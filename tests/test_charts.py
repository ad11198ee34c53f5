"""Charts and texts on small tables: folding, stable slots, nulls, ties, empty tables; the guard against the one in Python."""

import random

import pytest
from pyspark.sql import functions as F

from movewise.plans import charts, narrate

SCHEMA = "period_start string, region_code string, net_sales double, sales_units long, ordered_units long, fulfilled_units long, order_count long"


@pytest.fixture(scope="module")
def frame(spark):
    rng, rows = random.Random(4), []
    for p in ("2024-01", "2024-02"):
        for r in ["A", "B", "C", "D", "E", None]:
            rows.append((p, r, round(rng.random() * 100, 2), rng.randint(0, 9), rng.randint(0, 20), rng.randint(0, 9), 1))
    return spark.createDataFrame(rows, SCHEMA), rows


def test_series_fold_and_keep_their_slots(frame):
    df, rows = frame
    size = {r: sum(x[2] for x in rows if x[1] == r) for r in "ABCDE"}
    kept = sorted(sorted(size, key=lambda r: (-size[r], r))[:2])
    series = charts.slots(df, "region_code", "net_sales", 3)
    assert sorted(tuple(r) for r in series.collect()) == [(r, i) for i, r in enumerate(kept)]
    assert [tuple(r) for r in charts.slots(df, "region_code", "net_sales", 5).orderBy("slot").collect()] == list(zip("ABCDE", range(5), strict=True))
    want = {}
    for p, r, net, _, placed, done, _ in rows:
        cell = want.setdefault((p, r if r in kept else "Other"), [0, 0, 0])
        want[p, r if r in kept else "Other"] = [cell[0] + round(net * 100), cell[1] + done, cell[2] + placed]
    got = {(r[0], r[1]): (r[2], r[3]) for r in charts.over_time(df, "period_start", "net_sales", "region_code", series).collect()}
    assert got == {(p, s): (kept.index(s) if s in kept else -1, v[0] / 100) for (p, s), v in want.items()}
    rates = {(r[0], r[1]): r[3] for r in charts.over_time(df, "period_start", "fill_rate", "region_code", series).collect()}
    assert rates == {k: pytest.approx(v[1] / v[2], abs=6e-5) if v[2] else None for k, v in want.items()}
    alone = charts.over_time(df.where(F.col("region_code") == kept[1]), "period_start", "net_sales", "region_code", series).collect()
    assert {(r["series"], r["slot"]) for r in alone} == {(kept[1], 1)}  # a filter repaints nothing


def test_totals_bars_gaps_and_parts(spark, frame):
    df, rows = frame
    assert sorted(tuple(r) for r in charts.totals(df, "region_code").collect()) == [(r, *[round(sum(x[c] for x in rows if x[1] == r), 2) for c in (2, 3, 6)]) for r in "ABCDE"]
    with pytest.raises(ValueError, match="do not add up"):
        charts.totals(df.withColumn("fill_rate", F.lit(1.0)), "region_code", ["fill_rate"])
    with pytest.raises(ValueError, match="two series"):
        charts.slots(df, "region_code", "net_sales", 1)
    ties = spark.createDataFrame([("b", -1.0), ("a", -1.0), ("c", None), ("d", 2.0), ("e", 0.0)], "segment string, variance double")
    assert [tuple(r) for r in charts.gaps(ties, "segment", "variance").orderBy("position").collect()] == [(1, "a", -1.0, "behind"), (2, "b", -1.0, "behind"), (3, "e", 0.0, "even"), (4, "d", 2.0, "ahead")]
    assert [r[1] for r in charts.bars(df, "region_code", "order_count", 3).orderBy("position").collect()] == ["A", "B", "C"]
    mix = spark.createDataFrame([("A", 3.0, 1.0), ("B", 0.0, 0.0), ("C", None, 2.0)], "region_code string, x double, y double")
    got = charts.stacked(mix, "region_code", ["x", "y"]).orderBy("region_code", "slot").collect()
    assert [(r["value"], r["share"]) for r in got] == [(3.0, 0.75), (1.0, 0.25), (0.0, None), (0.0, None), (None, None), (2.0, 1.0)]
    assert [tuple(r) for r in charts.against_expected(mix, "region_code", "x", "y").where("region_code = 'A'").collect()] == [("A", "Actual", 3.0), ("A", "Expected", 1.0)]


def test_empty_charts(spark):
    none = spark.createDataFrame([], SCHEMA)
    series = charts.slots(none, "region_code", "net_sales")
    assert charts.over_time(none, "period_start", "net_sales", "region_code", series).isEmpty() and series.isEmpty() and charts.bars(none, "region_code", "net_sales").isEmpty()


SIGNAL = "metric string, segment string, movement double, movement_pct double, period date, comparison_period date, likely_driver string, alternative_supported boolean, impact double, confidence string, criteria_met int, recommended_investigation string"


def test_texts_and_their_guard_agree_with_python(spark):
    rng, rows = random.Random(6), []
    for k in range(60):
        metric = rng.choice(["net_sales", "fill_rate", "aov", "order_count", "return_rate"])
        move = rng.choice([0.0, 0.5, -0.0123, 1234567.5, -98765.4321, 2.5, 0.0625])
        rows.append((metric, f"EAST {k} | STEEL", move, rng.choice([None, 0.0, -0.1235, 12.3456, 0.0005]), None, None, rng.choice(["unclassified", "demand_softness", "something_new"]), rng.choice([None, True, False]), rng.choice([None, 0.0, 1234.565, -3.1]), "high", rng.randint(0, 6), rng.choice([None, "", "Look at 7 stores."])))
    df = spark.createDataFrame(rows, SIGNAL).withColumns({"period": F.lit("2024-02-01").cast("date"), "comparison_period": F.lit("2024-01-01").cast("date")})
    got = [r.asDict() for r in narrate.told(df).collect()]
    assert [r["text"] for r in got] == [narrate.explain(r) for r in got]
    added = F.expr("concat(text, element_at(array('', ' It is 55.5% now.', ' In 1998 and 11 times.', ' Due to 4,321 things.', ' A change of +12.3%.'), 1 + cast(criteria_met % 5 as int)))")
    said = narrate.told(df).withColumn("said", added)
    for r in narrate.guarded(said.drop("text"), "said").collect():
        facts = r.asDict()
        text = facts.pop("said")
        verdict = narrate.verify(text, {k: v for k, v in facts.items() if k not in ("ok", "figures", "phrases")})
        assert (r["ok"], tuple(r["figures"]), tuple(r["phrases"])) == (verdict.ok, verdict.figures, verdict.phrases), text
    odd = narrate.told(df.limit(1).withColumn("movement", F.lit(None).cast("double")))
    assert odd.first()["text"] is None and narrate.guarded(odd, "text").first()["ok"]


def test_levels_are_averaged_after_folding(spark):
    rows = [("2024-01-01", r, 1, float(s), 0, 0, s, f, o) for r, s, f, o in [("A", 10, 0, 1), ("B", 4, 1, 1), ("B", 4, 0, 1), ("C", 1, 1, 1), (None, 7, 0, 1)]]
    stock = spark.createDataFrame([(*r,) for r in rows], "date string, region_code string, sku_id int, opening_stock double, received_units int, fulfilled_units int, available_stock int, stockout_flag int, ordered_units int").withColumn("date", F.to_date("date"))
    series = spark.createDataFrame([("A", 0)], "region_code string, slot int")
    got = {r["series"]: (r["slot"], r["available_stock"], r["stockout_rate"]) for r in charts.stock_over_time(stock, spark.range(1), "week", "region_code", series).collect()}
    assert got == {"A": (0, 10.0, 0.0), "Other": (-1, 4.0, 0.5)}


def test_charts_from_the_command_line(spark, tmp_path):
    from movewise.__main__ import main
    from movewise.sources import generator

    generator.write_dataset(spark, generator.generate(spark), f"{tmp_path}/data")
    main(["charts", f"{tmp_path}/data", f"{tmp_path}/out", "--name", "supply"])
    gaps = spark.read.csv(f"{tmp_path}/out/gaps_to_target", header=True, inferSchema=True)
    assert gaps.count() == 12 and gaps.columns == ["position", "period_start", "segment", "variance", "side"]
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"fill_rate_by_region", "stock_by_region", "gaps_to_target", "unserved_products"}
