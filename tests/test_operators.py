from datetime import date

import pytest
from pyspark.sql import functions as F

from movewise.functions.exprs import half_even, label, period_end, period_start, ratio
from movewise.operators import compare, decompose, forecast, kpi, mart, signals, variance

W1, W2 = date(2026, 2, 9), date(2026, 2, 16)


def one(df):
    return df.first().asDict()


def test_half_even_is_the_double_rule(spark):
    df = spark.createDataFrame([(0.5025, 2), (2.5, 1), (-1e-17, 1)], "x double, n int")
    assert [r[0] for r in df.select(half_even(F.col("x") * F.col("n"), 2)).collect()] == [1.0, 2.5, 0.0]


def test_ratio_and_label(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 5, "b")], "a int, b int, c string")
    assert [r[0] for r in df.select(ratio("a", "b", 4)).collect()] == [None, 0.4]
    assert [r[0] for r in df.select(label(["a", "c"])).collect()] == ["1 | None", "2 | b"]


def test_periods(spark):
    df = spark.createDataFrame([(date(2026, 2, 15),)], "d date")
    assert df.select(period_start("d", "week")).first()[0] == W1
    assert df.select(period_end(period_start("d", "month"), "month")).first()[0] == date(2026, 2, 28)
    with pytest.raises(ValueError):
        period_start("d", "year")


def test_calendar_completeness(spark):
    ends = spark.createDataFrame([(date(2026, 1, 6), date(2026, 1, 18))], "first_date date, last_date date")
    assert [(r["period_start"], r["is_complete"]) for r in mart.period_calendar(ends, "week").orderBy("period_start").collect()] == [(date(2026, 1, 5), False), (date(2026, 1, 12), True)]


def test_kpis(spark):
    sales = spark.createDataFrame([("O1", "a", 2, 100.0, 0.0, 200.0), ("O1", "b", 3, 50.0, 0.0, 150.0), ("O2", "a", 1, 100.0, 0.1, 90.0)], "order_id string, sku_id string, units int, unit_price double, discount_pct double, net_sales double")
    k = one(kpi.sales_kpis(sales.withColumn("date", F.lit(W1))))
    assert (k["order_count"], k["units"], k["net_sales"], k["aov"], k["discount_value"]) == (2, 6, 440.0, 220.0, 10.0)
    orders = spark.createDataFrame([("O1", 10, 8, 2), ("O2", 5, 5, 0)], "order_id string, ordered_units int, fulfilled_units int, cancelled_units int").withColumn("date", F.lit(W1))
    k = one(kpi.order_kpis(orders))
    assert k["fill_rate"] == 0.8667 and k["cancellation_rate"] == 2 / 15
    mix = spark.createDataFrame([(W1, "PRIMARY", 100.0), (W1, "PRIMARY", 50.0), (W1, "SECONDARY", 50.0)], "date date, sales_type string, net_sales double")
    m = one(kpi.primary_secondary_mix(mix))
    assert (m["total_sales"], m["primary_mix"], m["secondary_mix"]) == (200.0, 0.75, 0.25)


def test_growth(spark):
    df = spark.createDataFrame([(date(2026, 1, i + 1), v) for i, v in enumerate([0.0, 1.0, 4.0, 5.0])], "period_start date, v double")
    assert [r["growth"] for r in kpi.add_growth(df, "v").orderBy("period_start").collect()] == [None, None, 3.0, 0.25]


def test_trend_and_variance(spark):
    df = spark.createDataFrame([(date(2026, 1, 5), "BLR", "week", 100.0), (date(2026, 1, 12), "BLR", "week", 120.0), (date(2026, 1, 5), "MUM", "week", 200.0), (date(2026, 1, 12), "MUM", "week", 180.0)], "period_start date, region_code string, period_type string, net_sales double")
    got = {r["region_code"]: (r["absolute_change"], r["pct_change"]) for r in variance.trend(df, "net_sales", ["region_code"]).collect()}
    assert got == {"BLR": (20.0, 0.2), "MUM": (-20.0, -0.1)}
    top = variance.rank(variance.versus_previous(df, "net_sales", ["region_code"])).collect()
    assert [r["segment"] for r in top] == ["MUM"]
    with pytest.raises(ValueError):
        variance.trend(df, "net_sales", ["region_code"], 0)
    with pytest.raises(ValueError):
        variance.versus_target(df, df, "net_sales", "nothing", "week")


def summary(spark, rows, columns):
    return spark.createDataFrame(rows, f"period_start date, region_code string, {columns}")


def test_additive_decomposition(spark):
    s = summary(spark, [(W1, "BLR", 100.0), (W2, "BLR", 60.0), (W1, "MUM", 200.0), (W2, "MUM", 190.0)], "net_sales double")
    got = {r["segment"]: (r["contribution"], r["contribution_share"]) for r in decompose.decompose_additive(s, "net_sales", ["region_code"]).collect()}
    assert got == {"BLR": (-40.0, 0.8), "MUM": (-10.0, 0.2)}
    s = summary(spark, [(W1, "A", 1000.0), (W2, "A", 1500.0), (W1, "B", 1000.0), (W2, "B", 501.0)], "net_sales double")
    d = decompose.decompose_additive(s, "net_sales", ["region_code"])
    assert decompose.total_movement(d) == 1.0 and all(r["contribution_share"] is None and r["share_of_absolute_movement"] for r in d.collect())
    s = summary(spark, [(W1, "BLR", 100.0), (W2, "BLR", 100.0), (W2, "NEW", 30.0)], "net_sales double")
    assert {r["segment"]: r["contribution"] for r in decompose.decompose_additive(s, "net_sales", ["region_code"]).collect()}["NEW"] == 30.0


def test_mix_trap(spark):
    s = summary(spark, [(W1, "A", 90, 100), (W2, "A", 19, 20), (W1, "B", 50, 100), (W2, "B", 99, 180)], "fulfilled_units int, ordered_units int")
    d = decompose.decompose_rate(s, "fill_rate", ["region_code"])
    sums = d.agg(F.sum("rate_effect"), F.sum("mix_effect"), F.sum("interaction_effect"), F.sum("contribution")).first()
    assert [round(x, 9) for x in sums] == [0.05, -0.16, 0.0, -0.11]
    assert decompose.dominant_component(d) == "mix_effect"


def test_entering_thin_and_stranded_segments(spark):
    s = summary(spark, [(W1, "A", 90, 100), (W2, "A", 90, 100), (W2, "NEW", 25, 50)], "fulfilled_units int, ordered_units int")
    new = {r["segment"]: r for r in decompose.decompose_rate(s, "fill_rate", ["region_code"]).collect()}["NEW"]
    assert new["rate_effect"] == 0.0 and new["mix_effect"] != 0
    rows = [(W1, "BIG", 880, 10000), (W2, "BIG", 970, 10000)] + [x for n, v in (("A", 3), ("B", 2), ("C", 4)) for x in ((W1, n, v, 4), (W2, n, 0, 4))]
    s = summary(spark, rows, "returned_units int, sold_units int")
    d = decompose.decompose_rate(s, "return_rate", ["region_code"], min_share=0.05)
    assert sorted(r["segment"] for r in d.collect()) == ["BIG", decompose.OTHER]
    s = summary(spark, [(W1, "NORTH", 50, 1000), (W2, "NORTH", 60, 1000), (W1, "SOUTH", 0, 0), (W2, "SOUTH", 40, 0)], "returned_units int, sold_units int")
    with pytest.raises(ValueError, match="SOUTH.*min_share"):
        decompose.decompose_rate(s, "return_rate", ["region_code"])


def test_period_errors(spark):
    s = summary(spark, [(W1, "A", 1.0)], "net_sales double")
    with pytest.raises(ValueError):
        decompose.resolve_periods(s)
    s = summary(spark, [(W1, "A", 1.0), (W2, "A", 2.0)], "net_sales double")
    with pytest.raises(ValueError):
        decompose.resolve_periods(s, W1, W2)
    with pytest.raises(ValueError):
        decompose.decompose_additive(s, "fill_rate", ["region_code"])


def series(spark, values):
    return spark.createDataFrame([(date.fromordinal(date(2026, 1, 1).toordinal() + i), float(v)) for i, v in enumerate(values)], "date date, y double")


def values(df, model):
    return [r["forecast"] for r in df.where(F.col("model") == model).orderBy("date").collect()]


def test_forecasters(spark):
    s = series(spark, range(1, 15))
    f = forecast.forecast(s, horizon=10).cache()
    assert values(f, "naive")[:3] == [14.0] * 3
    assert values(f, "seasonal_naive_7") == [8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0, 8.0, 9.0, 10.0]
    assert values(f, "seasonal_mean_7")[:7] == [4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 10.5]
    assert values(f, "moving_average_7")[:2] == [11.0, 11.0]
    assert values(forecast.forecast(s, {"ses": forecast.exponential(1.0)}, 2), "ses") == [14.0, 14.0]
    assert f.agg(F.min("date")).first()[0] == date(2026, 1, 15)


def test_backtest_sees_no_future(spark):
    p = forecast.backtest(series(spark, range(60))).cache()
    assert p.count() == 4 * 7 * 5 and p.where("date <= origin_date").isEmpty()
    weekly = [x % 7 for x in range(56)]
    a = forecast.backtest(series(spark, weekly)).where("fold = 1").select("model", "date", "forecast")
    b = forecast.backtest(series(spark, weekly[:28] + [99999] * 28)).where("fold = 1").select("model", "date", "forecast")
    assert a.exceptAll(b).isEmpty()


def test_scores(spark):
    p = spark.createDataFrame([("m", 10.0, 12.0), ("m", 20.0, 18.0), ("m", 30.0, 33.0)], "model string, actual double, forecast double")
    s = one(forecast.scores(p))
    assert (s["mae"], s["wape"], s["bias"], s["mape"]) == (2.3333, 0.1167, 1.0, 0.1333)


def test_history_checks_and_gaps(spark):
    with pytest.raises(ValueError):
        forecast.check_history(series(spark, range(5)).where("y <> 2"))
    with pytest.raises(ValueError):
        forecast.check_history(series(spark, []))
    for bad in (series(spark, range(60)).where("y <> 20"), series(spark, []), series(spark, range(60)).withColumn("y", F.when(F.col("y") != 9, F.col("y"))), series(spark, range(40)).unionByName(series(spark, [5]))):
        for run in (forecast.forecast, forecast.backtest):
            with pytest.raises(Exception, match="history"):
                run(bad).collect()
    sales = spark.createDataFrame([(date(2026, 1, 1), 5.0, 1), (date(2026, 1, 4), 6.0, 2)], "date date, net_sales double, units int")
    orders = spark.createDataFrame([(date(2026, 1, 1), "O1")], "date date, order_id string")
    assert [r["net_sales"] for r in forecast.daily_series(sales, orders).orderBy("date").collect()] == [5.0, 0.0, 0.0, 6.0]


def test_persistence_and_swing(spark):
    rows = [(date(2026, 1, 5 + 7 * i), "A", v) for i, v in enumerate([0.99, 0.95, 0.90])] + [(date(2026, 1, 5 + 7 * i), "B", v) for i, v in enumerate([0.99, 0.80, 0.85])]
    s = summary(spark, rows, "fill_rate double")
    got = {r["region_code"]: r["streak"] for r in signals.persistence(s, "fill_rate", ["region_code"], date(2026, 1, 19)).collect()}
    assert got == {"A": 2, "B": 1}
    assert {r["region_code"]: r["typical"] for r in signals.typical_swing(s, "fill_rate", ["region_code"]).collect()} == {"A": 0.045, "B": 0.12}


def test_no_shared_date(spark):
    a = spark.createDataFrame([(W1, 1.0)], "date date, value double")
    with pytest.raises(ValueError, match="no date"):
        variance.versus_forecast(a, a.select(F.date_add("date", 1).alias("date"), F.col("value").alias("forecast")), "orders")


def test_impact(spark):
    c = lambda x: F.lit(float(x))
    row = spark.range(1).select(signals.shortfall(c(200), c(150), c(0.9), c(1500)), signals.unfulfilled(c(200), c(150), c(1500)), signals.shortfall(c(100), c(99), c(0.9), c(990))).first()
    assert tuple(row) == (300.0, 500.0, 0.0)


@pytest.mark.parametrize(
    ("before", "after", "component", "driver", "alternative"),
    [
        ((167, 161, 0.964, 28.8, 0.0), (230, 175, 0.761, 18.3, 0.214), "contribution", "fulfilment_constraint", False),
        ((100, 95, 0.95, 20.0, 0.0), (60, 57, 0.95, 20.0, 0.0), "contribution", "demand_softness", False),
        ((100, 95, 0.95, 20.0, 0.0), (60, 57, 0.95, 10.0, 0.5), "contribution", "demand_softness", True),
        ((100, 95, 0.95, 20.0, 0.0), (100, 95, 0.95, 20.0, 0.0), "mix_effect", "portfolio_mix_shift", False),
        ((100, 95, 0.95, 20.0, 0.0), (100, 95, 0.95, 20.0, 0.0), "contribution", "unclassified", None),
        ((100, 95, None, 20.0, 0.0), (100, 95, None, 20.0, 0.0), "contribution", "unclassified", None),
    ],
)
def test_patterns(spark, before, after, component, driver, alternative):
    names = ["ordered_units", "fulfilled_units", "fill_rate", "available_stock", "stockout_rate"]
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in (*before, *after))], ", ".join(f"{n}_{k} double" for k in ("before", "after") for n in names))
    df = df.withColumns({f"{n}_dir": signals.direction(F.col(f"{n}_before"), F.col(f"{n}_after")) for n in names})
    row = signals.classified(df, component).first()
    assert (row["likely_driver"], row["alternative_supported"]) == (driver, alternative)


def test_status_and_fold(spark):
    df = spark.createDataFrame([(0.95, 0.9), (0.88, 0.9), (0.8, 0.9), (0.5, 0.9), (None, 0.9)], "r double, t double")
    assert [r[0] for r in df.select(decompose.service_status("r", "t")).collect()] == ["On target", "Slightly below", "Below target", "Well below", "No demand"]


def test_compare(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 3.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12), ("y", 2.5), ("z", 1.0), (None, 3.0)], "k string, v double")
    assert {r["k"]: (r["side"], r["columns"]) for r in compare.differences(a, b, ["k"]).collect()} == {"y": ("both", ["v"]), "z": ("right", None)}


def test_forecasters_in_python(spark):
    class Middle(forecast.Forecaster):
        """The median of the last days, and what a fold sees of its history."""

        def __init__(self, days, wrong=None):
            self.days, self.wrong = days, wrong

        def fit(self, y):
            assert y.index.is_monotonic_increasing and str(y.index.freq) == "<Day>"
            self.value = float(y.iloc[-self.days :].median()) + len(y) / 1000
            return self

        def predict(self, horizon):
            return self.wrong if self.wrong is not None else [self.value] * horizon

    both = series(spark, range(60)).withColumn("g", F.lit("a")).unionByName(series(spark, range(100, 150)).withColumn("g", F.lit("b")))
    got = forecast.backtest(both, {"middle": Middle(3), "naive": forecast.naive}, by=["g"]).collect()
    assert len(got) == (4 + 3) * 7 * 2
    start = min(r["date"] for r in both.collect())
    for r in got:
        n = (r["origin_date"] - start).days + 1
        last = n - 1 + (100 if r["g"] == "b" else 0)
        assert r["forecast"] == (last - 1 + n / 1000 if r["model"] == "middle" else last)
    ahead = forecast.forecast(both, {"middle": Middle(1)}, 2, ["g"]).collect()
    assert sorted((r["g"], r["forecast"]) for r in ahead) == [("a", 59.06), ("a", 59.06), ("b", 149.05), ("b", 149.05)]
    for wrong in ([1.0], [float("nan")] * 7):
        with pytest.raises(Exception, match="middle gave"):
            forecast.backtest(both, {"middle": Middle(1, wrong)}, by=["g"]).collect()


def test_smoothing_along_the_series_is_smoothing_of_each_fold(spark):
    import random

    rng = random.Random(3)
    s = series(spark, [rng.choice([rng.random() * 50, 7.0, 0.0]) for _ in range(90)])
    for alpha in (None, 0.3):
        model = forecast.exponential(alpha)
        plain = forecast.flat(lambda h, n, step, model=model: model(h, n, step))
        for initial, step in ((1, 1), (28, 7)):
            got = forecast.backtest(s, {"along": model, "plain": plain}, 7, initial, step).groupBy("fold", "date").agg(F.count_distinct("forecast").alias("n"), F.count("*").alias("m")).collect()
            assert {(r["n"], r["m"]) for r in got} == {(1, 2)}


def test_summaries_roll_up_from_one_pass(spark):
    """Any cut and period as if it were summed from the lines; orders over several categories and days, orders without sales, and null values."""
    from movewise.sources import generator

    t = generator.generate(spark)
    nulls = {n: t[n].withColumn("region_code", F.when(F.col("region_code") != "DEL", F.col("region_code"))) for n in ("fact_sales", "fact_orders")}
    t = {k: v.cache() for k, v in (t | nulls).items()}
    cells = mart.Summaries(t, ["region_code", "category", "channel", "kam_id"])
    for period, dims in (("week", []), ("day", ["category"]), ("month", ["region_code", "channel"]), ("week", ["kam_id", "category"])):
        for partial in (False, True):
            a, b = mart.summarise_by_period(t, period, dims, partial), cells.by(period, dims, partial)
            assert a.dtypes == b.dtypes
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
    with pytest.raises(ValueError):
        cells.by("week", ["sub_category"])
