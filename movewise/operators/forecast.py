"""Daily series, five closed-form forecasters, rolling-origin backtests and their scores.

A series is one row with its values in date order; folds are rows, and the models are column
expressions over the history's array, so folds and models run in parallel without Python. A model is
a function (history array, length, step) -> column; users pass their own in the same form, or as a
`Forecaster`, which Python workers fit to each fold's history. A model may also have `prefix`: one pass
along the series that leaves its forecast at every origin, so that a backtest does not begin each fold anew.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.exprs import half_even, money_sum, ratio, require
from ..functions.shipping import ship

SEASON = 7
ALPHAS = [k / 20 for k in range(1, 20)]
MAPE_FLOOR = 0.01

Model = Callable[[Column, Column, Column], Column]


class Forecaster:
    """A user's model in Python: fit learns from a daily history (a pandas Series with dates), predict gives the days after it."""

    def fit(self, y) -> Forecaster:
        raise NotImplementedError

    def predict(self, horizon: int):
        raise NotImplementedError


def daily_series(sales: DataFrame, orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """date, net_sales, units, orders: every day from the first to the last, 0 where nothing happened; by: of each group, over its own days."""
    require(sales.columns, ["date", "net_sales", "units", *by], "sales")
    require(orders.columns, ["date", "order_id", *by], "orders")
    sold = sales.groupBy(*by, "date").agg(money_sum("net_sales").alias("net_sales"), F.sum("units").cast("long").alias("units"))
    placed = orders.groupBy(*by, "date").agg(F.count_distinct("order_id").alias("orders"))
    days = sold.unionByName(placed, allowMissingColumns=True).where(F.col("date").isNotNull()).groupBy(*by, "date").agg(*[F.sum(c).alias(c) for c in ("net_sales", "units", "orders")])
    ends = days.groupBy(*by).agg(F.min("date").alias("a"), F.max("date").alias("b")).where(F.col("a").isNotNull())
    calendar = ends.select(*by, F.explode(F.sequence("a", "b")).alias("date"))
    filled = calendar.join(days, [*by, "date"], "left")
    return filled.select(*by, "date", F.coalesce("net_sales", F.lit(0.0)).alias("net_sales"), F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("orders", F.lit(0)).alias("orders"))


def extract_metric(daily: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    require(daily.columns, [*by, "date", metric], "the daily series")
    return daily.select(*by, "date", F.col(metric).cast("double").alias("y"))


def check_history(series: DataFrame) -> None:
    """Refuses an empty series, nulls, and gaps: one aggregate row comes back."""
    n, nulls, distinct, days = series.agg(F.count("*"), F.count(F.when(F.col("y").isNull(), 1)), F.count_distinct("date"), F.datediff(F.max("date"), F.min("date")) + 1).first()
    if not n:
        raise ValueError("the history is empty")
    if nulls:
        raise ValueError("the history has missing values")
    if not n == distinct == days:
        raise ValueError("the history is not daily without gaps")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def flat(model: Model) -> Model:
    """Marks a model whose forecast is the same for every step."""
    model.flat = True
    return model


@flat
def naive(h: Column, n: Column, step: Column) -> Column:
    return F.element_at(h, -1)


def moving_average(window: int) -> Model:
    return flat(lambda h, n, step: _mean(F.slice(h, F.greatest(n - window + 1, F.lit(1)), F.lit(window))))


def seasonal_naive(k: int) -> Model:
    return lambda h, n, step: F.element_at(h, (n - k + step % k + 1).cast("int"))


def seasonal_mean(k: int) -> Model:
    return lambda h, n, step: _mean(F.transform(F.sequence((n + step) % k, n - 1, F.lit(k)), lambda i: F.element_at(h, (i + 1).cast("int"))))


def exponential(alpha: float | None = None) -> Model:
    """Simple exponential smoothing; without alpha the grid value with the least one-step error (the smallest on ties; 0.5 for under 3 values)."""

    def onward(state: Column, values: Column, a: Column) -> Column:
        """Level and squared one-step errors after more values."""
        step = lambda s, y: F.struct((a * y + (F.lit(1.0) - a) * s["level"]).alias("level"), (s["sse"] + (y - s["level"]) * (y - s["level"])).alias("sse"))
        return F.aggregate(values, state, step)

    def first(h: Column) -> Column:
        return F.struct(F.element_at(h, 1).alias("level"), F.lit(0.0).alias("sse"))

    def smoothed(h: Column, a: Column) -> Column:
        return onward(first(h), F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), a)

    def best(states: Column, n: Column) -> Column:
        """The level of the least error; states are those of ALPHAS."""
        ranked = F.transform(states, lambda s, i: F.struct(s["sse"].alias("sse"), i.alias("i"), s["level"].alias("level")))
        return F.when(n < 3, F.get(states, F.lit(ALPHAS.index(0.5)))["level"]).otherwise(F.array_min(ranked)["level"])

    def model(h: Column, n: Column, step: Column) -> Column:
        if alpha is not None:
            return smoothed(h, F.lit(alpha))["level"]
        return best(F.transform(F.array(*[F.lit(a) for a in ALPHAS]), lambda a: smoothed(h, a)), n)

    def prefix(y: Column, origins: Column) -> Column:
        """The forecast at each origin (ascending numbers of values before it), every value being read once."""
        grid = F.array(*[F.lit(a) for a in ([alpha] if alpha is not None else ALPHAS)])
        level = (lambda states, o: F.get(states, F.lit(0))["level"]) if alpha is not None else best
        start = F.struct(F.transform(grid, lambda a: first(y)).alias("states"), F.lit(1).alias("read"), F.array().cast("array<double>").alias("found"))

        def advance(acc: Column, o: Column) -> Column:
            more = F.slice(y, acc["read"] + 1, F.greatest(o - acc["read"], F.lit(0)))
            states = F.zip_with(grid, acc["states"], lambda a, s: onward(s, more, a))
            return F.struct(states.alias("states"), F.greatest(o, acc["read"]).cast("int").alias("read"), acc["found"].alias("found"))

        def with_level(acc: Column, o: Column) -> Column:
            return F.struct(acc["states"].alias("states"), acc["read"].alias("read"), F.concat(acc["found"], F.array(level(acc["states"], o))).alias("found"))

        # Advancing and noting are two steps of one list, so that the states are computed once for each origin.
        twice = F.flatten(F.transform(origins, lambda o: F.array(F.struct(o.alias("o"), F.lit(True).alias("move")), F.struct(o.alias("o"), F.lit(False).alias("move")))))
        return F.aggregate(twice, start, lambda acc, x: F.when(x["move"], advance(acc, x["o"])).otherwise(with_level(acc, x["o"])))["found"]

    model.prefix = prefix
    return flat(model)


def default_models() -> dict[str, Model]:
    return {"naive": naive, f"moving_average_{SEASON}": moving_average(SEASON), "ses": exponential(), f"seasonal_naive_{SEASON}": seasonal_naive(SEASON), f"seasonal_mean_{SEASON}": seasonal_mean(SEASON)}


def _packed(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per series: dates and values in order. A history that is empty, has null values or is not daily without gaps is an error, when the plan runs."""
    rows = F.array_sort(F.collect_list(F.struct("date", "y")))
    packed = series.groupBy(*by).agg(rows.alias("_s")).select(*by, F.col("_s.date").alias("_d"), F.col("_s.y").alias("_y"))
    wrong = lambda text: F.raise_error(F.lit(text)).cast("array<double>")
    daily = (F.size("_d") == F.size(F.array_distinct("_d"))) & (F.size("_d") == F.datediff(F.array_max("_d"), F.array_min("_d")) + 1)
    checked = F.when(F.size("_y") == 0, wrong("the history is empty")).when(F.exists("_y", lambda y: y.isNull()), wrong("the history has missing values")).when(~daily, wrong("the history is not daily without gaps")).otherwise(F.col("_y"))
    return packed.withColumn("_y", checked)


def _predicted(folds: DataFrame, models: dict[str, Model], horizon: int, by: Sequence[str]) -> DataFrame:
    """folds has the history (_h), its length (_n) and whatever is to be carried along."""
    carried = [c for c in folds.columns if c not in ("_h", "_n") and not c.startswith("_at_")]
    once = {name: f"_m{i}" for i, (name, m) in enumerate(models.items()) if getattr(m, "flat", False)}
    folds = folds.withColumns({c: models[name](F.col("_h"), F.col("_n"), F.lit(0)) for name, c in once.items()})
    steps = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda s: F.struct(s.alias("step"), *[(F.col(once[name]) if name in once else m(F.col("_h"), F.col("_n"), s)).alias(name) for name, m in models.items()]))
    wide = folds.select(*carried, F.explode(steps).alias("_f")).select(*carried, F.col("_f.step").alias("step"), *[F.col("_f")[m].alias(f"m_{i}") for i, m in enumerate(models)])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"m_{i}").alias("forecast")) for i, m in enumerate(models)]))
    return wide.select(*carried, "step", pairs.alias("_p")).select(*carried, "step", "_p.model", "_p.forecast")


def _in_python(folds: DataFrame, models: dict[str, Forecaster], horizon: int, carried: Sequence[str]) -> DataFrame:
    """The same columns as _predicted, from models that are fitted in Python workers; a fold is a row, so folds and series run in parallel."""
    import pandas as pd
    import pyarrow as pa

    ship(folds.sparkSession)
    rows = folds.select(*carried, "_h", "_last")
    kept = StructType([f for f in rows.schema.fields if f.name in carried])
    schema = StructType([*kept.fields, StructField("step", IntegerType()), StructField("model", StringType()), StructField("forecast", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, step, model, value = [], [], [], []
            for i, (history, last) in enumerate(zip(batch["_h"].to_pylist(), batch["_last"].to_pylist(), strict=True)):
                y = pd.Series(history, pd.date_range(end=pd.Timestamp(last), periods=len(history), freq="D"), dtype=float)
                for name, made in models.items():
                    told = [float(x) for x in copy.deepcopy(made).fit(y.copy()).predict(horizon)]
                    if len(told) != horizon or not all(math.isfinite(x) for x in told):
                        raise ValueError(f"{name} gave {len(told)} values for {horizon} days, or some that are no numbers")
                    source += [i] * horizon
                    step += range(horizon)
                    model += [name] * horizon
                    value += told
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in carried], pa.array(step, pa.int32()), pa.array(model, pa.string()), pa.array(value, pa.float64())], [*carried, "step", "model", "forecast"])

    return rows.mapInArrow(run, schema)


def _all_predicted(folds: DataFrame, models: dict[str, Model | Forecaster], horizon: int, by: Sequence[str]) -> DataFrame:
    """Of folds with _h, _n and _last (the last day of the history)."""
    columns = {name: m for name, m in models.items() if not isinstance(m, Forecaster)}
    fitted = {name: m for name, m in models.items() if isinstance(m, Forecaster)}
    carried = [c for c in folds.columns if c not in ("_h", "_n", "_last") and not c.startswith("_at_")]
    out = [_predicted(folds.drop("_last"), columns, horizon, by)] if columns else []
    if fitted:
        out.append(_in_python(folds, fitted, horizon, carried))
    return reduce(DataFrame.unionByName, out)


def forecast(series: DataFrame, models: dict[str, Model | Forecaster] | None = None, horizon: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """model, date, forecast for the days after the history."""
    p = _packed(series, by).select(*by, F.col("_y").alias("_h"), F.size("_y").alias("_n"), F.element_at("_d", -1).alias("last"), F.element_at("_d", -1).alias("_last"))
    return _all_predicted(p, models or default_models(), horizon, by).select(*by, "model", F.date_add("last", (F.col("step") + 1).cast("int")).alias("date"), "forecast")


def backtest(series: DataFrame, models: dict[str, Model | Forecaster] | None = None, horizon: int = 7, initial: int = 28, step: int = 7, by: Sequence[str] = (), origins: Column | None = None) -> DataFrame:
    """model, fold, origin_date, date, actual, forecast; every fold sees only what came before its origin."""
    models = models or default_models()
    packed = _packed(series, by).withColumn("_t", F.size("_y")).where(F.col("_t") >= initial + horizon)
    packed = packed.withColumn("_os", F.sequence(F.lit(initial), F.col("_t") - horizon, F.lit(step)) if origins is None else origins)
    along = {name: f"_at_{i}" for i, (name, m) in enumerate(models.items()) if hasattr(m, "prefix")}
    packed = packed.withColumns({c: models[name].prefix(F.col("_y"), F.col("_os")) for name, c in along.items()})
    folds = packed.select(*by, "_d", "_y", *along.values(), F.posexplode("_os").alias("_k", "_o"))
    folds = folds.select(
        *by, (F.col("_k") + 1).cast("int").alias("fold"), F.element_at("_d", F.col("_o").cast("int")).alias("origin_date"), F.slice("_d", F.col("_o") + 1, F.lit(horizon)).alias("_fd"), F.slice("_y", F.col("_o") + 1, F.lit(horizon)).alias("_fy"),
        F.slice("_y", F.lit(1), F.col("_o")).alias("_h"), F.col("_o").alias("_n"), F.element_at("_d", F.col("_o").cast("int")).alias("_last"), *[F.get(c, F.col("_k")).alias(c) for c in along.values()],
    )
    folds = folds.repartition(*by, "fold")
    known = {name: flat(lambda h, n, s, c=c: F.col(c)) for name, c in along.items()}
    out = _all_predicted(folds, models | known, horizon, by)
    pick = lambda c: F.element_at(c, (F.col("step") + 1).cast("int"))
    return out.select(*by, "model", "fold", "origin_date", pick("_fd").alias("date"), pick("_fy").alias("actual"), "forecast")


def holdout(series: DataFrame, models: dict[str, Model] | None = None, days: int = 14, by: Sequence[str] = ()) -> DataFrame:
    """One fold: the last days against everything before them."""
    return backtest(series, models, days, 1, 1, by, F.array((F.col("_t") - days).cast("int")))


def scores(predictions: DataFrame, by: Sequence[str] = ("model",), places: int = 4) -> DataFrame:
    """mae, rmse, wape, mape, bias, pooled over folds. wape is null over zeros, mape if any actual is near zero."""
    e, a = F.col("forecast") - F.col("actual"), F.abs("actual")
    sums = predictions.groupBy(*by).agg(
        F.count("*").alias("n"), *([F.count_distinct("fold").alias("folds")] if "fold" in predictions.columns else []), F.sum(F.abs(e)).alias("_ae"), F.sum(e * e).alias("_se"), F.sum(a).alias("_a"),
        F.sum(F.when(a > 0, F.abs(e) / a)).alias("_pe"), F.min(a).alias("_low"), F.sum(e).alias("_e"),
    )
    r = lambda c: half_even(c, places)
    mape = F.when((F.col("_low") > 0) & (F.col("_low") >= MAPE_FLOOR * F.col("_a") / F.col("n")), r(F.col("_pe") / F.col("n")))
    kept = [*by, "n", *(["folds"] if "fold" in predictions.columns else [])]
    return sums.select(*kept, r(F.col("_ae") / F.col("n")).alias("mae"), r(F.sqrt(F.col("_se") / F.col("n"))).alias("rmse"), ratio("_ae", "_a", places).alias("wape"), mape.alias("mape"), r(F.col("_e") / F.col("n")).alias("bias"))


def against_baseline(summary: DataFrame, baseline: str = "naive") -> DataFrame:
    """wape_gain: the share of the baseline's wape that a model saves."""
    base = summary.where(F.col("model") == baseline).select(F.col("wape").alias("_b"))
    return summary.crossJoin(F.broadcast(base)).withColumn("wape_gain", ratio(F.col("_b") - F.col("wape"), "_b", 4)).drop("_b")  # one row


def ranked(summary: DataFrame) -> DataFrame:
    """Best model first (a row per model); ties go by name, a model without wape last."""
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(F.col("wape").asc_nulls_last(), "model")).cast("int")).orderBy("rank")
