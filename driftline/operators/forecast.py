"""Many-series forecasts, backtests and their error metrics.

Input is long form (series..., time_bin, value). Naive and trend forecasts are window expressions; ARIMA gets one
array per series (never longer than the calendar), so series are spread over the cluster and none is split.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from driftline.functions.arima import arima_forecast
from driftline.operators.gram import Moments, with_moments
from driftline.operators.series import future_time, with_index
from driftline.session import settle


@F.pandas_udf(ArrayType(DoubleType()))
def arima_steps(history: pd.Series, steps: pd.Series) -> pd.Series:
    return pd.Series([arima_forecast(np.asarray(h, dtype=float), int(s)).tolist() for h, s in zip(history, steps)])


def _history(value: str = "value") -> Column:
    """Aggregate: the values of one series in time order (bounded by the calendar)."""
    return F.transform(F.array_sort(F.collect_list(F.struct("x", value))), lambda p: p[value])


def _per_series(df: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """One row per series: points, first and last bin, last value and whatever the forecaster needs."""
    return with_index(df, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("time_bin").alias("__first"), F.max("time_bin").alias("__last"),
        F.max_by("value", "x").alias("__y"), *extra)


def _naive(df: DataFrame, keys: list[str], steps: int) -> DataFrame:
    return _per_series(df, keys).withColumn("__f", F.array_repeat("__y", steps))


def _trend(df: DataFrame, keys: list[str], steps: int) -> DataFrame:
    fit = _per_series(df, keys, F.regr_slope("value", "x").alias("__b"), F.regr_intercept("value", "x").alias("__a"))
    line = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.col("__a") + F.col("__b") * (F.col("__n") - 1 + i))
    return fit.withColumn("__f", F.when(F.col("__n") < 5, F.array_repeat("__y", steps)).otherwise(line))


def _arima(df: DataFrame, keys: list[str], steps: int) -> DataFrame:
    return _per_series(df, keys, _history().alias("__h")).withColumn("__f", arima_steps("__h", F.lit(steps)))


def autoregression(df: DataFrame, keys: list[str], max_order: int = 5) -> DataFrame:
    """Autoregression of every series about its mean by Levinson's recursion on its autocovariances: (keys, n, mean, order, phi, sigma2).

    The order (0 to `max_order`, below n) has the lowest AIC; `phi` holds `max_order` coefficients, zero beyond the order. Everything is sums
    and expressions per series; a constant series has order 0.
    """
    return _levinson(df, keys, max_order).select(*keys, F.col("__n").alias("n"), F.col("__mean").alias("mean"), "order", "phi", "sigma2")


def _levinson(df: DataFrame, keys: list[str], max_order: int) -> DataFrame:
    own = Window.partitionBy(*keys)
    rows = with_index(df, keys).withColumn("__mean", F.avg("value").over(own)).withColumn("__c", F.col("value") - F.col("__mean"))
    at = own.orderBy("x")
    sums = [(F.sum(F.col("__c") * F.col(f"__l{k}")) / F.count(F.lit(1))).alias(f"__r{k}") for k in range(max_order + 1)]
    rows = rows.withColumns({f"__l{k}": F.lag("__c", k).over(at) for k in range(max_order + 1)})
    recent = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("x", "__c")))), 1, max_order), lambda p: p["__c"])
    fit = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("time_bin").alias("__first"), F.max("time_bin").alias("__last"), F.max_by("value", "x").alias("__y"),
        F.first("__mean").alias("__mean"), recent.alias("__recent"), *sums)
    fit = fit.withColumn("__r", F.array(*[F.coalesce(f"__r{k}", F.lit(0.0)) for k in range(max_order + 1)])).drop(*[f"__r{k}" for k in range(max_order + 1)])
    n = F.col("__n")
    zeros = F.array_repeat(F.lit(0.0), max_order)
    choice = lambda e, k, phi: F.struct((n * F.log(e) + 2 * (k + 1)).alias("aic"), k.cast("int").alias("order"), e.alias("sigma2"), F.slice(F.concat(phi, zeros), 1, max_order).alias("phi"))
    empty, level = F.array().cast("array<double>"), F.col("__r")[0]

    def reflect(acc, k):
        """(phi of k - 1 with the k-th reflection coefficient): what the recursion adds at order k."""
        told = F.aggregate(F.zip_with(acc["phi"], F.reverse(F.slice("__r", F.lit(2), k - 1)), lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)
        kappa = F.when((acc["e"] > 1e-300) & (n > k), (F.get("__r", k) - told) / acc["e"]).otherwise(0.0)
        return F.struct(acc["phi"].alias("phi"), acc["e"].alias("e"), acc["best"].alias("best"), kappa.alias("kappa"), k.alias("k"))

    def grown(acc):
        phi = F.concat(F.zip_with(acc["phi"], F.reverse(acc["phi"]), lambda x, y: x - acc["kappa"] * y), F.array(acc["kappa"]))
        return F.struct(phi.alias("phi"), (acc["e"] * (1 - acc["kappa"] * acc["kappa"])).alias("e"), acc["best"].alias("best"), acc["k"].alias("k"))

    def judged(acc):
        new = choice(acc["e"], acc["k"], acc["phi"])
        better = (acc["e"] > 1e-300) & (n > acc["k"]) & (new["aic"] < acc["best"]["aic"])
        return F.struct(acc["phi"].alias("phi"), acc["e"].alias("e"), F.when(better, new).otherwise(acc["best"]).alias("best"))

    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  (names a value, so that it is worked out once)
    start = F.struct(empty.alias("phi"), level.alias("e"), choice(F.greatest(level, F.lit(1e-300)), F.lit(0), empty).alias("best"))
    step = lambda acc, k: once(once(reflect(acc, k), grown), judged)
    fit = fit.withColumn("__best", F.aggregate(F.sequence(F.lit(1), F.lit(max_order)), start, step, lambda acc: acc["best"]))
    return fit.withColumns({"order": F.col("__best.order"), "sigma2": F.when(F.col("__best.sigma2") > 1e-300, F.col("__best.sigma2")).otherwise(0.0), "phi": F.col("__best.phi")})


def _autoregression(df: DataFrame, keys: list[str], steps: int, max_order: int = 5) -> DataFrame:
    fit = _levinson(df, keys, max_order)
    padded = F.slice(F.concat("__recent", F.array_repeat(F.lit(0.0), max_order)), 1, max_order)

    def ahead(acc, _):
        value = F.aggregate(F.zip_with("phi", acc["h"], lambda p, h: p * h), F.lit(0.0), lambda s, v: s + v)
        return F.struct(F.slice(F.concat(F.array(value), acc["h"]), 1, max_order).alias("h"), F.concat(acc["f"], F.array(value)).alias("f"))

    start = F.struct(padded.alias("h"), F.array().cast("array<double>").alias("f"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, ahead, lambda acc: F.transform(acc["f"], lambda v: v + F.col("__mean")))
    return fit.withColumn("__f", F.when(F.col("__n") < 5, F.array_repeat("__y", steps)).otherwise(path))


# Each forecaster adds `__f`, an array of future values, to the per-series rows.
FORECASTERS: dict[str, Callable[[DataFrame, list[str], int], DataFrame]] = {
    "naive_last": _naive, "linear_trend": _trend, "auto_arima": _arima, "autoregression": _autoregression,
}


def forecast(df: DataFrame, keys: list[str], steps: int = 6, model: str = "auto_arima") -> DataFrame:
    """`steps` future values per series with their times. A series under five points repeats its last value.

    `prophet` is accepted as a name for the trend-only forecast; other forecasters can be added to FORECASTERS.
    """
    name = {"prophet": "linear_trend"}.get((model or "auto_arima").lower(), (model or "auto_arima").lower())
    rows = FORECASTERS[name](df, keys, steps)
    out = rows.select(*keys, "__n", "__first", "__last", F.posexplode("__f").alias("__p", "yhat"))
    out = out.withColumn("step", F.col("__p") + 1)
    return out.select(*keys, "step", future_time().alias("time_bin"), "yhat", F.lit(name).alias("model"))


def _tested(df: DataFrame, keys: list[str], horizon: Column) -> DataFrame:
    """Points with position x, series length n and holdout length h (from n)."""
    rows = with_index(df, keys).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return rows.withColumn("h", horizon)


def _holdout_forecasts(rows: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Actual and forecast for the last h points of every series, trained on the rest."""
    w = Window.partitionBy(*keys)
    train = F.col("x") < F.col("n") - F.col("h")
    y, x = F.when(train, F.col("value")), F.when(train, F.col("x"))
    last = F.max_by(y, x).over(w)
    size = F.col("n") - F.col("h")
    line = F.regr_intercept(y, x).over(w) + F.regr_slope(y, x).over(w) * F.col("x")
    cols = {"naive_last": last, "linear_trend": F.when(size < 5, last).otherwise(line)}
    plain = [m for m in models if m in cols]
    parts = []
    if plain:
        wide = rows.select("*", *[cols[m].alias(f"__{m}") for m in plain]).filter(~train)
        pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"__{m}").alias("forecast")) for m in plain])
        parts.append(wide.select(*keys, "time_bin", "x", F.col("value").alias("actual"), F.inline(pairs)))
    if "auto_arima" in models:
        hist = rows.filter(train).groupBy(*keys).agg(_history().alias("__h"), F.first("h").alias("h"), F.first("n").alias("n"))
        pred = hist.withColumn("__f", arima_steps("__h", F.col("h").cast("int")))
        pred = pred.select(*keys, "n", "h", F.posexplode("__f").alias("__p", "forecast"))
        pred = pred.select(*keys, (F.col("n") - F.col("h") + F.col("__p")).alias("x"), "forecast")
        test = rows.filter(~train).select(*keys, "time_bin", "x", F.col("value").alias("actual"))
        parts.append(test.join(pred, [*keys, "x"]).select(
            *keys, "time_bin", "x", "actual", F.lit("auto_arima").alias("model"), "forecast"))
    return reduce(DataFrame.unionByName, parts)


def backtest(df: DataFrame, keys: list[str], models: list[str] | None = None) -> DataFrame:
    """Holdout backtest: the last max(3, min(6, n div 4)) points. A series too short for it gets null metrics."""
    models = models or ["naive_last"]
    df = settle(df)  # bin-level, read more than once
    h = F.greatest(F.lit(3), F.least(F.lit(6), F.floor(F.col("n") / 4).cast("int")))
    rows = _tested(df, keys, h)
    fits = rows.filter(F.col("n") > F.col("h") + 3)
    scored = error_metrics(_holdout_forecasts(fits, keys, models), [*keys, "model"])
    every = df.select(*keys).distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return every.join(scored, [*keys, "model"], "left").select(*keys, "model", "rmse", "mae", "mape")


def compare_forecasters(df: DataFrame, keys: list[str], horizon: int = 12, models: list[str] | None = None) -> DataFrame:
    """Errors of several forecasters on the last min(horizon, max(2, n div 4)) points; series under 12 points get null errors."""
    models = models or ["auto_arima", "linear_trend", "naive_last"]
    df = settle(df)  # bin-level, read more than once
    h = F.least(F.lit(horizon), F.greatest(F.lit(2), F.floor(F.col("n") / 4).cast("int")))
    rows = _tested(df, keys, h).filter(F.col("n") >= 12)
    scored = error_metrics(_holdout_forecasts(rows, keys, models), [*keys, "model"])
    every = df.select(*keys).distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return every.join(scored, [*keys, "model"], "left").select(*keys, "model", "mae", "rmse", "mape_pct", "r2")


def walk_forward(df: DataFrame, keys: list[str], model: str = "naive_last", start_share: float = 0.6) -> DataFrame:
    """One-step forecasts with an expanding window from point max(5, int(share * n)); needs ten points.

    For ARIMA every cutoff is its own row holding the history so far, so cutoffs of one series run in parallel.
    """
    w = Window.partitionBy(*keys)
    rows = with_index(df, keys).withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") >= 10)
    start = F.greatest(F.lit(5), F.floor(F.col("n") * F.lit(float(start_share))))
    if model == "auto_arima":
        whole = rows.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("x", "time_bin", "value"))).alias("__s"), F.first("n").alias("n"))
        cuts = whole.withColumn("x", F.explode(F.sequence(start, F.col("n") - 1)))
        cuts = cuts.select(
            *keys, "x", F.col("__s")[F.col("x").cast("int")]["time_bin"].alias("time_bin"),
            F.col("__s")[F.col("x").cast("int")]["value"].alias("actual"),
            F.slice(F.transform("__s", lambda p: p["value"]), F.lit(1), F.col("x").cast("int")).alias("__h"),
        ).repartition(*keys, "x")
        return cuts.select(*keys, "time_bin", "x", "actual", arima_steps("__h", F.lit(1))[0].alias("forecast"))
    past = w.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    if model == "naive_last":
        pred = F.lag("value").over(w.orderBy("x"))
    elif model == "linear_trend":
        pred = F.regr_intercept("value", "x").over(past) + F.regr_slope("value", "x").over(past) * F.col("x")
    else:
        raise ValueError(f"unknown model {model!r}")
    out = rows.withColumn("forecast", pred).filter(F.col("x") >= start)
    return out.select(*keys, "time_bin", "x", F.col("value").alias("actual"), "forecast")


def walk_forward_errors(df: DataFrame, keys: list[str], models: list[str], start_share: float = 0.6) -> DataFrame:
    """Error measures of the walk-forward forecasts of every series and model; null for series under ten points."""
    df = settle(df)  # bin-level, read more than once
    parts = [walk_forward(df, keys, m, start_share).withColumn("model", F.lit(m)) for m in models]
    scored = error_metrics(reduce(DataFrame.unionByName, parts), [*keys, "model"])
    every = df.select(*keys).distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return every.join(scored, [*keys, "model"], "left")


def error_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """All error measures of (actual, forecast) rows.

    mape: ratio with denominator max(|y|, 1e-6). mape_pct: percent with |y| + 1e-6. mape_raw_pct: percent with
    y + 1e-10. r2: 1 - SSE/SST (for constant actuals 1 when exact, else 0). r2_clipped: the 1e-10-guarded form, at
    least 0. r: Pearson correlation for more than two points,
    null when either side is constant.
    """
    err = F.col("actual") - F.col("forecast")
    a = F.col("actual")
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err / F.greatest(F.abs(a), F.lit(1e-6)))).alias("mape"),
        (F.avg(F.abs(err) / (F.abs(a) + F.lit(1e-6))) * 100).alias("mape_pct"),
        (F.avg(F.abs(err / (a + F.lit(1e-10)))) * 100).alias("mape_raw_pct"),
        F.sum(err * err).alias("sse"), (F.var_pop(a) * F.count(a)).alias("sst"),
        F.covar_pop("actual", "forecast").alias("__c"), (F.stddev_pop("actual") * F.stddev_pop("forecast")).alias("__d"),
    )
    constant = F.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    m = m.withColumn("r2", F.when(F.col("sst") == 0, constant).otherwise(1 - F.col("sse") / F.when(F.col("sst") != 0, F.col("sst"))))
    m = m.withColumn("r2_guarded", 1 - F.col("sse") / (F.col("sst") + F.lit(1e-10)))
    m = m.withColumn("r2_clipped", F.greatest(F.lit(0.0), F.col("r2_guarded")))
    r = F.when((F.col("points") > 2) & (F.col("__d") > 0), F.try_divide("__c", "__d"))
    return m.withColumn("r", r).drop("__c", "__d", "sse", "sst")


# Published 5 % response surface of the unit-root t statistic with a constant, in powers of 1/T.
ADF_5_PERCENT = (-2.86154, -2.8903, -4.234, -40.04)


def unit_root(df: DataFrame, keys: list[str]) -> DataFrame:
    """t statistic of y[t-1] in the regression of the step on it with a constant; stationary if below the 5 % value.

    Series too short or too constant for the regression get nulls.
    """
    prev = F.lag("value").over(Window.partitionBy(*keys).orderBy("time_bin"))
    rows = df.withColumn("__p", prev).filter(F.col("__p").isNotNull()).withColumn("__d", F.col("value") - F.col("__p"))
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("t_obs"), F.regr_sxx("__d", "__p").alias("sxx"), F.regr_syy("__d", "__p").alias("syy"),
        F.regr_sxy("__d", "__p").alias("sxy"),
    )
    m = df.select(*keys).distinct().join(m, keys, "left").withColumn("t_obs", F.coalesce("t_obs", F.lit(0)).cast("long"))
    m = m.withColumn("sxx", F.when((F.col("t_obs") > 2) & (F.col("sxx") > 0), F.col("sxx")))  # else every result is null
    sse = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    t = (F.col("sxy") / F.col("sxx")) / F.sqrt(sse / (F.col("t_obs") - 2) / F.col("sxx"))
    critical = F.when(F.col("sxx").isNotNull(), sum((F.lit(c) / F.pow(F.col("t_obs"), F.lit(i)) for i, c in enumerate(ADF_5_PERCENT)), F.lit(0.0)))
    out = m.select(*keys, "t_obs", t.alias("t"), critical.alias("critical"))
    return out.withColumn("stationary", F.col("t") < F.col("critical"))


# Published response surfaces of the unit-root t statistic with a constant, in powers of 1/T, and the polynomials whose normal
# probability is its p-value, below and above the given point.
ADF_CRITICAL = {"critical_1": (-3.43035, -6.5393, -16.786, -79.433), "critical_5": ADF_5_PERCENT, "critical_10": (-2.56677, -1.5384, -2.809, 0.0)}
ADF_LOW, ADF_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_TURN, ADF_LEAST, ADF_MOST = -1.61, -18.83, 2.74


def unit_root_p(t: float) -> float:
    """The approximate p-value of the unit-root t statistic with a constant."""
    if t > ADF_MOST:
        return 1.0
    if t < ADF_LEAST:
        return 0.0
    z = sum(c * t**i for i, c in enumerate(ADF_LOW if t <= ADF_TURN else ADF_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _adf_fit(moments: Moments, lags: int) -> tuple[float, float, int]:
    """(t of y[t-1], AIC, number of coefficients): the step on y[t-1], `lags` earlier steps and a constant, from sums of the levels and of ones."""
    width = moments.width
    rows = np.zeros((lags + 3, 2 * width))  # of step, y[t-1], earlier steps, one; columns are one and y by lag
    rows[0, width], rows[0, width + 1] = 1, -1
    rows[1, width + 1] = 1
    for j in range(1, lags + 1):
        rows[1 + j, width + j], rows[1 + j, width + j + 1] = 1, -1
    rows[-1, 0] = 1
    sums = rows @ moments.sums @ rows.T
    xx, xy, yy, n, k = sums[1:, 1:], sums[1:, 0], sums[0, 0], moments.n, lags + 2
    size = np.sqrt(np.diag(xx))
    if n <= k or (size <= 0).any():
        return math.nan, math.inf, k
    inverse = np.linalg.pinv(xx / np.outer(size, size), hermitian=True) / np.outer(size, size)
    beta = inverse @ xy
    sse = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    if sse <= 1e-14 * yy:
        return math.nan, math.inf, k
    return float(beta[0] / math.sqrt(sse / (n - k) * inverse[0, 0])), n * math.log(sse / n) + 2 * k, k


def augmented_unit_root(df: DataFrame, keys: list[str], lags: int | None = None) -> DataFrame:
    """Unit-root test with lagged steps and a constant: (keys, t_obs, lags, t, p_value, critical values, stationary).

    Without `lags` their number has the lowest AIC on a common sample, up to ceil(12 (n / 100)^(1/4)). All regressions are solved from sums of
    products per series. Series too short or too constant get nulls.
    """
    key, whole = "__corpus", Window.partitionBy("__corpus")
    df = settle(df.select(F.struct(*keys).alias(key), "time_bin", F.col("value").cast("double").alias("value")))
    rows = df.withColumns({"bins": F.count(F.lit(1)).over(whole), "value": F.col("value") - F.avg("value").over(whole)})
    top = F.least(F.ceil(12 * F.pow(F.col("bins") / 100, F.lit(0.25))), F.floor(F.col("bins") / 2) - 2).cast("int") if lags is None else F.lit(lags)
    rows = rows.withColumn("lags", top + 1).where((F.col("lags") > 0) & (F.col("bins") > 2 * F.col("lags") + 1))
    most = rows.agg(F.max("lags").alias("m")).first().m
    schema = StructType([StructField("best", IntegerType())])
    result = StructType([StructField("t_obs", LongType()), StructField("lags", IntegerType()), StructField("t", DoubleType()), StructField("p_value", DoubleType()),
                         *[StructField(c, DoubleType()) for c in ADF_CRITICAL]])
    every = df.select(key).distinct()
    if most is None:
        out = every.select(key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in result])
        return out.select(f"{key}.*", *result.names).withColumn("stationary", F.col("p_value") < 0.05)

    def with_ones(series):
        return series.withColumn("source", F.explode(F.array(F.lit("one"), F.lit("y")))).withColumn("value", F.when(F.col("source") == "one", 1.0).otherwise(F.col("value")))

    if lags is None:
        def choose(_, moments: Moments) -> pa.Table:
            return pa.table([pa.array([min(range(moments.p), key=lambda p: _adf_fit(moments, p)[1])], pa.int32())], ["best"])

        chosen = settle(with_moments(with_ones(rows), key, most, choose, schema))
        rows = rows.join(chosen, key).withColumn("lags", F.col("best") + 1).drop("best")

    def solve(_, moments: Moments) -> pa.Table:
        t = _adf_fit(moments, moments.p - 1)[0]
        sound = math.isfinite(t)
        critical = [sum(c / moments.n**i for i, c in enumerate(v)) for v in ADF_CRITICAL.values()]
        row = [moments.n, moments.p - 1, t, unit_root_p(t), *critical] if sound else [moments.n, moments.p - 1, *[None] * 5]
        return pa.table([pa.array([v], pa.int64() if k == 0 else pa.int32() if k == 1 else pa.float64()) for k, v in enumerate(row)], result.names)

    found = with_moments(with_ones(rows), key, most, solve, result)
    return every.join(found, key, "left").select(f"{key}.*", *result.names).withColumn("stationary", F.col("p_value") < 0.05)
