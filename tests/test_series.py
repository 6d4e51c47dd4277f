from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.functions.arima import arima_forecast, fit_arma
from driftline.functions.stats import f_sf
from driftline.operators import forecast, series

START = datetime(2024, 1, 1)


def frame(spark, **lists):
    rows = [(k, START + timedelta(days=i), float(v)) for k, vs in lists.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series string, time_bin timestamp_ntz, value double")


def test_trend_and_significance(spark):
    rng = np.random.default_rng(1)
    y = 0.3 * np.arange(40) + rng.normal(size=40)
    df = frame(spark, up=y, flat=[2.0] * 10, line=np.arange(6), noise=rng.normal(size=30))
    got = {r["series"]: r for r in series.trend_significance(df, ["series"]).collect()}
    x = np.arange(40)
    r2 = np.corrcoef(x, y)[0, 1] ** 2
    assert abs(got["up"]["slope"] - np.polyfit(x, y, 1)[0]) < 1e-9 and abs(got["up"]["r2"] - r2) < 1e-9
    assert got["up"]["trend"] == "increasing" and got["flat"]["p_value"] == 1.0 and got["flat"]["trend"] == "none"
    assert got["line"]["p_value"] == 0.0
    assert {r["direction"] for r in series.trend(df.filter("series = 'up'"), ["series"]).collect()} == {"increasing"}


def test_f_tail_against_closed_forms():
    f = np.array([0.1, 1.0, 3.7, 20.0])
    for d2 in (6.0, 7.0, 184.0):
        x = d2 / (d2 + 4 * f)
        assert np.allclose(f_sf(f, 4, d2), x ** (d2 / 2) * (1 + d2 / 2 * (1 - x)), atol=1e-13)
    assert np.allclose(f_sf(f, 1, 1), 1 - 2 / np.pi * np.arctan(np.sqrt(f)), atol=1e-13)
    assert f_sf(np.array([0.0]), 3, 5)[0] == 1.0 and np.isnan(f_sf(np.array([-1.0]), 3, 5)[0])


def test_peaks_take_first_bin(spark):
    r = series.peaks(frame(spark, s=[1, 3, 3, 1]), ["series"]).first()
    assert (r["peak_bin"], r["peak"], r["trough_bin"], r["trough"]) == (START + timedelta(days=1), 3, START, 1)


def test_directional_accuracy_single_point(spark):
    df = spark.createDataFrame([("s", START, 1.0, 2.0)], "series string, time_bin timestamp_ntz, actual double, forecast double")
    assert series.directional_accuracy(df, ["series"]).first()[1] == 0.5


def test_future_bins(spark):
    got = series.future_bins(frame(spark, two=[1, 2], one=[1]), ["series"], 2).orderBy("series", "step").collect()
    assert [r["time_bin"] for r in got] == [datetime(2024, 1, 31), datetime(2024, 2, 29), datetime(2024, 1, 3), datetime(2024, 1, 4)]


@pytest.mark.parametrize("model", ["naive_last", "linear_trend", "auto_arima", "prophet"])
def test_short_series_repeat_last(spark, model):
    df = frame(spark, a=[5.0], b=[1, 2, 3, 4])
    got = {r["series"]: r["v"] for r in forecast.forecast(df, ["series"], 3, model).groupBy("series").agg(F.collect_list("yhat").alias("v")).collect()}
    assert got == {"a": [5.0] * 3, "b": [4.0] * 3}


def test_forecast_shapes(spark):
    df = frame(spark, s=np.arange(20) * 2.0)
    rows = forecast.forecast(df, ["series"], 4, "linear_trend").orderBy("step").collect()
    assert [round(r["yhat"], 6) for r in rows] == [40, 42, 44, 46] and rows[0]["time_bin"] == START + timedelta(days=20)
    assert forecast.forecast(df, ["series"], 7).count() == 7


def ar1(n, phi, seed):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = phi * y[i - 1] + rng.normal()
    return y


def test_arima_beats_naive_on_planted_series(spark):
    df = frame(spark, **{f"s{i}": ar1(120, -0.7, i) for i in range(4)})
    errs = {}
    for m in ("naive_last", "auto_arima"):
        errs[m] = forecast.error_metrics(forecast.walk_forward(df, ["series"], m), ["series"]).agg(F.avg("rmse")).first()[0]
    assert errs["auto_arima"] < 0.8 * errs["naive_last"]


def test_arima_follows_a_trend():
    y = 5 + 0.8 * np.arange(60) + np.random.default_rng(3).normal(size=60) * 0.2
    out = arima_forecast(y, 5)
    assert np.abs(out - (5 + 0.8 * np.arange(60, 65))).max() < 1.5
    assert list(arima_forecast(np.array([]), 2)) == [0.0, 0.0] and list(arima_forecast(np.full(9, 3.0), 2)) == [3.0, 3.0]


def test_backtest_thresholds(spark):
    df = frame(spark, **{f"n{n}": np.arange(n) for n in (1, 4, 6, 7, 12, 40)})
    got = {(r["series"], r["model"]): r for r in forecast.backtest(df, ["series"], ["naive_last", "linear_trend", "auto_arima"]).collect()}
    assert len(got) == 18
    assert all(got[(f"n{n}", "naive_last")]["mae"] is None for n in (1, 4, 6))
    assert got[("n7", "naive_last")]["mae"] == 2.0 and abs(got[("n40", "linear_trend")]["mae"]) < 1e-9
    assert got[("n40", "naive_last")]["mae"] == 3.5


def test_comparison_needs_twelve_points(spark):
    df = frame(spark, n11=np.arange(11), n12=np.arange(12))
    got = forecast.compare_forecasters(df, ["series"]).collect()
    assert len(got) == 6 and all((r["mae"] is None) == (r["series"] == "n11") for r in got)


def test_walk_forward_start(spark):
    df = frame(spark, n9=np.arange(9), n10=np.arange(10))
    rows = forecast.walk_forward(df, ["series"], "linear_trend").collect()
    assert {r["series"] for r in rows} == {"n10"} and [r["x"] for r in sorted(rows, key=lambda r: r["x"])] == [6, 7, 8, 9]
    assert all(abs(r["forecast"] - r["actual"]) < 1e-9 for r in rows)


def test_error_metrics_constant_actuals(spark):
    df = spark.createDataFrame([("e", 1.0, 1.0), ("e", 1.0, 1.0), ("w", 0.0, 1.0), ("w", 0.0, 1.0)], "series string, actual double, forecast double")
    got = {r["series"]: r for r in forecast.error_metrics(df, ["series"]).collect()}
    assert got["e"]["r2"] == 1.0 and got["w"]["r2"] == 0.0 and got["w"]["mape"] == 1e6 and got["w"]["r"] is None


def test_unit_root_tells_walk_from_noise(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, noise=rng.normal(size=200), walk=np.cumsum(rng.normal(size=200)))
    got = {r["series"]: r["stationary"] for r in forecast.unit_root(df, ["series"]).collect()}
    assert got == {"noise": True, "walk": False}


def test_calendar_frequency_as_pandas_names_it(spark):
    names = ["D", "3D", "W-MON", "W-SUN", "2W-TUE", "MS", "2MS", "ME", "5ME", "QS-OCT", "QE-DEC", "QS-NOV", "2QE-OCT", "YS-JAN", "YE-MAR", "2YS-JUL", "B", "h", "6h", "36h", "15min", "30s"]
    rows, want, ahead = [], {}, {}
    for name in names:
        days = pd.date_range("2023-11-07 10:30:00" if name in ("B", "3D", "ME", "W-MON") else "2023-11-07", periods=17, freq=name)
        want[name] = pd.infer_freq(days[:11])
        ahead[name] = list(days[11:])
        rows += [(name, t.to_pydatetime()) for t in days[:11]]
    rows += [("odd", datetime(2024, 1, d)) for d in (1, 2, 4, 9)] + [("few", datetime(2024, 1, d)) for d in (1, 2)] + [("one", datetime(2024, 1, 1)), ("D", rows[0][1])]
    df = spark.createDataFrame(rows, "series string, time_bin timestamp_ntz")
    got = {r["series"]: r for r in series.calendar_frequency(df, ["series"]).collect()}
    assert {k: got[k]["freq"] for k in names} == want
    assert got["odd"]["freq"] is None and got["odd"]["median_step"] == 2 * 86400 and got["few"]["freq"] is None and got["one"]["n"] == 1
    future = {}
    for r in series.calendar_future(df, ["series"], 6).orderBy("step").collect():
        future.setdefault(r["series"], []).append(r["time_bin"])
    for name in names:
        assert future[name] == [t.to_pydatetime() for t in ahead[name]], name
    assert future["one"][0] == datetime(2024, 1, 2) and future["odd"][0] == datetime(2024, 1, 11)


def adf(y, p, start=None):
    """t statistic, AIC and rows of the unit-root regression by plain least squares."""
    s = (p if start is None else start) + 1
    d = np.diff(y)
    x = np.column_stack([y[s - 1 : -1], *[d[s - 1 - j : len(d) - j] for j in range(1, p + 1)], np.ones(len(y) - s)])
    target = d[s - 1 :]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    sse = ((target - x @ beta) ** 2).sum()
    n, k = x.shape
    return beta[0] / np.sqrt(sse / (n - k) * np.linalg.inv(x.T @ x)[0, 0]), n * np.log(sse / n) + 2 * k, n


def test_augmented_unit_root(spark):
    rng = np.random.default_rng(11)
    walk = np.cumsum(rng.normal(size=300))
    lists = {"noise": 40 + rng.normal(size=250), "walk": walk, "ar": 1000 + ar1(400, 0.6, 3), "long": 1e4 + np.cumsum(ar1(260, 0.7, 9)), "flat": np.full(60, 2.0), "few": rng.normal(size=3)}
    got = {r["series"]: r for r in forecast.augmented_unit_root(frame(spark, **lists), ["series"]).collect()}
    for name in ("noise", "walk", "ar", "long"):
        y = np.asarray(lists[name])
        most = min(int(np.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2)
        best = min(range(most + 1), key=lambda p: adf(y, p, most)[1])
        t, _, n = adf(y, best)
        assert (got[name]["lags"], got[name]["t_obs"]) == (best, n) and abs(got[name]["t"] - t) < 1e-6
    assert got["noise"]["p_value"] < 1e-6 and got["ar"]["stationary"] and not got["walk"]["stationary"] and got["long"]["lags"] >= 1
    assert got["flat"]["t"] is None and got["few"]["t"] is None
    fixed = {r["series"]: r for r in forecast.augmented_unit_root(frame(spark, **lists), ["series"], 3).collect()}
    assert abs(fixed["ar"]["t"] - adf(lists["ar"], 3)[0]) < 1e-6


def test_unit_root_p_values():
    """Published points: the 1, 5 and 10 % values of long series."""
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (0.0, 0.9585)):
        assert abs(forecast.unit_root_p(t) - p) < 0.002
    assert forecast.unit_root_p(-30) == 0 and forecast.unit_root_p(5) == 1


def test_autoregression(spark):
    lists = {"a": 7 + ar1(400, 0.8, 1), "b": ar1(300, -0.7, 2), "noise": np.random.default_rng(4).normal(size=200), "flat": np.full(30, 2.0), "two": [1.0, 2.0]}
    got = {r["series"]: r for r in forecast.autoregression(frame(spark, **lists), ["series"], 3).collect()}
    for name in ("a", "b", "noise"):
        y = np.asarray(lists[name]) - np.mean(lists[name])
        r = [y[k:] @ y[: len(y) - k] / len(y) for k in range(4)]
        fits = []
        for k in range(4):
            phi = np.linalg.solve([[r[abs(i - j)] for j in range(k)] for i in range(k)], r[1 : k + 1]) if k else np.zeros(0)
            e = r[0] - phi @ r[1 : k + 1]
            fits.append((len(y) * np.log(e) + 2 * (k + 1), k, phi, e))
        _, k, phi, e = min(fits, key=lambda f: f[0])
        assert got[name]["order"] == k and np.allclose(got[name]["phi"][:k], phi) and not any(got[name]["phi"][k:]) and abs(got[name]["sigma2"] - e) < 1e-9
    assert got["flat"]["order"] == 0 and got["two"]["n"] == 2
    ahead = [r["yhat"] for r in forecast.forecast(frame(spark, a=lists["a"]), ["series"], 3, "autoregression").orderBy("step").collect()]
    best = forecast.autoregression(frame(spark, a=lists["a"]), ["series"]).first()
    y = list(lists["a"])
    for value in ahead:
        want = best["mean"] + sum(c * (y[-1 - j] - best["mean"]) for j, c in enumerate(best["phi"]))
        assert abs(value - want) < 1e-9
        y.append(want)


def test_autoregression_beats_naive_on_a_planted_series(spark):
    lists = {f"s{i}": ar1(200, 0.5, 20 + i) for i in range(12)}
    train = frame(spark, **{k: v[:-1] for k, v in lists.items()})
    err = {m: np.mean([abs(r["yhat"] - lists[r["series"]][-1]) for r in forecast.forecast(train, ["series"], 1, m).collect()]) for m in ("autoregression", "naive_last")}
    assert err["autoregression"] < err["naive_last"]


def test_two_differences_keep_their_arma_part():
    rng = np.random.default_rng(1)
    z = np.zeros(200)
    for i in range(1, 200):
        z[i] = 0.8 * z[i - 1] + rng.normal() * 0.1
    y = np.cumsum(np.cumsum(z)) + 0.002 * np.arange(200) ** 3
    assert np.isfinite(arima_forecast(y, 5)).all()
    assert fit_arma(z, 3, 0, constant=False)[0] == 0.0 and abs(fit_arma(z, 1, 0, constant=False)[1][0] - 0.8) < 0.15


def test_walk_forward_errors_have_a_row_per_series(spark):
    got = {(r["series"], r["model"]): r["mae"] for r in forecast.walk_forward_errors(frame(spark, n9=np.arange(9), n10=np.arange(10)), ["series"], ["naive_last", "linear_trend"]).collect()}
    assert got == {("n9", "naive_last"): None, ("n9", "linear_trend"): None, ("n10", "naive_last"): 1.0, ("n10", "linear_trend"): got[("n10", "linear_trend")]} and got[("n10", "linear_trend")] < 1e-9
