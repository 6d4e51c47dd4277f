from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from driftline.functions.stats import f_sf
from driftline.operators import causal, gram

START = datetime(2024, 1, 1)


def matrix(spark, corpus=None, **lists):
    rows = [(START + timedelta(days=i), k, float(v), corpus or "c") for k, vs in lists.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "time_bin timestamp_ntz, source string, value double, corpus string")


def planted(n=120, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=n), rng.normal(size=n)
    for i in range(1, n):
        x[i] += 0.3 * x[i - 1]
        y[i] += 0.8 * x[i - 1]
    return x, y


def edges(df):
    return {(r["cause"], r["effect"]): r for r in df.collect()}


def test_joint_test_finds_the_planted_direction(spark):
    x, y = planted()
    got = edges(causal.granger_joint(matrix(spark, x=x, y=y)))
    assert got[("x", "y")]["p_value"] < 1e-6 and got[("y", "x")]["p_value"] > 0.05 and got[("x", "y")]["lags"] == 4


def test_joint_test_equals_the_exclusion_test(spark):
    rng = np.random.default_rng(2)
    series = {k: rng.normal(size=40) for k in ("a", "b", "c")}
    got = edges(causal.granger_joint(matrix(spark, **series)))
    wide, p = pd.DataFrame(series), 4
    t, k = wide.shape
    lags = np.hstack([wide.to_numpy()[p - i : t - i] for i in range(1, p + 1)])
    df = (t - p) - k * p
    for i, c in enumerate(wide):
        for j, e in enumerate(wide):
            if i == j:
                continue
            target = wide[e].to_numpy()[p:]
            ssr = []
            for x in (lags, np.delete(lags, [i + k * m for m in range(p)], axis=1)):
                ssr.append(((target - x @ np.linalg.lstsq(x, target, rcond=None)[0]) ** 2).sum())
            f = (ssr[1] - ssr[0]) / p / (ssr[0] / df)
            assert f >= 0 and abs(got[(c, e)]["f_statistic"] - f) < 1e-8 * max(1, f)
            assert abs(got[(c, e)]["p_value"] - f_sf(np.array([f]), p, k * df)[0]) < 1e-10


def test_closed_form_p(spark):
    df = spark.createDataFrame([(1.7, 3, 24)], "f double, k int, df int").select(causal.joint_p_closed("f", "k", "df").alias("p"))
    assert abs(df.first()["p"] - f_sf(np.array([1.7]), 4, 72)[0]) < 1e-12


def test_guards(spark):
    rng = np.random.default_rng(1)
    one = matrix(spark, "one", a=rng.normal(size=30))
    few = matrix(spark, "few", a=rng.normal(size=9), b=rng.normal(size=9))
    many = matrix(spark, "many", **{f"s{i}": rng.normal(size=13) for i in range(4)})
    good = matrix(spark, "good", a=rng.normal(size=30), b=rng.normal(size=30))
    every = one.unionByName(few).unionByName(many).unionByName(good)
    status = {r["corpus"]: r["status"] for r in causal.causal_guard(every, ["corpus"]).collect()}
    assert status == {"one": "one_source", "few": "too_few_bins", "many": "too_many_sources", "good": "tested"}
    out = causal.granger_joint(every, ["corpus"])
    count = {r["corpus"]: (r["n"], r["p"], r["f"]) for r in out.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n"), F.min("p_value").alias("p"), F.max("f_statistic").alias("f")).collect()}
    assert count["few"] == (2, 1.0, 0.0) and count["many"] == (12, 1.0, 0.0) and count["good"][0] == 2 and "one" not in count
    alone = edges(causal.granger_joint(good.drop("corpus")))
    together = edges(out.filter("corpus = 'good'"))
    assert all(abs(alone[k]["p_value"] - together[k]["p_value"]) < 1e-12 for k in alone)


def test_constant_series_is_reproducible(spark):
    rng = np.random.default_rng(4)
    df = matrix(spark, a=[1.0] * 40, b=rng.normal(size=40))
    a, b = edges(causal.granger_joint(df)), edges(causal.granger_joint(df))
    assert a.keys() == b.keys() and all(a[k]["p_value"] == b[k]["p_value"] and 0 <= a[k]["p_value"] <= 1 for k in a)


def test_lag1_and_pairwise(spark):
    x, y = planted(80, 3)
    got = edges(causal.granger_lag1(matrix(spark, x=x, y=y, z=[2.0] * 80)))
    t, own, other = y[1:], y[:-1], x[:-1]
    ssr = [((t - m @ np.linalg.lstsq(m, t, rcond=None)[0]) ** 2).sum() for m in (own[:, None], np.column_stack([own, other]))]
    assert abs(got[("x", "y")]["f_statistic"] - (ssr[0] - ssr[1]) / (ssr[1] / 77)) < 1e-8
    assert len(got) == 6
    pair = edges(causal.granger_pairwise(matrix(spark, x=x, y=y), 5))
    assert pair[("x", "y")]["p_value"] < 1e-6 < pair[("y", "x")]["p_value"] and 1 <= pair[("x", "y")]["lags"] <= 5


def test_summary_clamps_and_edges(spark):
    df = spark.createDataFrame([("a", "b", float("nan"), -1.0), ("b", "a", 0.05, 3.0), ("a", "c", -0.2, float("inf")), ("c", "a", 0.3, 1.0)],
                               "cause string, effect string, p_value double, f_statistic double")
    s = causal.granger_summary(df)
    got = edges(s)
    assert tuple(got[("a", "b")])[2:] == (1.0, 0.0, "No", 0.0) and got[("a", "c")]["confidence"] == 100 and got[("a", "c")]["f_statistic"] == 0
    assert set(edges(causal.causal_edges(s))) == {("b", "a"), ("a", "c")}
    assert set(edges(causal.causal_edges(s, 0.4, 0.9))) == {("b", "a"), ("a", "c")}
    assert causal.strongest_edges(s, 1).first()["cause"] == "a"
    m = causal.matrix_summary(s.filter("cause <> 'c' and effect <> 'c'")).first()
    assert (m["min_p"], round(m["mean_p"], 6), m["max_p"], m["max_f"]) == (0.0, round(1.05 / 4, 6), 1.0, 3.0)


def test_pairs_of_many_sources(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("source"))
    assert causal.ordered_pairs(df).distinct().count() == 60 * 59


def test_impulse_response_and_lag_order(spark):
    x, y = planted(300, 7)
    df = matrix(spark, x=x, y=y)
    irf = {(r["cause"], r["effect"], r["step"]): r["response"] for r in causal.impulse_response(df, 3).collect()}
    assert irf[("x", "x", 0)] == 1 and irf[("x", "y", 0)] == 0 and abs(irf[("x", "y", 1)] - 0.8) < 0.2 and abs(irf[("y", "x", 1)]) < 0.2
    order = {r["lag"]: r["best"] for r in causal.lag_order(df).collect()}
    assert len(order) == 4 and order[1]


def test_gram_blocks_equal_the_product(spark):
    """Blocks of two sources, runs of 64 bins, corpora of different lags: every sum as in one matrix product."""
    rng = np.random.default_rng(6)
    data = {"long": (rng.normal(size=(200, 5)), 3), "short": (rng.normal(size=(11, 2)), 1)}
    rows = [(c, START + timedelta(days=t), f"s{i}", float(v), p) for c, (y, p) in data.items() for t, line in enumerate(y) for i, v in enumerate(line)]
    df = spark.createDataFrame(rows, "corpus string, time_bin timestamp, source string, value double, lags int").repartition(7)
    found = {}
    for r in gram.lagged_gram(df, "corpus", 3, block=2).collect():
        found.setdefault(r["corpus"], []).append((r["a"], r["b"], r["gram"]))
    for c, (y, p) in data.items():
        z = np.stack([y[p - lag : len(y) - lag, i] for i in range(y.shape[1]) for lag in range(p + 1)], axis=1)
        assert np.allclose(gram.Moments(found[c], y.shape[1], p, len(y) - p, block=2).sums, z.T @ z)
        assert len(found[c]) == {"long": 6, "short": 1}[c]


def test_moments_equal_least_squares(spark):
    rng = np.random.default_rng(8)
    series = {k: 0.5 + 0.01 * rng.normal(size=150).cumsum() for k in ("a", "b", "c")}
    df = matrix(spark, **series)
    y = np.column_stack(list(series.values()))
    t, k = y.shape
    irf = {(r["cause"], r["effect"], r["step"]): r["response"] for r in causal.impulse_response(df, 2).collect()}
    x = np.hstack([y[4 - i : t - i] for i in range(1, 5)])
    coef = np.linalg.lstsq(x, y[4:], rcond=None)[0]
    for i, c in enumerate(series):
        for j, e in enumerate(series):
            assert abs(irf[(c, e, 1)] - coef[i, j]) < 1e-6
            assert abs(irf[(c, e, 2)] - (coef[:k].T @ coef[:k].T + coef[k : 2 * k].T)[j, i]) < 1e-6
    aic = {r["lag"]: r["aic"] for r in causal.lag_order(df, 3).collect()}
    for p in (1, 2, 3):
        x = np.hstack([y[3 - i : t - i] for i in range(1, p + 1)])
        res = y[3:] - x @ np.linalg.lstsq(x, y[3:], rcond=None)[0]
        assert abs(aic[p] - (np.linalg.slogdet(res.T @ res / (t - 3))[1] + 2 / (t - 3) * p * k * k)) < 1e-6


def test_confidence(spark):
    df = spark.createDataFrame([(3,), (7,), (15,), (96,)], "bins int")
    got = [(r["confidence"], r["stepped_confidence"]) for r in causal.causal_confidence(df).orderBy("bins").collect()]
    assert got == [(0.1, 0.1), (0.14, 0.3), (0.3, 0.6), (0.9, 0.85)]
