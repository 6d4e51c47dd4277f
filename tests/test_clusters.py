import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import clusters, lloyd, quality


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5)) + np.repeat(rng.normal(size=(3, 5)) * 2, 30, axis=0)
    label = np.array(["a"] * 40 + ["b"] * 49 + ["lonely"])
    return x, label


@pytest.fixture(scope="module")
def df(spark, data):
    x, label = data
    return spark.createDataFrame([(i, x[i].tolist(), str(label[i])) for i in range(len(x))], "id long, embedding array<double>, label string")


def brute_silhouette(d, label):
    out = []
    for i in range(len(d)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def distances(x, metric):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
        np.fill_diagonal(d, 0)
        return d
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    return d**2 if metric == "sqeuclidean" else d


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean", "euclidean", "euclidean_exact"])
@pytest.mark.parametrize("slices", [False, True])
def test_silhouette(spark, df, data, metric, slices, monkeypatch):
    if slices:
        monkeypatch.setattr(clusters, "SLICE_CELLS", 6)
    x, label = data
    got = clusters.silhouette(df, "id", "label", metric=metric).first()[0]
    assert abs(got - brute_silhouette(distances(x, metric), label)) < 1e-9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sampled_silhouette_keeps_its_bound(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(900, 4)) + np.repeat(rng.normal(size=(3, 4)) * 2, 300, axis=0)
    label = np.array([["a", "b", "c"][i // 300] for i in range(900)])
    rows = spark.createDataFrame([(i + 10_000 * seed, x[i].tolist(), str(label[i])) for i in range(900)], "id long, embedding array<double>, label string")
    got = clusters.sampled_silhouettes(rows, "id", "label", per_cluster=60).agg(F.avg("silhouette").alias("s"), F.avg("error").alias("e"), F.count("*").alias("n")).first()
    exact = brute_silhouette(distances(x, "euclidean"), label)
    assert got["n"] == 900 and 0 < abs(got["s"] - exact) <= got["e"] < 0.5
    whole = clusters.sampled_silhouettes(rows, "id", "label", per_cluster=300).agg(F.avg("silhouette").alias("s"), F.max("error").alias("e")).first()
    assert abs(whole["s"] - exact) < 1e-9 and whole["e"] == 0


def test_silhouette_degenerate(spark, df):
    assert clusters.silhouette(df.limit(9), "id", "label", compat=True).first()[0] == 0.0
    assert clusters.silhouette(df.withColumn("label", F.lit("x")), "id", "label").first()[0] is None


def test_davies_bouldin_and_calinski(spark, df, data):
    x, label = data
    names = sorted(set(label))
    c = np.array([x[label == n].mean(axis=0) for n in names])
    s = np.array([np.linalg.norm(x[label == n] - c[i], axis=1).mean() for i, n in enumerate(names)])
    ratio = [max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)]
    assert abs(clusters.davies_bouldin(df, "label").first()[0] - np.mean(ratio)) < 1e-9
    n = np.array([(label == m).sum() for m in names])
    between = (n * ((c - x.mean(axis=0)) ** 2).sum(axis=1)).sum()
    within = sum(((x[label == m] - c[i]) ** 2).sum() for i, m in enumerate(names))
    assert abs(clusters.calinski_harabasz(df, "label").first()[0] - (between / 2) / (within / 87)) < 1e-8


def test_label_scores_extremes(spark):
    same = spark.createDataFrame([(i % 3, "xyz"[i % 3]) for i in range(30)], "c int, l string")
    assert [round(v, 9) for v in clusters.label_agreement_scores(same, "c", "l").first()] == [1, 1, 1, 1]
    one = same.withColumn("c", F.lit(0))
    r = clusters.label_agreement_scores(one, "c", "l").first()
    assert abs(r["ari"]) < 1e-12 and abs(r["nmi"]) < 1e-12 and abs(r["purity"] - 1 / 3) < 1e-12


def test_topics(spark, df):
    rows = clusters.assign_topics(df, "id", n_topics=3, restarts=2)
    sizes = clusters.topic_sizes(rows).collect()
    assert sum(r["size"] for r in sizes) == 90 and len(sizes) == 3
    single = clusters.assign_topics(df.limit(39), "id", restarts=2)
    assert single.select("topic").distinct().count() == 1
    assert clusters.topic_sizes(clusters.assign_topics(df.limit(0), "id")).count() == 0
    assert (clusters.topic_count(19), clusters.topic_count(40), clusters.topic_count(10**6)) == (1, 2, 8)


def test_all_starts_share_the_scans(spark, df, data, monkeypatch):
    x, label = data
    scans = []
    real = lloyd._scan
    monkeypatch.setattr(lloyd, "_scan", lambda rows, vec, fits: scans.append(len(fits)) or real(rows, vec, fits))
    starts = [lloyd.spread_starts(x, k, seed) for k, seed in ((3, 1), (3, 2), (3, 3), (4, 1), (2, 5))]
    fits = lloyd.fit_many(df, "embedding", starts)
    assert len(scans) == max(f.steps for f in fits) + 1 and scans[0] == scans[-1] == 5
    for f, start in zip(fits, starts, strict=True):  # each fit as on its own
        centres = start
        for _ in range(f.steps):
            best = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[best == c].mean(0) if (best == c).any() else centres[c] for c in range(len(centres))])
        assert np.allclose(f.centres, centres) and abs(f.cost - ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()) < 1e-8
    by_label = sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in set(label))
    assert min(f.cost for f in fits[:3]) <= by_label
    for f, got in zip(fits, lloyd.silhouettes(df, "embedding", fits), strict=True):
        best = ((x[:, None] - f.centres[None]) ** 2).sum(2).argmin(1)
        assert abs(got - brute_silhouette(distances(x, "sqeuclidean"), best)) < 1e-9


def test_lloyd_odd_cases(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id long, embedding array<double>")
    fit = lloyd.fit_many(same, "embedding", [lloyd.spread_starts(np.ones((30, 2)), 3, 0)])[0]
    assert fit.sizes.tolist() == [30, 0, 0] and lloyd.silhouettes(same, "embedding", [fit]) == [None]
    assert clusters.choose_k(same.limit(0), "id").count() == 0


def test_choose_k(spark, df):
    out = clusters.choose_k(df, "id", ks=(2, 3, 4)).collect()
    assert sum(r["best"] for r in out) == 1 and max(out, key=lambda r: r["silhouette"])["best"]


def test_nearest_centroid_slices(spark, df, data, monkeypatch):
    x, label = data
    centers = spark.createDataFrame([(n, x[label == n].mean(axis=0).tolist()) for n in sorted(set(label))], "topic string, c array<double>")
    want = {r["id"]: r["topic"] for r in clusters.nearest_centroid(df, centers, "id", "topic", "c").collect()}
    monkeypatch.setattr(clusters, "SLICE_CELLS", 5)
    assert want == {r["id"]: r["topic"] for r in clusters.nearest_centroid(df, centers, "id", "topic", "c").collect()} and len(want) == 90


def test_balance(spark):
    df = spark.createDataFrame([(i % 2,) for i in range(10)], "c int")
    assert {round(r["balance"], 6) for r in clusters.cluster_balance(df, "c").collect()} == {1.0}


def test_report_and_auc(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    rep = {r["class"]: r for r in quality.class_report(df).collect()}
    assert (rep["a"]["precision"], rep["a"]["recall"]) == (1.0, 0.5) and rep["c"]["f1"] == 0 and abs(rep["b"]["f1"] - 0.5) < 1e-12
    acc = quality.accuracy_scores(df).first()
    assert acc["accuracy"] == 0.5
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[i % 3], c, float(np.round(rng.random(), 1))) for i in range(200) for c in "abz"]
    scores = spark.createDataFrame(rows, "id long, truth string, category string, prob double")
    got = {r["category"]: r["auc"] for r in quality.roc_auc(scores).collect()}
    for c in "ab":
        pos = np.array([p for _, t, k, p in rows if k == c and t == c])
        neg = np.array([p for _, t, k, p in rows if k == c and t != c])
        want = ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())
        assert abs(got[c] - want) < 1e-12
    assert got["z"] is None


def test_scores_and_grades(spark):
    df = spark.createDataFrame([("m", 0.9), ("a", 0.9), ("z", None)], "model string, accuracy double")
    assert tuple(quality.best_model(df).first()) == ("a", 0.9, "Very Good")
    assert tuple(quality.overall_score(df, "accuracy").first()) == (0.9, "Excellent")
    assert quality.overall_score(df.filter("accuracy is null"), "accuracy").count() == 0
