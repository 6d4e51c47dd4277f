from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import vectors as fn
from driftline.operators import embedding, trajectory

BINS = [datetime(2024, 1, 1) + timedelta(days=7 * i) for i in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, BINS[i % 6], ["a", "b"][i % 2 if i % 6 else 0], "alpha Beta" if i % 4 == 0 else "gamma", rng.normal(size=8).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, time_bin timestamp_ntz, source string, text string, embedding array<double>")


def test_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(fn.norm("a"), fn.unit("a"), fn.unit("z"), fn.cosine("a", "a"), fn.cosine("a", "z")).first()
    assert r[0] == 5 and r[1] == [0.6, 0.8] and r[2] == [0.0, 0.0] and abs(r[3] - 1) < 1e-9 and r[4] == 0


def test_hashed_terms(spark):
    enc = embedding.HashedTerms(32)
    v = enc(["one two two", "", "x"])
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-12 and not v[1].any() and not v[2].any()
    rows = embedding.embed(spark.createDataFrame([(1, "one two two"), (2, None)], "i long, text string"), enc).orderBy("i").collect()
    assert np.allclose(rows[0]["embedding"], v[0], atol=1e-7) and not any(rows[1]["embedding"])


def test_user_encoder(spark):
    df = spark.range(200).select("id", F.lit("abc").alias("text"))
    out = embedding.embed(df, lambda texts: np.array([[len(t), len(texts) <= 64] for t in texts], dtype=float))
    assert {tuple(r["embedding"]) for r in out.collect()} == {(3.0, 1.0)}


def test_statistics_match_numpy(spark, docs):
    x = np.array([r["embedding"] for r in docs.collect()])
    assert abs(embedding.embedding_variance(docs).first()[0] - x.var(axis=0).mean()) < 1e-12
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = (u @ u.T)[~np.eye(len(u), dtype=bool)]
    r = embedding.pairwise_cosine(docs).first()
    assert abs(r[0] - c.mean()) < 1e-12 and abs(r[1] - c.std()) < 1e-12
    n = embedding.norm_stats(docs).first()
    assert abs(n[0] - np.linalg.norm(x, axis=1).mean()) < 1e-12 and abs(n[1] - np.linalg.norm(x, axis=1).std()) < 1e-12


def test_pairwise_with_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([1.0, 1.0],), ([0.0, 0.0],)], "embedding array<double>")
    c = np.array([0.5**0.5, 0, 0] * 2)
    r = embedding.pairwise_cosine(df).first()
    assert abs(r[0] - c.mean()) < 1e-12 and abs(r[1] - c.std()) < 1e-12


def brute(docs, concept):
    rows = docs.collect()
    hit = [r["embedding"] for r in rows if concept in r["text"].lower()] or [r["embedding"] for r in rows]
    v = np.mean(hit, axis=0)
    out = {}
    for b in sorted({r["time_bin"] for r in rows}):
        m = np.mean([r["embedding"] for r in rows if r["time_bin"] == b], axis=0)
        out[b] = m @ v / np.linalg.norm(m) / np.linalg.norm(v)
    return out


def test_trajectories(spark, docs):
    got = {(r["concept"], r["time_bin"]): r["value"] for r in trajectory.concept_trajectories(docs, ["beta", "nothing"]).collect()}
    for concept in ("beta", "nothing"):
        for b, v in brute(docs, concept).items():
            assert abs(got[(concept, b)] - v) < 1e-8
    mixed = trajectory.concept_trajectories(docs.orderBy(F.rand(1)).repartition(5), ["beta", "nothing"])
    again = {(r["concept"], r["time_bin"]): r["value"] for r in mixed.collect()}
    assert all(abs(again[k] - v) < 1e-12 for k, v in got.items())


def test_trajectories_by_key_match_separate_runs(spark, docs):
    both = trajectory.concept_trajectories(docs, ["beta"], ["source"])
    for s in ("a", "b"):
        want = {r["time_bin"]: r["value"] for r in trajectory.concept_trajectories(docs.filter(F.col("source") == s), ["beta"]).collect()}
        got = {r["time_bin"]: r["value"] for r in both.filter(F.col("source") == s).collect()}
        assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-12 for b in got)


def test_empty_corpus_gives_no_rows(spark, docs):
    none = docs.filter("doc_id < 0")
    assert trajectory.concept_trajectories(none, ["beta"], ["text"]).count() == 0
    assert trajectory.concept_trajectories(none, ["beta"]).count() == 0
    assert trajectory.source_matrix(none).count() == 0
    assert embedding.embed(none.drop("embedding")).count() == 0


def test_category_concept_is_its_name(spark, docs):
    named = docs.withColumn("category", F.when(F.col("doc_id") % 2 == 0, "alpha").otherwise("delta"))
    got = {(r["category"], r["time_bin"]): r["value"] for r in trajectory.category_trajectories(named).collect()}
    for c in ("alpha", "delta"):
        for b, v in brute(named.filter(F.col("category") == c), c).items():
            assert abs(got[(c, b)] - v) < 1e-8


def test_source_matrix_fills_both_ways(spark):
    rows = [(BINS[0], "a", [1.0, 3.0]), (BINS[2], "a", [4.0, 4.0]), (BINS[1], "b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "time_bin timestamp_ntz, source string, embedding array<double>")
    got = {(r["time_bin"], r["source"]): r["value"] for r in trajectory.source_matrix(df).collect()}
    assert got == {(BINS[0], "a"): 2.0, (BINS[1], "a"): 2.0, (BINS[2], "a"): 4.0, (BINS[0], "b"): 0.5, (BINS[1], "b"): 0.5, (BINS[2], "b"): 0.5}


def test_consensus_is_scaled(spark, docs):
    traj = trajectory.concept_trajectories(docs, ["beta"]).drop("source")
    out = np.array([(r["value"], r["consensus"]) for r in trajectory.fuse_consensus(traj, docs, ["concept"]).collect()])
    assert np.allclose(out.mean(axis=0), 0, atol=1e-9) and np.allclose(out.std(axis=0), 1, atol=1e-6)


def test_dominant_ties_go_to_first_name(spark):
    df = spark.createDataFrame([(BINS[0], "b", 0.5), (BINS[0], "a", 0.5)], "time_bin timestamp_ntz, category string, prob double")
    assert trajectory.dominant_category(df).first()["category"] == "a"


def test_prevalence_bands(spark, docs):
    got = {r["concept"]: (r["prevalence"], r["quality"]) for r in trajectory.concept_prevalence(docs, ["beta", "zz"]).collect()}
    assert got == {"beta": (0.25, 0.9), "zz": (0.0, 0.3)}
