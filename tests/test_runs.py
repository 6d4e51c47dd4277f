from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import trajectory
from driftline.operators.corpus import time_bins
from driftline.operators.embedding import HashedTerms, mean_vectors
from driftline.plans import runs
from driftline.streaming import live

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(f"u{i}", f"Title number {i}", f"privacy text {i % 7} http://x.y/{i}" if i % 3 else f"other topic {i % 5}", ["rss", "arxiv"][i % 2],
             START + timedelta(days=i % 140)) for i in range(400)]
    return spark.createDataFrame(rows, "url string, title string, text string, source string, published timestamp_ntz")


def test_concept_run(spark, raw):
    opt = runs.RunOptions(freq="W", steps=4, start=START, end=START + timedelta(days=200))
    embedded = runs.prepare([raw], opt)
    assert embedded.count() == 400 and embedded.filter(F.contains("text", F.lit("http"))).count() == 0
    rows = runs.concept_run(embedded, opt).collect()
    assert sum(r["kind"] == "observed" for r in rows) == 20 and sorted(r["step"] for r in rows if r["kind"] == "forecast") == [1, 2, 3, 4]
    summary = {r["item"]: r["value"] for r in runs.run_summary(embedded, opt).collect()}
    assert summary["docs:rss"] == 200 and summary["bins"] == 20 and summary["causal_sources"] == 2 and summary["forecast_steps"] == 4
    assert 1 <= summary["topics"] <= 8 and 0 <= summary["significant_relationships"] <= 2
    traj = trajectory.concept_trajectories(embedded, ["privacy"])
    scores = {r["metric"]: r["value"] for r in runs.evaluate(embedded, traj).collect()}
    assert scores["retrieval_recall_at1"] == 0.0 and -1 <= scores["clustering_silhouette"] <= 1 and scores["backtest_mae"] >= 0


def test_run_summary_embeds_every_document_once(spark, raw):
    opt = runs.RunOptions(freq="W", steps=4, start=START, end=START + timedelta(days=200))
    texts = spark.sparkContext.accumulator(0)
    plain = HashedTerms(16)

    def encoder(batch):
        texts.add(len(batch))
        return plain(batch)

    from driftline.operators.embedding import embed

    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(key, "10000")
        embedded = embed(time_bins(raw, "W").withColumn("doc_id", F.xxhash64("url")), encoder)
        assert int(spark.conf.get(key)) <= 2000
    finally:
        spark.conf.set(key, before)
    summary = {r["item"]: r["value"] for r in runs.run_summary(embedded, opt).collect()}
    assert summary["docs:rss"] == 200 and summary["bins"] == 20
    assert texts.value == 400


def test_default_range_is_the_last_180_days(spark, raw):
    old = raw.limit(1).withColumn("published", F.lit(START - timedelta(days=100)).cast("timestamp_ntz"))
    assert runs.prepare([raw, old], runs.RunOptions()).count() == 400


def test_stream_equals_batch(spark, raw, tmp_path):
    docs = time_bins(raw, "W").select("published", "time_bin", "text")
    from driftline.operators.embedding import embed

    docs = embed(docs, HashedTerms(16)).drop("text")
    landing = str(tmp_path / "landing")
    docs.repartition(6).write.parquet(landing)
    stream = live.read_landing(spark, landing, spark.read.parquet(landing).schema, files_per_trigger=2)
    stream = stream.withColumn("published", live.utc_instant("published"))
    live.run_merged(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["time_bin"]: (r["docs"], r["centroid"]) for r in live.merged_centroids(spark, str(tmp_path / "out")).collect()}
    want = {r["time_bin"]: (r["docs"], r["centroid"]) for r in mean_vectors(docs, ["time_bin"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[b][0] == want[b][0] and np.allclose(got[b][1], want[b][1]) for b in want)


def test_late_and_out_of_order_files_are_merged(spark, raw, tmp_path):
    """Files from the newest week to the oldest, one per batch, in three runs; the table equals the batch result and old versions go."""
    import random

    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(days=rng.randint(0, 90)), [rng.random(), rng.random(), 1.0]) for _ in range(400)] + [(start, None)]
    rows.sort(key=lambda r: r[0], reverse=True)
    schema = "published timestamp_ntz, embedding array<double>"
    landing, out = str(tmp_path / "late"), str(tmp_path / "late-out")
    for part in range(3):
        for k in range(4):
            lo = (part * 4 + k) * 34
            spark.createDataFrame(rows[lo : lo + 34], schema).coalesce(1).write.mode("append").parquet(landing)
        stream = live.read_landing(spark, landing, spark.read.parquet(landing).schema, files_per_trigger=1)
        stream = stream.withColumn("published", live.utc_instant("published"))
        live.run_merged(stream, out, str(tmp_path / "late-state"))
        assert len(live.versions(spark, out)) <= 2
    assert live.versions(spark, out)[-1] == 11
    got = {r["time_bin"]: (r["docs"], r["centroid"]) for r in live.merged_centroids(spark, out).collect()}
    want = {}
    for when, v in rows:
        if v:
            want.setdefault(when - timedelta(days=when.weekday()), []).append(v)
    assert got.keys() == want.keys()
    for when, vs in want.items():
        assert got[when][0] == len(vs) and all(abs(a - sum(c) / len(vs)) < 1e-12 for a, c in zip(got[when][1], zip(*vs), strict=True))
    assert stream.sparkSession.read.parquet(live._version(out, 11)).count() == len(want)  # a row per window, nothing else is kept


def test_stream_dedup(spark, raw, tmp_path):
    landing = str(tmp_path / "landing")
    raw.unionByName(raw.limit(50)).repartition(3).write.parquet(landing)
    out = live.clean_stream(live.read_landing(spark, landing, raw.schema))
    live.run_available(out, str(tmp_path / "clean"), str(tmp_path / "state"))
    live.run_available(out, str(tmp_path / "clean"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "clean"))
    assert rows.count() == 400 and rows.filter(F.contains("text", F.lit("http"))).count() == 0
