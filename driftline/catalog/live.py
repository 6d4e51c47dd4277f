"""Streaming runs over a landing folder written from the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.catalog.base import CORPUS, corpus, embedded, query, r
from driftline.catalog.corpus import CLEAN
from driftline.catalog.vectors import TRAJECTORY
from driftline.operators import trajectory
from driftline.session import shared_dir
from driftline.streaming import live


def _landing(spark, rows):
    base = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/landing")
    return base, live.read_landing(spark, f"{base}/landing", rows.schema)


@query("stream_trajectory", f"""WITH {TRAJECTORY}, n AS (SELECT time_bin, count(*) AS docs FROM embedded GROUP BY time_bin)
SELECT time_bin, docs, {r('value')} AS value FROM traj JOIN n USING (time_bin) WHERE concept = 'that'""")
def stream_trajectory(spark, folder):
    docs = embedded(spark, folder).select("doc_id", "text", "published", "time_bin", "embedding")
    concept = trajectory.concept_vectors(trajectory.group_means(docs, ["that"]), ["that"]).first()["concept_vec"]
    base, stream = _landing(spark, docs.select("published", "embedding"))
    rows = stream.withColumn("published", live.utc_instant("published"))
    live.run_merged(rows, f"{base}/centroids", f"{base}/state")
    return live.live_trajectory(live.merged_centroids(spark, f"{base}/centroids"), concept)


@query("stream_dedup", f"WITH {CORPUS} SELECT url, count(*) AS rows, min(text) AS text FROM (SELECT 'u' || doc_id AS url, {CLEAN.format('text')} AS text FROM corpus) GROUP BY url")
def stream_dedup(spark, folder):
    docs = corpus(spark, folder).select(F.concat(F.lit("u"), "doc_id").alias("url"), "text", "published")
    base, stream = _landing(spark, docs.unionByName(docs.withColumn("text", F.concat(F.lit(" "), "text"))))
    live.run_available(live.clean_stream(stream), f"{base}/clean", f"{base}/state")
    out = spark.read.parquet(f"{base}/clean")
    return out.groupBy("url").agg(F.count(F.lit(1)).alias("rows"), F.min("text").alias("text"))
