"""Embeddings, pooled vectors, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.base import (
    documents, CONCEPTS, CONCEPTS_SQL, CORPUS, DIMS, EMBEDDED, LANG_MATRIX, PROBS, MARKERS, VECTOR_PARTS, VECTORS, corpus, embedded, hashed_sql, lang_matrix,
    marker_probs, query, r, vectors,
)
from driftline.functions import vectors as fn
from driftline.operators import embedding, series, trajectory

def hashed(spark, folder, columns=("doc_id", "text")):
    """Every document with its hashed vector."""
    return embedding.embed(corpus(spark, folder).select(*columns), embedding.HashedTerms(DIMS))


@query("hashed_embedding", f"WITH {hashed_sql()} SELECT doc_id, CAST(pos AS INTEGER) AS pos, {r('x')} AS value FROM hashed")
def hashed_embedding(spark, folder):
    rows = hashed(spark, folder).select("doc_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.filter(F.col("value") != 0).withColumn("value", F.col("value").cast("double"))


BIN_PARTS = EMBEDDED + """,
cent AS (SELECT time_bin, pos, avg(x) AS c FROM parts GROUP BY ALL)"""


@query("bin_centroids", f"WITH {BIN_PARTS} SELECT time_bin, CAST(pos - 1 AS INTEGER) AS pos, {r('c')} AS value FROM cent")
def bin_centroids(spark, folder):
    rows = embedding.mean_vectors(embedded(spark, folder), ["time_bin"])
    return rows.select("time_bin", F.posexplode("centroid").alias("pos", "value"))


@query("unit_vectors", f"""WITH {VECTOR_PARTS}, s AS (SELECT vec_id, sum(x) AS t, sqrt(sum(x * x)) AS n FROM parts GROUP BY vec_id)
SELECT vec_id, {r('n')} AS norm, {r('t / n')} AS unit_total FROM s""")
def unit_vectors(spark, folder):
    rows = vectors(spark, folder)
    return rows.select("vec_id", fn.norm("embedding").alias("norm"), fn.total(fn.unit("embedding")).alias("unit_total"))


CONCEPT_VECS = EMBEDDED + f""", {CONCEPTS_SQL},
whole AS (SELECT pos, avg(x) AS c FROM parts GROUP BY pos),
hit AS (SELECT concept, pos, avg(x) AS c FROM parts, concepts WHERE regexp_matches(lower(text), lower(concept)) GROUP BY ALL),
raw AS (SELECT k.concept, w.pos, coalesce(h.c, w.c) AS c FROM concepts k CROSS JOIN whole w LEFT JOIN hit h ON h.concept = k.concept AND h.pos = w.pos),
cvec AS (SELECT concept, pos, c / sqrt(sum(c * c) OVER (PARTITION BY concept)) AS c FROM raw)"""


@query("concept_vectors", f"WITH {CONCEPT_VECS} SELECT concept, CAST(pos - 1 AS INTEGER) AS pos, {r('c')} AS value FROM cvec")
def concept_vectors(spark, folder):
    rows = trajectory.concept_vectors(trajectory.group_means(embedded(spark, folder), CONCEPTS), CONCEPTS)
    return rows.select("concept", F.posexplode("concept_vec").alias("pos", "value"))


@query("concept_cosine", f"""WITH {CONCEPT_VECS}
SELECT p.doc_id, c.concept, {r('sum(p.x * c.c) / (sqrt(sum(p.x * p.x)) * sqrt(sum(c.c * c.c)) + 1e-9)')} AS value
FROM parts p JOIN cvec c ON p.pos = c.pos GROUP BY ALL""")
def concept_cosine(spark, folder):
    docs = embedded(spark, folder)
    vecs = trajectory.concept_vectors(trajectory.group_means(docs, CONCEPTS), CONCEPTS)
    fan = docs.select("doc_id", "embedding", F.explode(F.array(*[F.lit(c) for c in CONCEPTS])).alias("concept"))
    return fan.join(vecs, "concept").select("doc_id", "concept", fn.cosine("embedding", "concept_vec").alias("value"))


@query("centroid_norms", f"""WITH {EMBEDDED}, cent AS (SELECT time_bin, source, pos, avg(x) AS c, count(*) AS docs FROM parts GROUP BY ALL)
SELECT time_bin, source, {r('sqrt(sum(c * c))')} AS scalar, max(docs) AS docs FROM cent GROUP BY time_bin, source""")
def centroid_norms(spark, folder):
    return trajectory.source_centers(embedded(spark, folder))


@query("component_means", f"WITH {EMBEDDED} SELECT time_bin, source, {r('sum(x) / count(*)')} AS value FROM parts GROUP BY ALL")
def component_means(spark, folder):
    return trajectory.source_observations(embedded(spark, folder))


@query("embedding_variance", f"WITH {VECTOR_PARTS} SELECT {r('avg(s)')} AS mean_variance FROM (SELECT var_pop(x) AS s FROM parts GROUP BY pos)")
def embedding_variance(spark, folder):
    return embedding.embedding_variance(vectors(spark, folder))


@query("pairwise_cosine", f"""WITH {VECTORS} SELECT {r('avg(c)')} AS cosine_mean, {r('stddev_pop(c)')} AS cosine_std FROM (
  SELECT list_cosine_similarity(a.v, b.v) AS c FROM vecs a, vecs b WHERE a.vec_id <> b.vec_id)""")
def pairwise_cosine(spark, folder):
    return embedding.pairwise_cosine(vectors(spark, folder))


@query("norm_stats", f"""WITH {VECTOR_PARTS} SELECT {r('avg(s)')} AS norm_mean, {r('stddev_pop(s)')} AS norm_std FROM (
  SELECT sqrt(sum(x * x)) AS s FROM parts GROUP BY vec_id)""")
def norm_stats(spark, folder):
    return embedding.norm_stats(vectors(spark, folder))


@query("keyword_trajectory", f"""WITH {CORPUS}, {hashed_sql()}, kw AS (SELECT 0 AS k, 'the market of the nation' AS text), {hashed_sql('kw', 'k', 'text', 'key')},
sims AS (SELECT h.doc_id, sum(h.x * k.x) AS s FROM hashed h JOIN key k ON h.pos = k.pos GROUP BY h.doc_id)
SELECT time_bin, {r('avg(greatest(0, least(1, coalesce(s, 0))))')} AS value, count(*) AS docs FROM corpus LEFT JOIN sims USING (doc_id) GROUP BY time_bin""")
def keyword_trajectory(spark, folder):
    key = embedding.HashedTerms(DIMS)(["the market of the nation"])[0].astype("float32").tolist()
    return trajectory.keyword_trajectory(hashed(spark, folder, ("time_bin", "text")), key)


TRAJECTORY = CONCEPT_VECS + """,
cent AS (SELECT time_bin, pos, avg(x) AS c FROM parts GROUP BY ALL),
scaled AS (SELECT time_bin, pos, c / sqrt(sum(c * c) OVER (PARTITION BY time_bin)) AS c FROM cent),
traj AS (SELECT v.concept, s.time_bin, sum(s.c * v.c) / (sqrt(sum(s.c * s.c)) * sqrt(sum(v.c * v.c)) + 1e-9) AS value
  FROM scaled s JOIN cvec v ON s.pos = v.pos GROUP BY ALL)"""


def concept_trajectory_rows(spark, folder):
    return trajectory.concept_trajectories(embedded(spark, folder), CONCEPTS)


@query("concept_trajectories", f"WITH {TRAJECTORY} SELECT concept, time_bin, {r('value')} AS value, 'consensus-free' AS source FROM traj")
def concept_trajectories(spark, folder):
    return concept_trajectory_rows(spark, folder)


HASHED_TRAJECTORY = CORPUS + f""", {CONCEPTS_SQL}, {hashed_sql()},
hdocs AS (SELECT doc_id, time_bin, text, pos, x FROM hashed JOIN corpus USING (doc_id)),
cent AS (SELECT time_bin, pos, sum(x) AS c FROM hdocs GROUP BY ALL),
whole AS (SELECT pos, sum(x) AS c FROM hdocs GROUP BY pos),
hit AS (SELECT concept, pos, sum(x) AS c FROM hdocs, concepts WHERE regexp_matches(lower(text), lower(concept)) GROUP BY ALL),
raw AS (SELECT * FROM hit UNION ALL SELECT k.concept, w.pos, w.c FROM concepts k, whole w WHERE k.concept NOT IN (SELECT concept FROM hit)),
cvec AS (SELECT concept, pos, c / sqrt(sum(c * c) OVER (PARTITION BY concept)) AS c FROM raw),
scaled AS (SELECT time_bin, pos, c / sqrt(sum(c * c) OVER (PARTITION BY time_bin)) AS c FROM cent),
traj AS (SELECT v.concept, s.time_bin, sum(s.c * v.c) / (1 + 1e-9) AS value FROM scaled s JOIN cvec v ON s.pos = v.pos GROUP BY ALL)"""


@query("hashed_trajectories", f"WITH {HASHED_TRAJECTORY} SELECT concept, time_bin, {r('value')} AS value, 'consensus-free' AS source FROM traj")
def hashed_trajectories(spark, folder):
    docs = embedding.embed(corpus(spark, folder).select("doc_id", "text", "time_bin"), embedding.HashedTerms(DIMS))
    return trajectory.concept_trajectories(docs, CONCEPTS)


@query("category_trajectories", f"""WITH {EMBEDDED}, whole AS (SELECT lang, pos, avg(x) AS c FROM parts GROUP BY ALL),
hit AS (SELECT lang, pos, avg(x) AS c FROM parts WHERE regexp_matches(lower(text), lower(lang)) GROUP BY ALL),
raw AS (SELECT lang, pos, coalesce(h.c, w.c) AS c FROM whole w LEFT JOIN hit h USING (lang, pos)),
cvec AS (SELECT lang, pos, c / sqrt(sum(c * c) OVER (PARTITION BY lang)) AS c FROM raw),
cent AS (SELECT lang, time_bin, pos, avg(x) AS c FROM parts GROUP BY ALL),
scaled AS (SELECT lang, time_bin, pos, c / sqrt(sum(c * c) OVER (PARTITION BY lang, time_bin)) AS c FROM cent)
SELECT s.lang, time_bin, {r('sum(s.c * v.c) / (sqrt(sum(s.c * s.c)) * sqrt(sum(v.c * v.c)) + 1e-9)')} AS value
FROM scaled s JOIN cvec v ON s.lang = v.lang AND s.pos = v.pos GROUP BY s.lang, time_bin""")
def category_trajectories(spark, folder):
    return trajectory.category_trajectories(embedded(spark, folder), "lang")


@query("concept_prevalence", f"""WITH {CONCEPTS_SQL}, p AS (SELECT concept, avg(CAST(regexp_matches(lower(text), lower(concept)) AS DOUBLE)) AS s
  FROM documents, concepts GROUP BY concept)
SELECT concept, {r('s')} AS prevalence, CAST(CASE WHEN s < 0.01 THEN 0.3 WHEN s < 0.05 THEN 0.6 ELSE 0.9 END AS DOUBLE) AS quality FROM p""")
def concept_prevalence(spark, folder):
    return trajectory.concept_prevalence(documents(spark, folder).select("text"), CONCEPTS)


@query("trajectory_stats", f"""WITH {TRAJECTORY} SELECT concept, count(*) AS n, {r('min(value)')} AS min, {r('max(value)')} AS max,
  {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std FROM traj GROUP BY concept""")
def trajectory_stats(spark, folder):
    return series.series_stats(concept_trajectory_rows(spark, folder), ["concept"])


@query("consensus", f"""WITH {TRAJECTORY}, sc AS (SELECT time_bin, source, pos, avg(x) AS c FROM parts GROUP BY ALL),
nrm AS (SELECT time_bin, source, sqrt(sum(c * c)) AS s FROM sc GROUP BY ALL),
fused AS (SELECT time_bin, avg(s) AS consensus FROM nrm GROUP BY time_bin)
SELECT concept, time_bin, {r('(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9)')} AS value,
  {r('(consensus - avg(consensus) OVER w) / (stddev_pop(consensus) OVER w + 1e-9)')} AS consensus
FROM traj LEFT JOIN fused USING (time_bin) WINDOW w AS (PARTITION BY concept)""")
def consensus(spark, folder):
    rows = concept_trajectory_rows(spark, folder).drop("source")
    return trajectory.fuse_consensus(rows, embedded(spark, folder), ["concept"])


@query("source_matrix", f"WITH {LANG_MATRIX} SELECT time_bin, source, {r('value')} AS value FROM matrix")
def source_matrix(spark, folder):
    return lang_matrix(spark, folder)


@query("probability_trajectory", f"""WITH {PROBS}, s AS (SELECT time_bin, category, avg(prob) AS m, stddev_samp(prob) AS d, count(*) AS n FROM probs GROUP BY ALL)
SELECT time_bin, category, {r('m')} AS mean, {r('d')} AS std, n AS count, {r('m - d')} AS low, {r('m + d')} AS high FROM s""")
def probability_trajectory(spark, folder):
    return trajectory.probability_trajectory(marker_probs(spark, folder))


@query("probability_by_bin", f"WITH {PROBS} SELECT time_bin, " + ", ".join(
    f"{r(f'''avg(prob) FILTER (category = '{c}')''')} AS {c}" for c in MARKERS) + " FROM probs GROUP BY time_bin")
def probability_by_bin(spark, folder):
    return trajectory.probability_by_bin(marker_probs(spark, folder), list(MARKERS))


@query("dominant_category", f"""WITH {PROBS}, s AS (SELECT time_bin, category, avg(prob) AS m FROM probs GROUP BY ALL)
SELECT time_bin, category, {r('m')} AS mean FROM (SELECT *, row_number() OVER (PARTITION BY time_bin ORDER BY round(m, 9) DESC, category) AS rn FROM s) WHERE rn = 1""")
def dominant_category(spark, folder):
    return trajectory.dominant_category(marker_probs(spark, folder))
