"""Topics, neighbours, clustering quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftline.catalog.base import documents, CORPUS, DIMS, EMBEDDED, STORED, VECTOR_PARTS, VECTORS, corpus, embedded, hashed_sql, query, r, stored, vectors
from driftline.operators import clusters, embedding, lloyd, neighbours
from driftline.operators.ranking import stratified_split
from driftline.session import settle

# The stored labels serve as clusters and the languages or sources as true labels.
SIMS = VECTORS + """,
sims AS (SELECT a.vec_id, b.vec_id AS other, a.label, b.label AS other_label, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS rn FROM sims)"""


@query("topics")
def topics(spark, folder):
    return clusters.topic_sizes(clusters.assign_topics(vectors(spark, folder), "vec_id"))


@query("choose_k")
def choose_k(spark, folder):
    return clusters.choose_k(vectors(spark, folder), "vec_id")


def _lloyd_sql(steps: int) -> str:
    """Lloyd steps from two starts: the labels' centroids, and those of vec_id modulo 3."""
    def centres(rows: str) -> str:
        return f"""(SELECT start, c, list(x ORDER BY pos) AS m FROM (
  SELECT start, c, pos, avg(x) AS x FROM (SELECT start, c, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM {rows}) GROUP BY ALL) GROUP BY ALL)"""

    out = """WITH vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
a0 AS (SELECT vec_id, v, 'labels' AS start, label AS c, 0.0::DOUBLE AS d FROM vecs UNION ALL SELECT vec_id, v, 'thirds', vec_id % 3, 0.0 FROM vecs)"""
    for k in range(1, steps + 2):
        out += f""",
c{k} AS {centres(f'a{k - 1}')},
a{k} AS (SELECT * EXCLUDE (rn) FROM (SELECT vec_id, v, c.start, c.c, list_distance(v, m) ** 2 AS d,
  row_number() OVER (PARTITION BY vec_id, c.start ORDER BY list_distance(v, m), c.c) AS rn FROM vecs, c{k} c) WHERE rn = 1)"""
    return out + f" SELECT start, CAST(c AS INTEGER) AS cluster, count(*) AS size, {r('sum(d)')} AS cost FROM a{steps + 1} GROUP BY ALL"


@query("lloyd_steps", _lloyd_sql(3))
def lloyd_steps(spark, folder):
    rows = vectors(spark, folder)
    starts = {}
    for name, key in (("labels", F.col("label")), ("thirds", F.col("vec_id") % 3)):
        found = embedding.mean_vectors(rows.withColumn("c", key), ["c"]).orderBy("c").collect()  # a row per centre
        starts[name] = ([f["c"] for f in found], np.array([f["centroid"] for f in found]))
    fits = lloyd.fit_many(rows, "embedding", [c for _, c in starts.values()], max_steps=3, tolerance=0.0)
    out = [(name, int(c), int(n), float(cost)) for (name, (ids, _)), f in zip(starts.items(), fits) for c, n, cost in zip(ids, f.sizes, f.costs) if n]
    return spark.createDataFrame(out, "start string, cluster int, size long, cost double")


@query("cluster_balance", f"""WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label), p AS (SELECT *, size / sum(size) OVER () AS share FROM s)
SELECT label, size, {r('share')} AS share, {r('-sum(share * ln(share + 1e-10)) OVER () / ln(count(*) OVER ())')} AS balance FROM p""")
def cluster_balance(spark, folder):
    return clusters.cluster_balance(vectors(spark, folder), "label")


@query("contingency", f"WITH {STORED} SELECT label, lang, count(*) AS n FROM stored WHERE label IS NOT NULL GROUP BY ALL")
def contingency(spark, folder):
    return clusters.contingency(stored(spark, folder).where("label IS NOT NULL"), "label", "lang")


@query("nearest_centroid", f"""WITH {VECTOR_PARTS}, cent AS (SELECT label AS k, pos, avg(x) AS c FROM parts GROUP BY ALL),
d AS (SELECT vec_id, k, sum((x - c) ** 2) AS d FROM parts JOIN cent USING (pos) GROUP BY ALL)
SELECT vec_id, CAST(k AS VARCHAR) AS topic, {r('sqrt(d)')} AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), CAST(k AS VARCHAR)) AS rn FROM d) WHERE rn = 1""")
def nearest_centroid(spark, folder):
    rows = vectors(spark, folder)
    centers = embedding.mean_vectors(rows, ["label"]).withColumnRenamed("label", "topic")
    return clusters.nearest_centroid(rows, centers, "vec_id", "topic", "centroid")


@query("nearest_neighbour", f"WITH {SIMS} SELECT vec_id, other AS neighbour, {r('s')} AS similarity FROM near WHERE rn = 1")
def nearest_neighbour(spark, folder):
    return neighbours.nearest_neighbour(vectors(spark, folder), "vec_id")


@query("top_neighbours", f"WITH {SIMS} SELECT vec_id AS query_id, other AS neighbour_id, {r('s')} AS similarity, CAST(rn AS INTEGER) AS rank FROM near WHERE rn <= 5")
def top_neighbours(spark, folder):
    rows = vectors(spark, folder)
    return neighbours.nearest(rows, rows, 5, "vec_id", "vec_id", exclude_same_id=True)


def knn_sql(k: int) -> str:
    return f"""WITH {VECTORS}, sp AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id)
  <= round(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS test FROM embeddings),
sims AS (SELECT a.vec_id, b.vec_id AS other, b.label, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM vecs a JOIN sp x ON x.vec_id = a.vec_id AND x.test
  JOIN vecs b ON true JOIN sp y ON y.vec_id = b.vec_id AND NOT y.test),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS rn FROM sims),
votes AS (SELECT vec_id, label, count(*) AS n FROM near WHERE rn <= {k} GROUP BY ALL)
SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS rn FROM votes) WHERE rn = 1"""


def _knn(spark, folder, k, **kw):
    rows = stratified_split(vectors(spark, folder), "label", "vec_id")
    return neighbours.knn_classify(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "vec_id", "label", k, **kw)


@query("knn_5", knn_sql(5))
def knn_5(spark, folder):
    return _knn(spark, folder, 5)


@query("knn_10", knn_sql(10))
def knn_10(spark, folder):
    return _knn(spark, folder, 10)


@query("knn_cross_validation", f"""WITH {VECTORS}, f AS (SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) - 1) % 5 AS INTEGER) AS fold
  FROM embeddings),
sims AS (SELECT a.vec_id, x.fold, a.label AS own, b.vec_id AS other, b.label, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM vecs a JOIN f x ON x.vec_id = a.vec_id
  JOIN vecs b ON true JOIN f y ON y.vec_id = b.vec_id AND y.fold <> x.fold),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS rn FROM sims),
votes AS (SELECT vec_id, fold, own, label, count(*) AS n FROM near WHERE rn <= 5 GROUP BY ALL),
preds AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS rn FROM votes)
SELECT fold, {r('avg(CAST(label = own AS DOUBLE))')} AS accuracy FROM preds WHERE rn = 1 GROUP BY fold""")
def knn_cross_validation(spark, folder):
    return neighbours.knn_cross_validate(vectors(spark, folder), "vec_id", "label")


@query("knn_weighted", knn_sql(10).replace("count(*) AS n FROM near", "sum(1 / greatest(1 - s, 1e-12)) AS n FROM near"))
def knn_weighted(spark, folder):
    return _knn(spark, folder, 10, weights="distance")


@query("retrieval_recall", f"""WITH {CORPUS}, {hashed_sql('corpus', 'doc_id', 'title', 'th')}, {hashed_sql('corpus', 'doc_id', 'text', 'bh')},
a AS (SELECT doc_id, [coalesce(x, 0) FOR x IN array_agg(x ORDER BY pos)] AS v FROM (
  SELECT d.doc_id, p.pos, h.x FROM corpus d CROSS JOIN range({DIMS}) p(pos) LEFT JOIN th h ON h.doc_id = d.doc_id AND h.pos = p.pos) GROUP BY doc_id),
b AS (SELECT doc_id, [coalesce(x, 0) FOR x IN array_agg(x ORDER BY pos)] AS v FROM (
  SELECT d.doc_id, p.pos, h.x FROM corpus d CROSS JOIN range({DIMS}) p(pos) LEFT JOIN bh h ON h.doc_id = d.doc_id AND h.pos = p.pos) GROUP BY doc_id),
sims AS (SELECT a.doc_id, b.doc_id AS other, round(list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 1e-300), 9) AS s FROM a, b),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, other) AS rn FROM sims),
own AS (SELECT doc_id, rn FROM near WHERE doc_id = other)
SELECT CAST(k AS INTEGER) AS k, {r('avg(CAST(rn <= k AS DOUBLE))')} AS recall FROM own, unnest([1, 3, 5]) AS t(k) GROUP BY k""")
def retrieval_recall(spark, folder):
    encoder = embedding.HashedTerms(DIMS)
    rows = corpus(spark, folder).select("doc_id", "title", "text")
    rows = embedding.embed(embedding.embed(rows, encoder, "title", "title_vec"), encoder, "text", "text_vec").select("doc_id", "title_vec", "text_vec")
    rows = settle(rows)
    return neighbours.retrieval_recall(rows, rows, "doc_id", "title_vec", "text_vec")


@query("masked_recall", "SELECT CAST(k AS INTEGER) AS k, CAST(0 AS DOUBLE) AS recall FROM unnest([1, 3, 5]) AS t(k), (SELECT count(*) AS n FROM documents) WHERE n > 5")
def masked_recall(spark, folder):
    return neighbours.masked_self_recall(documents(spark, folder).select("doc_id"))


@query("neighbour_agreement", f"""WITH {SIMS}, p AS (SELECT vec_id, avg(CAST(label = other_label AS DOUBLE)) AS s FROM near WHERE rn <= 5 GROUP BY vec_id)
SELECT {r('avg(s)')} AS agreement FROM p""")
def neighbour_agreement(spark, folder):
    return neighbours.label_agreement(vectors(spark, folder), "vec_id", "label", 5)


def silhouette_sql(distance: str) -> str:
    return f"""WITH {VECTORS}, d AS (SELECT a.vec_id, a.label, b.label AS other, {distance} AS d FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, label, other, avg(d) AS d FROM d GROUP BY ALL),
s AS (SELECT vec_id, max(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM m GROUP BY vec_id)
SELECT {r('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM s"""


@query("silhouette_cosine", silhouette_sql("1 - list_cosine_similarity(a.v, b.v)"))
def silhouette_cosine(spark, folder):
    return clusters.silhouette(vectors(spark, folder), "vec_id", "label")


@query("silhouette_squared", silhouette_sql("list_distance(a.v, b.v) ** 2"))
def silhouette_squared(spark, folder):
    return clusters.silhouette(vectors(spark, folder), "vec_id", "label", metric="sqeuclidean")


@query("silhouette_euclidean", silhouette_sql("list_distance(a.v, b.v)"))
def silhouette_euclidean(spark, folder):
    return clusters.silhouette(vectors(spark, folder), "vec_id", "label", metric="euclidean")


@query("davies_bouldin", f"""WITH {VECTOR_PARTS}, cent AS (SELECT label, pos, avg(x) AS c FROM parts GROUP BY ALL),
g AS (SELECT vec_id, label, sqrt(sum((x - c) ** 2)) AS d FROM parts JOIN cent USING (label, pos) GROUP BY ALL),
s AS (SELECT label, avg(d) AS s FROM g GROUP BY label),
m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) ** 2)) AS d FROM cent a JOIN cent b ON a.pos = b.pos AND a.label <> b.label GROUP BY ALL),
w AS (SELECT i, max((x.s + y.s) / d) AS r FROM m JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY i)
SELECT {r('avg(r)')} AS davies_bouldin FROM w""")
def davies_bouldin(spark, folder):
    return clusters.davies_bouldin(vectors(spark, folder), "label")


@query("calinski_harabasz", f"""WITH {VECTOR_PARTS}, c AS (SELECT label, pos, avg(x) AS c, count(*) AS n FROM parts GROUP BY ALL), m AS (SELECT pos, avg(x) AS m FROM parts GROUP BY pos),
b AS (SELECT sum(n * (c - m) ** 2) AS b FROM c JOIN m USING (pos)), w AS (SELECT sum((x - c) ** 2) AS w FROM parts JOIN c USING (label, pos)),
k AS (SELECT count(DISTINCT label) AS k, count(DISTINCT vec_id) AS n FROM vecs)
SELECT {r('(b / (k - 1)) / (w / (n - k))')} AS calinski_harabasz FROM b, w, k""")
def calinski_harabasz(spark, folder):
    return clusters.calinski_harabasz(vectors(spark, folder), "label")


@query("label_scores", f"""WITH {STORED}, t AS (SELECT label, lang, count(*) AS n FROM stored WHERE label IS NOT NULL GROUP BY ALL), a AS (SELECT label, sum(n) AS a, max(n) AS top FROM t GROUP BY label),
b AS (SELECT lang, sum(n) AS b FROM t GROUP BY lang), z AS (SELECT sum(n)::DOUBLE AS n FROM t),
q AS (SELECT (SELECT sum(t.n * (t.n - 1) / 2) FROM t) AS c2, (SELECT sum(a * (a - 1) / 2) FROM a) AS r2, (SELECT sum(b * (b - 1) / 2) FROM b) AS l2,
  (SELECT sum(t.n / z.n * ln(z.n * t.n / (a * b))) FROM t JOIN a USING (label) JOIN b USING (lang), z) AS mi,
  (SELECT -sum(a / z.n * ln(a / z.n)) FROM a, z) AS h1, (SELECT -sum(b / z.n * ln(b / z.n)) FROM b, z) AS h2,
  (SELECT sum(top) FROM a) / z.n AS purity, z.n * (z.n - 1) / 2 AS pairs FROM z)
SELECT {r('(c2 - r2 * l2 / pairs) / ((r2 + l2) / 2 - r2 * l2 / pairs)')} AS ari, {r('mi / ((h1 + h2) / 2)')} AS nmi, {r('purity')} AS purity,
  {r('(mi / ((h1 + h2) / 2) + purity) / 2')} AS score FROM q""")
def label_scores(spark, folder):
    return clusters.label_agreement_scores(stored(spark, folder).where("label IS NOT NULL"), "label", "lang")


@query("embedding_score", silhouette_sql("1 - list_cosine_similarity(a.v, b.v)").replace("AS silhouette FROM s", "AS score FROM s").replace(
    "SELECT round(CAST(avg(", "SELECT round(CAST(0.5 + 0.5 * avg("))
def embedding_score(spark, folder):
    return clusters.embedding_score(clusters.silhouette(vectors(spark, folder), "vec_id", "label"))


@query("source_quality", f"""WITH {EMBEDDED}, d AS (SELECT a.doc_id, a.source, b.source AS other, 1 - coalesce(nullif(list_cosine_similarity(a.v, b.v), CAST('nan' AS DOUBLE)), 0) AS d FROM embedded a JOIN embedded b ON a.doc_id <> b.doc_id),
m AS (SELECT doc_id, source, other, avg(d) AS d FROM d GROUP BY ALL),
s AS (SELECT doc_id, max(d) FILTER (other = source) AS a, min(d) FILTER (other <> source) AS b FROM m GROUP BY doc_id)
SELECT {r('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM s""")
def source_quality(spark, folder):
    return clusters.silhouette(embedded(spark, folder), "doc_id", "source")
