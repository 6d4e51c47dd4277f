"""Granger-style influence."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.base import EMBEDDED, EVENT_SERIES, LANG_MATRIX, embedded, event_matrix, lang_matrix, query, r
from driftline.catalog.series import t_two_sided
from driftline.functions.stats import f_tail
from driftline.operators import causal

GUARD = """g AS (SELECT count(DISTINCT source) AS sources, count(DISTINCT time_bin) AS bins FROM matrix),
guard AS (SELECT *, least(4, greatest(1, (bins - 1) // 3)) AS lags FROM g)"""


@query("causal_guard", f"""WITH {LANG_MATRIX}, {GUARD} SELECT sources, bins, CAST(lags AS INTEGER) AS lags, CAST(bins - lags - sources * lags AS BIGINT) AS df,
  CASE WHEN sources < 2 THEN 'one_source' WHEN bins < 10 THEN 'too_few_bins' WHEN bins - lags - sources * lags <= 0 THEN 'too_many_sources' ELSE 'tested' END AS status FROM guard""")
def causal_guard(spark, folder):
    return causal.causal_guard(lang_matrix(spark, folder))


@query("source_pairs", """WITH s AS (SELECT DISTINCT source FROM documents)
SELECT a.source AS cause, b.source AS effect FROM s a JOIN s b ON a.source <> b.source""")
def source_pairs(spark, folder):
    return causal.ordered_pairs(spark.read.parquet(f"{folder}/documents.parquet").select("source"))


@query("lag_design", f"""WITH {LANG_MATRIX}, d AS (SELECT time_bin, source, value, lag(value, 1) OVER w AS lag1, lag(value, 2) OVER w AS lag2,
  lag(value, 3) OVER w AS lag3, lag(value, 4) OVER w AS lag4 FROM matrix WINDOW w AS (PARTITION BY source ORDER BY time_bin))
SELECT time_bin, source, {', '.join(r(c) + ' AS ' + c for c in ('value', 'lag1', 'lag2', 'lag3', 'lag4'))} FROM d WHERE lag4 IS NOT NULL""")
def lag_design(spark, folder):
    return causal.lag_design(lang_matrix(spark, folder), 4)


@query("granger_joint")
def granger_joint(spark, folder):
    return causal.granger_summary(causal.granger_joint(lang_matrix(spark, folder)))


@query("granger_events")
def granger_events(spark, folder):
    return causal.granger_summary(causal.granger_joint(event_matrix(spark, folder)))


def _halves(spark, folder):
    """Two series over all documents: languages before and from 'es' on."""
    from driftline.operators.trajectory import source_matrix

    rows = embedded(spark, folder).withColumn("half", F.when(F.col("lang") < "es", "a").otherwise("b"))
    return source_matrix(rows, "half").withColumnRenamed("half", "source")


# Normal equations of the joint model with two series and one lag: columns and rows in order a, b.
HALVES = EMBEDDED + """,
obs AS (SELECT time_bin, CASE WHEN lang < 'es' THEN 'a' ELSE 'b' END AS source, sum(x) / count(*) AS value FROM parts GROUP BY ALL),
bins AS (SELECT b.time_bin, oa.value AS a0, ob.value AS b0 FROM (SELECT DISTINCT time_bin FROM obs) b
  LEFT JOIN obs oa ON oa.time_bin = b.time_bin AND oa.source = 'a' LEFT JOIN obs ob ON ob.time_bin = b.time_bin AND ob.source = 'b'),
wide AS (SELECT time_bin, coalesce(last_value(a0 IGNORE NULLS) OVER p, first_value(a0 IGNORE NULLS) OVER f) AS a, coalesce(last_value(b0 IGNORE NULLS) OVER p, first_value(b0 IGNORE NULLS) OVER f) AS b
  FROM bins WINDOW p AS (ORDER BY time_bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY time_bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lagged AS (SELECT a, b, lag(a) OVER (ORDER BY time_bin) AS x, lag(b) OVER (ORDER BY time_bin) AS y FROM wide),
sums AS (SELECT count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, sum(x * a) AS xa, sum(y * a) AS ya, sum(x * b) AS xb, sum(y * b) AS yb, sum(a * a) AS aa, sum(b * b) AS bb
  FROM lagged WHERE x IS NOT NULL),
fits AS (SELECT *, (yy * xa - xy * ya) / (xx * yy - xy * xy) AS a_x, (xx * ya - xy * xa) / (xx * yy - xy * xy) AS a_y,
  (yy * xb - xy * yb) / (xx * yy - xy * xy) AS b_x, (xx * yb - xy * xb) / (xx * yy - xy * xy) AS b_y FROM sums)"""


@query("granger_joint_two", f"""WITH {HALVES},
tests AS (SELECT 'b' AS cause, 'a' AS effect, n, a_y * a_y * (xx * yy - xy * xy) / xx / ((aa - a_x * xa - a_y * ya) / (n - 2)) AS f FROM fits
  UNION ALL SELECT 'a', 'b', n, b_x * b_x * (xx * yy - xy * xy) / yy / ((bb - b_x * xb - b_y * yb) / (n - 2)) FROM fits),
pv AS (SELECT *, {t_two_sided('sqrt(f)', '(2 * n - 4)')} AS p FROM tests)
SELECT cause, effect, {r('p')} AS p_value, {r('f')} AS f_statistic, CAST(1 AS INTEGER) AS lags, 'tested' AS status FROM pv""")
def granger_joint_two(spark, folder):
    return causal.granger_joint(_halves(spark, folder), lags=1)


@query("impulse_response_two", f"""WITH RECURSIVE {HALVES},
steps AS (SELECT 0 AS step, 1.0::DOUBLE AS aa, 0.0::DOUBLE AS ab, 0.0::DOUBLE AS ba, 1.0::DOUBLE AS bb
  UNION ALL SELECT step + 1, a_x * s.aa + a_y * s.ab, b_x * s.aa + b_y * s.ab, a_x * s.ba + a_y * s.bb, b_x * s.ba + b_y * s.bb FROM steps s, fits WHERE step < 10)
SELECT cause, effect, CAST(step AS INTEGER) AS step, {r('v')} AS response, 'tested' AS status FROM (
  SELECT 'a' AS cause, 'a' AS effect, step, aa AS v FROM steps UNION ALL SELECT 'a', 'b', step, ab FROM steps
  UNION ALL SELECT 'b', 'a', step, ba FROM steps UNION ALL SELECT 'b', 'b', step, bb FROM steps)""")
def impulse_response_two(spark, folder):
    return causal.impulse_response(_halves(spark, folder), 10, lags=1)


def _source_matrices(spark, folder):
    """One corpus per document source, its series being the languages."""
    from driftline.operators.trajectory import source_matrix

    rows = embedded(spark, folder).withColumnRenamed("source", "corpus")
    return source_matrix(rows, "lang", keys=["corpus"]).withColumnRenamed("lang", "source")


@query("granger_by_source")
def granger_by_source(spark, folder):
    return causal.granger_summary(causal.granger_joint(_source_matrices(spark, folder), ["corpus"]))


BY_SOURCE = EMBEDDED + """,
obs AS (SELECT source AS corpus, time_bin, lang AS source, sum(x) / count(*) AS value FROM parts GROUP BY ALL),
grid AS (SELECT b.corpus, b.time_bin, s.source, o.value FROM (SELECT DISTINCT corpus, time_bin FROM obs) b JOIN (SELECT DISTINCT corpus, source FROM obs) s ON s.corpus = b.corpus
  LEFT JOIN obs o ON o.corpus = b.corpus AND o.time_bin = b.time_bin AND o.source = s.source),
matrix AS (SELECT corpus, time_bin, source, coalesce(
    last_value(value IGNORE NULLS) OVER (PARTITION BY corpus, source ORDER BY time_bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(value IGNORE NULLS) OVER (PARTITION BY corpus, source ORDER BY time_bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM grid)"""


@query("source_guards", f"""WITH {BY_SOURCE}, g AS (SELECT corpus, count(DISTINCT source) AS sources, count(DISTINCT time_bin) AS bins FROM matrix GROUP BY corpus),
guard AS (SELECT *, least(4, greatest(1, (bins - 1) // 3)) AS lags FROM g)
SELECT corpus, sources, bins, CAST(lags AS INTEGER) AS lags, CAST(bins - lags - sources * lags AS BIGINT) AS df,
  CASE WHEN sources < 2 THEN 'one_source' WHEN bins < 10 THEN 'too_few_bins' WHEN bins - lags - sources * lags <= 0 THEN 'too_many_sources' ELSE 'tested' END AS status FROM guard""")
def source_guards(spark, folder):
    return causal.causal_guard(_source_matrices(spark, folder), ["corpus"])


@query("granger_lag1_by_source", f"""WITH {BY_SOURCE},
lagged AS (SELECT corpus, time_bin, source, value, lag(value) OVER (PARTITION BY corpus, source ORDER BY time_bin) AS l FROM matrix),
sums AS (SELECT y.corpus, x.source AS cause, y.source AS effect, count(*) AS n, sum(y.value * y.value) AS yy, sum(y.l * y.l) AS aa, sum(y.value * y.l) AS ya,
  sum(x.l * x.l) AS xx, sum(y.value * x.l) AS yx, sum(y.l * x.l) AS ax
  FROM lagged y JOIN lagged x ON x.corpus = y.corpus AND x.time_bin = y.time_bin AND x.source <> y.source WHERE y.l IS NOT NULL AND x.l IS NOT NULL GROUP BY ALL),
fits AS (SELECT *, yy - ya * ya / aa AS rss, yy - (ya * xx - yx * ax) / (aa * xx - ax * ax) * ya - (yx * aa - ya * ax) / (aa * xx - ax * ax) * yx AS uss FROM sums)
SELECT corpus, cause, effect, CAST(n AS INTEGER) AS n, {r('(rss - uss) / (uss / (n - 2))')} AS f_statistic FROM fits""")
def granger_lag1_by_source(spark, folder):
    return causal.granger_lag1(_source_matrices(spark, folder), ["corpus"])


@query("granger_pairwise")
def granger_pairwise(spark, folder):
    return causal.granger_summary(causal.granger_pairwise(event_matrix(spark, folder), 5))


def _lag1(matrix: str) -> str:
    return f"""lagged AS (SELECT time_bin, source, value, lag(value) OVER (PARTITION BY source ORDER BY time_bin) AS l FROM {matrix}),
sums AS (SELECT x.source AS cause, y.source AS effect, count(*) AS n, sum(y.value * y.value) AS yy, sum(y.l * y.l) AS aa, sum(y.value * y.l) AS ya,
  sum(x.l * x.l) AS xx, sum(y.value * x.l) AS yx, sum(y.l * x.l) AS ax
  FROM lagged y JOIN lagged x ON x.time_bin = y.time_bin AND x.source <> y.source WHERE y.l IS NOT NULL AND x.l IS NOT NULL GROUP BY ALL),
fits AS (SELECT *, yy - ya * ya / aa AS rss, yy - (ya * xx - yx * ax) / (aa * xx - ax * ax) * ya - (yx * aa - ya * ax) / (aa * xx - ax * ax) * yx AS uss FROM sums),
tests AS (SELECT cause, effect, n, (rss - uss) / (uss / (n - 2)) AS f FROM fits)"""


LAG1 = LANG_MATRIX + ",\n" + _lag1("matrix")
EVENT_LAG1 = EVENT_SERIES + ",\nmatrix AS (SELECT time_bin, series AS source, value FROM event_series),\n" + _lag1("matrix")


@query("granger_lag1", f"WITH {LAG1} SELECT cause, effect, CAST(n AS INTEGER) AS n, {r('f')} AS f_statistic FROM tests")
def granger_lag1(spark, folder):
    return causal.granger_lag1(lang_matrix(spark, folder))


def _lag1_edges(matrix):
    rows = causal.granger_lag1(matrix)
    return rows.withColumn("p_value", f_tail("f_statistic", F.lit(1.0), (F.col("n") - 2).cast("double"))).drop("n")


EDGES = f"pv AS (SELECT cause, effect, f, greatest(0, least(1, {t_two_sided('sqrt(f)', '(n - 2)')})) AS p FROM tests)"


@query("granger_summary", f"""WITH {LAG1}, {EDGES} SELECT cause, effect, {r('p')} AS p_value, {r('greatest(f, 0)')} AS f_statistic,
  CASE WHEN p < 0.1 THEN 'Yes' ELSE 'No' END AS significant, {r('(1 - p) * 100')} AS confidence FROM pv""")
def granger_summary(spark, folder):
    return causal.granger_summary(_lag1_edges(lang_matrix(spark, folder)))


@query("causal_edges", f"""WITH {EVENT_LAG1}, {EDGES} SELECT cause, effect, {r('p')} AS p_value, {r('1 - p')} AS weight FROM pv WHERE p < 0.4 AND 1 - p >= 0.1""")
def causal_edges(spark, folder):
    rows = causal.granger_summary(_lag1_edges(event_matrix(spark, folder)))
    return causal.causal_edges(rows, 0.4, 0.1).select("cause", "effect", "p_value", "weight")


@query("strongest_edges", f"WITH {EVENT_LAG1}, {EDGES} SELECT cause, effect, {r('p')} AS p_value FROM pv ORDER BY p, cause, effect LIMIT 5")
def strongest_edges(spark, folder):
    rows = causal.granger_summary(_lag1_edges(event_matrix(spark, folder)))
    return causal.strongest_edges(rows, 5).select("cause", "effect", "p_value")


@query("matrix_summary", f"""WITH {EVENT_LAG1}, {EDGES}, cells AS (SELECT p, f FROM pv UNION ALL SELECT 0, 0 FROM (SELECT DISTINCT effect FROM pv))
SELECT {r('min(p)')} AS min_p, {r('avg(p)')} AS mean_p, {r('max(p)')} AS max_p, {r('max(f)')} AS max_f FROM cells""")
def matrix_summary(spark, folder):
    return causal.matrix_summary(causal.granger_summary(_lag1_edges(event_matrix(spark, folder))))


@query("causal_confidence", """WITH b AS (SELECT source, count(DISTINCT doc_id % 96) AS bins FROM documents GROUP BY source)
SELECT source, bins, CAST(least(0.9, greatest(0.1, bins / 50)) AS DOUBLE) AS confidence,
  CAST(CASE WHEN bins < 5 THEN 0.1 WHEN bins < 10 THEN 0.3 WHEN bins < 20 THEN 0.6 ELSE 0.85 END AS DOUBLE) AS stepped_confidence FROM b""")
def causal_confidence(spark, folder):
    from driftline.catalog.base import corpus

    cells = corpus(spark, folder).groupBy("source", "time_bin").agg(F.count(F.lit(1)).alias("n"))
    return causal.causal_confidence(cells.groupBy("source").agg(F.count(F.lit(1)).alias("bins")))


@query("impulse_response")
def impulse_response(spark, folder):
    return causal.impulse_response(lang_matrix(spark, folder), 10)


@query("lag_order")
def lag_order(spark, folder):
    return causal.lag_order(lang_matrix(spark, folder), 4)
