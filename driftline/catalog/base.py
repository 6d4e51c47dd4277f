"""Query registry and the views the registered queries run on, in DataFrame and in SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from driftline.functions.text import tokens
from driftline.operators.corpus import spread_over_bins, time_bins
from driftline.operators.embedding import HashedTerms, embed
from driftline.session import spread
from driftline.sources.labelled import attach_vectors, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PLACES = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of summation does not show."""
    return df.select(*[
        (F.round(f.name, PLACES) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema
    ])


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def r(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {PLACES}) + 0.0"


CONCEPTS = ["that", "tion", "thble", "from", "zzzz"]
CONCEPTS_SQL = "concepts AS (SELECT unnest(['that', 'tion', 'thble', 'from', 'zzzz']) AS concept)"

# Marker words per language, used as a transparent category model.
MARKERS = {
    "de": ["der", "die", "und", "das", "ein", "ich"],
    "en": ["the", "of", "and", "to", "that", "is"],
    "es": ["el", "los", "que", "las", "por", "una"],
    "fr": ["le", "la", "les", "de", "des", "et"],
}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with dates spread over 96 weeks and the first line as title."""
    return spread_over_bins(documents(spark, folder).withColumn("title", F.split("text", "\n")[0]), "doc_id", "W", 24)


CORPUS = """corpus AS (
  SELECT doc_id, text, lang, source, split_part(text, chr(10), 1) AS title,
         TIMESTAMP '2022-01-01' + to_days(CAST(doc_id % 96 * 7 AS INTEGER)) AS published,
         CAST(date_trunc('week', TIMESTAMP '2022-01-01' + to_days(CAST(doc_id % 96 * 7 AS INTEGER))) AS TIMESTAMP) AS time_bin
  FROM documents)"""


DIMS = 64


def hashed_sql(table: str = "documents", key: str = "doc_id", text: str = "text", out: str = "hashed") -> str:
    return f"""{out}_tok AS (SELECT {key}, md5(unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))) AS h FROM {table}),
{out}_raw AS (SELECT {key}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {DIMS} AS pos, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS s
  FROM {out}_tok GROUP BY ALL),
{out} AS (SELECT {key}, pos, CAST(CAST(s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS x FROM {out}_raw WHERE s <> 0)"""


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    """The whole corpus with one encoder's vectors (hashed terms)."""
    return embed(corpus(spark, folder), HashedTerms(DIMS))


EMBEDDED = CORPUS + f""", {hashed_sql('corpus', 'doc_id', 'text', 'hv')},
dense AS (SELECT c.doc_id, p.pos, coalesce(hv.x, 0) AS x FROM corpus c CROSS JOIN (SELECT unnest(range({DIMS})) AS pos) p
  LEFT JOIN hv ON hv.doc_id = c.doc_id AND hv.pos = p.pos),
embedded AS (SELECT c.*, e.v FROM corpus c JOIN (SELECT doc_id, list(x ORDER BY pos) AS v FROM dense GROUP BY doc_id) e USING (doc_id)),
parts AS (SELECT c.doc_id, time_bin, lang, source, text, pos + 1 AS pos, x FROM corpus c JOIN dense USING (doc_id))"""


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with its stored vectors and labels; null where a document has none."""
    return attach_vectors(corpus(spark, folder), read_table(spark, folder, "embeddings"), "doc_id", "vec_id")


STORED = CORPUS + """,
stored AS (SELECT c.*, e.label, CAST(e.embedding AS DOUBLE[]) AS v FROM corpus c LEFT JOIN embeddings e ON c.doc_id = e.vec_id)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings")


VECTORS = """vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
VECTOR_PARTS = VECTORS + """,
parts AS (SELECT vec_id, label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM vecs)"""


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """Mean event value per day and type."""
    rows = time_bins(read_table(spark, folder, "events"), "D", "ts")
    return rows.groupBy(F.col("event_type").alias("series"), "time_bin").agg(F.avg("value").alias("value"))


EVENT_SERIES = """event_series AS (
  SELECT event_type AS series, CAST(date_trunc('day', ts) AS TIMESTAMP) AS time_bin, avg(value) AS value
  FROM events GROUP BY ALL)"""


def sales_series(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per week and priority, in millions."""
    rows = time_bins(read_table(spark, folder, "orders"), "W", "o_orderdate")
    return rows.groupBy(F.col("o_orderpriority").alias("series"), "time_bin").agg((F.sum("o_totalprice") / 1e6).alias("value"))


SALES_SERIES = """sales_series AS (
  SELECT o_orderpriority AS series, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS time_bin, sum(o_totalprice) / 1e6 AS value
  FROM orders GROUP BY ALL)"""

INDEXED = """indexed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time_bin) - 1 AS x,
  count(*) OVER (PARTITION BY series) AS n FROM {series})"""


def lang_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly component means of the vectors per language, dense and filled."""
    from driftline.operators.trajectory import source_matrix

    return source_matrix(embedded(spark, folder), "lang").withColumnRenamed("lang", "source")


LANG_MATRIX = EMBEDDED + """,
obs AS (SELECT time_bin, lang AS source, sum(x) / count(*) AS value FROM parts GROUP BY ALL),
grid AS (SELECT b.time_bin, s.source, o.value FROM (SELECT DISTINCT time_bin FROM obs) b CROSS JOIN (SELECT DISTINCT source FROM obs) s
  LEFT JOIN obs o ON o.time_bin = b.time_bin AND o.source = s.source),
matrix AS (SELECT time_bin, source, coalesce(
    last_value(value IGNORE NULLS) OVER (PARTITION BY source ORDER BY time_bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(value IGNORE NULLS) OVER (PARTITION BY source ORDER BY time_bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
  FROM grid)"""


def event_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return event_series(spark, folder).withColumnRenamed("series", "source")


def marker_probs(spark: SparkSession, folder: str, text: str = "text") -> DataFrame:
    """(doc_id, time_bin, lang, category, prob): smoothed shares of each language's marker words in the whole text."""
    rows = corpus(spark, folder).withColumn("toks", tokens(text))

    def hits(words: list[str]) -> Column:
        return F.size(F.filter("toks", lambda t: t.isin(words))) + 1

    rows = rows.select("doc_id", "time_bin", "lang", *[hits(w).alias(c) for c, w in MARKERS.items()])
    total = sum((F.col(c) for c in MARKERS), F.lit(0))
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), (F.col(c) / total).alias("prob")) for c in MARKERS])
    return rows.select("doc_id", "time_bin", "lang", F.inline(pairs))


def _marker_sql() -> str:
    def hits(c: str) -> str:
        words = ", ".join(f"'{w}'" for w in MARKERS[c])
        return f"len(list_filter(toks, lambda t: t IN ({words}))) + 1 AS {c}"

    one = " + ".join(MARKERS)
    rows = " UNION ALL ".join(
        f"SELECT doc_id, time_bin, lang, '{c}' AS category, CAST({c} AS DOUBLE) / ({one}) AS prob FROM hits" for c in MARKERS)
    return CORPUS + f""",
toks AS (SELECT doc_id, time_bin, lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks FROM corpus),
hits AS (SELECT doc_id, time_bin, lang, {', '.join(hits(c) for c in MARKERS)} FROM toks),
probs AS ({rows})"""


PROBS = _marker_sql()


def marker_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, prediction) from the marker model."""
    pick = F.struct((-F.round("prob", 9)).alias("p"), "category")
    best = marker_probs(spark, folder).groupBy("doc_id").agg(F.first("lang").alias("label"), F.min(pick).alias("b"))
    return best.select("doc_id", "label", F.col("b.category").alias("prediction"))


PREDICTIONS = PROBS + """,
preds AS (SELECT doc_id, lang AS label, category AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(prob, 9) DESC, category) AS rn FROM probs) WHERE rn = 1)"""
