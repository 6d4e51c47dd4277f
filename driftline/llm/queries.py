"""Registered queries of the training-data operators with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, conversations, decontaminate, jaccard, langid, mixing, negatives, pages, privacy, quality, repeats, urls, vectors
from driftline.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows a classifier may not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


REACH = """, both_ways AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
reach AS (SELECT {id} AS id, {id} AS r FROM {rows} UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

JACCARD_SQL = """WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k))
""" + REACH.format(id="doc_id", rows="documents") + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp c ON c.id = d.doc_id"""


@query("op10_jaccard_join", JACCARD_SQL)
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    out = jaccard.near_duplicates(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


REPEATS_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM b)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
marked AS (SELECT doc_id, p, coalesce(lag(p) OVER o + 100 < p, true) AS new FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (
  SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM marked) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER o, 0) AS from_byte, lead(s) OVER o IS NULL AS is_last FROM runs WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
kept AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * from_byte + 1, 2 * (s - from_byte)) || CASE WHEN is_last THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS rest
  FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM b LEFT JOIN kept USING (doc_id)"""


@query("op6_repeats", REPEATS_SQL)
def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


MIXING_SQL = """WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
t AS (SELECT *, row_number() OVER o AS j,
    CAST(sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size) AS DOUBLE) / (sum(w) OVER () - sum(w) OVER o + w) AS level
  FROM r WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT level FROM t WHERE 3 * source_size >= w * level ORDER BY j LIMIT 1),
p AS (SELECT source, source_size, least(w * l.level, CAST(3 * source_size AS DOUBLE)) AS target,
    CASE WHEN source_size > 0 THEN least(3, floor(least(w * l.level, CAST(3 * source_size AS DOUBLE)) / source_size)) ELSE 0 END AS passes FROM t, l),
c AS (SELECT d.*, source_size, target, passes, target - passes * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it,
    sum(size) OVER (PARTITION BY d.source, h) AS same FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
cut AS (SELECT source, min(CASE WHEN (budget - before_it) * 2 > same THEN h + 1 ELSE h END) AS cut FROM (
  SELECT *, min(h) OVER (PARTITION BY source) AS first_h FROM c WHERE before_it + same > budget) WHERE h = first_h GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * least(3, passes + CASE WHEN h < cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c LEFT JOIN cut ON c.source IS NOT DISTINCT FROM cut.source"""


@query("op3_mixing", MIXING_SQL)
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def fitted_languages(spark: SparkSession, folder: str):
    """Piece probabilities from the documents that are not held out."""
    return langid.fit(table(spark, folder, "documents").where(~held_out()).select("text", "lang"))


@query("op8_language")
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return langid.predict(docs, fitted_languages(spark, folder)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "item_words", "distance", "start", "words")


VECTORS_SQL = """WITH RECURSIVE sound AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
ends AS (SELECT a AS id FROM links UNION ALL SELECT b FROM links),
n AS (SELECT id, count(*) AS n FROM ends GROUP BY id)
""" + REACH.format(id="vec_id", rows="embeddings") + """
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.id = e.vec_id JOIN comp c ON c.id = e.vec_id"""


@query("op9_vectors", VECTORS_SQL)
def op9_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op7_privacy")
def op7_privacy(spark: SparkSession, folder: str) -> DataFrame:
    rows = privacy.annotate(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "spans")
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    text = lambda kinds: F.concat_ws(",", *[privacy.listed(of(k), k) for k in kinds])
    return rows.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in privacy.KINDS], F.sha2(text(privacy.KINDS), 256).alias("base_sha256"),
        text((*privacy.KINDS, "term")).alias("spans"), F.size(of("term")).cast("long").alias("n_term"))


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(quality.features(table(spark, folder, "documents")))
    labels = table(spark, folder, "labels").where(~held_out()).select("doc_id", "quality")
    scored = quality.score(rows, quality.fit(rows, labels))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_main_text")
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract(table(spark, folder, "pages").select("page_id", "url", "html"), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


@query("op1_urls")
def op1_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of all pages; the rules are mined from the urls that the fixed rules decide, with their verdicts as labels."""
    rows = table(spark, folder, "pages").select("page_id", "url")
    mined = urls.mine(labelled_urls(rows))
    return urls.judge(rows, URL_RULES, mined).select("page_id", "host", "path", "rule", "verdict")


def labelled_urls(rows: DataFrame) -> DataFrame:
    """(url, block) of the urls that a fixed rule decides."""
    verdict = urls.fixed_rule(URL_RULES, F.col("host"), F.col("path"))[1]
    known = rows.select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    return known.select("url", (verdict == "block").alias("block")).where("block is not null")


@query("op13_bpe")
def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text and the bytes they decode to, as digests."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


CONVERSATIONS_SQL = """WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations),
how AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) % 20 AS how FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS again FROM how WHERE how <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM hurt),
marked AS (SELECT conv_id, i, turn, role, text, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    CASE WHEN i > 1 THEN lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) END AS two,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS c FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
ways AS (
  SELECT conv_id, n + 1 AS i, [{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}] AS f FROM counts
  UNION ALL
  SELECT conv_id, i, [least(g[1], {'c': 3 + h2.c, 'a': 'I' || h2.a}), least(g[2], {'c': 3 + h2.c, 'a': 'I' || h2.a}), h2, h3] AS f FROM (
    SELECT conv_id, i, g, least(g[3], {'c': 3 + g[4].c, 'a': 'I' || g[4].a}) AS h2, least(g[4], {'c': 3 + g[3].c, 'a': 'I' || g[3].a}) AS h3 FROM (
      SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda q: least(
          {'c': 4 + f[q].c, 'a': 'D' || f[q].a},
          CASE WHEN go THEN {'c': 99999999, 'a': ''} ELSE {'c': 3 + more + f[CASE q WHEN 3 THEN 4 ELSE 3 END].c, 'a': 'R' || f[CASE q WHEN 3 THEN 4 ELSE 3 END].a} END,
          CASE WHEN go OR k[q] = 0 THEN {'c': 99999999, 'a': ''} ELSE {'c': more + f[k[q]].c, 'a': 'K' || f[k[q]].a} END)) AS g FROM (
        SELECT m.conv_id, m.i, w.f, m.fault IN ('b', 'd') AS go, CASE WHEN m.fault = 't' THEN 3 ELSE 0 END AS more,
          CASE m.c WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS k
        FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i - 1)))),
best AS (SELECT conv_id, f[1].c AS cost, f[1].a AS audit FROM ways WHERE i = 1),
steps AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best),
letters AS (SELECT conv_id, p, substr(audit, p, 1) AS e, count(*) FILTER (substr(audit, p, 1) <> 'I') OVER o AS i, count(*) FILTER (substr(audit, p, 1) <> 'D') OVER o - 1 AS j
  FROM steps WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
lines AS (SELECT l.conv_id, p, j, e, m.role, CASE WHEN e = 'I' THEN '' ELSE m.text END AS text,
    bool_or(e = 'K' AND j = 0 AND m.c = 's') OVER (PARTITION BY l.conv_id) AS headed
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i AND l.e <> 'I' WHERE e <> 'D'),
joined AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - CASE WHEN headed THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t
  FROM lines GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM d.conv_id"""


@query("op12_conversations", CONVERSATIONS_SQL)
def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation after planted damage: its faults, the cheapest repair and a digest of the repaired rows."""
    rows = table(spark, folder, "conversations")
    hurt = conversations.damaged(rows)
    found = settle(conversations.repairs(hurt, "conv"))
    digests = conversations.repaired_digests(hurt, found, "conv")
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(found["conv"]), "left").drop("conv")
    out = out.join(digests, F.col("conv_id").eqNullSafe(digests["conv"]), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


NEGATIVES_SQL = """WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
  FROM q a JOIN q c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW o AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER o <= 5"""


@query("op11_negatives", NEGATIVES_SQL)
def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels shifted on purpose."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(table(spark, folder, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", "negative_score")
