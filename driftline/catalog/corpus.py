"""Scans, cleaning, time bins, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.catalog.base import (
    documents, CONCEPTS, CONCEPTS_SQL, CORPUS, EVENT_SERIES, SALES_SERIES, STORED, corpus, event_series, query, r, sales_series, stored,
)
from driftline.functions import stats, text
from driftline.operators import corpus as ops
from driftline.operators import ranking, series, trajectory
from driftline.session import shared_dir
from driftline.sources import feeds, labelled, sinks
from driftline.sources.labelled import read_table

WS = r"[\t\n\x0b\f\r\x1c-\x1f ]+"
CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(replace(coalesce({0}, ''), chr(160), ' '), "
    r"'http[s]?://[^\t\n\x0b\f\r\x1c-\x1f \x{{85}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '', 'g'), "
    r"'[^\x00-\x7F]+', ' ', 'g'), '" + WS + r"', ' ', 'g'), ' ')"
)


def _dated(spark, folder):
    return corpus(spark, folder).select("doc_id", "source", "lang", "title", "text", "published")


@query("feed_rss", f"""WITH {CORPUS}
SELECT 'rss' AS source, title, text AS summary, title || chr(10) || text AS text, published, 'doc:' || doc_id AS url FROM corpus""")
def feed_rss(spark, folder):
    items = _dated(spark, folder).select(F.to_xml(F.struct(
        "title", F.col("text").alias("description"), F.concat(F.lit("doc:"), "doc_id").alias("link"),
        F.concat(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pubDate"),
    ), {"rowTag": "item"}).alias("xml"))
    return feeds.parse_items(items, "xml")


@query("feed_files", f"""WITH {CORPUS}
SELECT 'rss' AS source, title, text AS summary, title || chr(10) || text AS text, published, 'doc:' || doc_id AS url FROM corpus""")
def feed_files(spark, folder):
    """The documents written as feed files into the shared folder and read from there, split by item."""
    items = _dated(spark, folder).select(F.to_xml(F.struct(
        "title", F.col("text").alias("description"), F.concat(F.lit("doc:"), "doc_id").alias("link"),
        F.concat(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pubDate"),
    ), {"rowTag": "item"}).alias("xml"))
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    head = F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>all</title>')
    items.select(F.concat(head, "xml").alias("value")).write.text(path)
    return feeds.read_rss(spark, path)


def _entries(spark, folder):
    return _dated(spark, folder).select(F.to_xml(F.struct(
        "title", F.col("text").alias("summary"),
        F.array(F.struct(F.concat(F.lit("doc:"), "doc_id").alias("_href"))).alias("link"),
        F.concat(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("published"),
    ), {"rowTag": "entry"}).alias("xml"))


@query("feed_atom", f"""WITH {CORPUS}
SELECT 'arxiv' AS source, title, text AS summary, title || chr(10) || text AS text, published, 'doc:' || doc_id AS url FROM corpus""")
def feed_atom(spark, folder):
    return feeds.parse_items(_entries(spark, folder), "xml", "atom")


@query("atom_files", f"""WITH {CORPUS}
SELECT 'arxiv' AS source, title, text AS summary, title || chr(10) || text AS text, published, 'doc:' || doc_id AS url FROM corpus""")
def atom_files(spark, folder):
    """The documents written as Atom files into the shared folder and read from there, split by entry."""
    path = f"{shared_dir(spark)}/atom-{uuid.uuid4().hex}"
    head = F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>')
    _entries(spark, folder).select(F.concat(head, "xml").alias("value")).write.text(path)
    return feeds.read_atom(spark, path)


@query("date_range", """SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def date_range(spark, folder):
    return ops.between_dates(read_table(spark, folder, "events"), "2024-01-05 00:00:00", "2024-01-20 12:00:00", "ts").select("event_id", "ts")


@query("source_cap", """SELECT event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 50""")
def source_cap(spark, folder):
    return ops.cap_per_source(read_table(spark, folder, "events"), 50, "event_type", "ts", "event_id").select("event_type", "event_id", "ts")


@query("published_order", f"WITH {CORPUS} SELECT doc_id, published FROM corpus ORDER BY published, doc_id")
def published_order(spark, folder):
    return corpus(spark, folder).select("doc_id", "published").orderBy("published", "doc_id")


@query("labelled_rows", """WITH raw AS (SELECT doc_id, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS class,
  split_part(text, chr(10), 1) AS title, text AS description FROM documents)
SELECT doc_id, class, CASE class WHEN 1 THEN 'World' WHEN 2 THEN 'Sports' WHEN 3 THEN 'Business' ELSE 'Sci/Tech' END AS category,
  title || '. ' || description AS text FROM raw""")
def labelled_rows(spark, folder):
    number = F.when(F.col("lang") == "de", "1").when(F.col("lang") == "en", "2").when(F.col("lang") == "es", "3").otherwise("4")
    raw = corpus(spark, folder).select("doc_id", number.alias("class"), "title", F.col("text").alias("description"))
    return labelled.label_rows(raw).select("doc_id", "class", "category", "text")


@query("labelled_files", """WITH raw AS (SELECT CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS class,
  split_part(text, chr(10), 1) AS title, text AS description FROM documents)
SELECT class, CASE class WHEN 1 THEN 'World' WHEN 2 THEN 'Sports' WHEN 3 THEN 'Business' ELSE 'Sci/Tech' END AS category,
  title || '. ' || description AS text FROM raw""")
def labelled_files(spark, folder):
    """The documents written as CSV files, line breaks and quotes in the texts, into the shared folder and read from there, split by split."""
    number = F.when(F.col("lang") == "de", "1").when(F.col("lang") == "en", "2").when(F.col("lang") == "es", "3").otherwise("4")
    path = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    rows = corpus(spark, folder).select(number.alias("class"), "title", F.col("text").alias("description"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return labelled.read_labelled_csv(spark, path).select("class", "category", "text")


@query("stored_vectors", f"WITH {STORED} SELECT doc_id, CAST(label AS DOUBLE) AS label, CAST(len(v) AS DOUBLE) AS dims, {r('list_sum(v)')} AS total FROM stored")
def stored_vectors(spark, folder):
    from driftline.functions.vectors import total

    return stored(spark, folder).select("doc_id", F.col("label").cast("double"), F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("double")).alias("dims"), total("embedding").alias("total"))


@query("series_sink", f"WITH {SALES_SERIES} SELECT series, time_bin, {r('value')} AS value FROM sales_series")
def series_sink(spark, folder):
    path = f"{shared_dir(spark)}/series-{uuid.uuid4().hex}"
    sinks.write_series(sales_series(spark, folder), path)
    back = spark.read.parquet(path)
    return back.select("series", "time_bin", "value")


@query("ingest_stats", f"""WITH {CORPUS}, per AS (
  SELECT source, count(*) AS docs, min(published) AS first, max(published) AS last FROM corpus GROUP BY source
  UNION ALL SELECT '*', count(*), min(published), max(published) FROM corpus)
SELECT *, CAST(date_diff('day', first, last) AS INTEGER) AS span_days FROM per""")
def ingest_stats(spark, folder):
    return ops.ingest_stats(corpus(spark, folder))


@query("normalized_text", f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents")
def normalized_text(spark, folder):
    return documents(spark, folder).select("doc_id", text.normalize_text("text").alias("text"))


def _frames(spark, folder):
    talk = read_table(spark, folder, "conversations").select(
        (F.lit(10**12) + F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.col("role").alias("source"),
        F.when(F.col("turn") % 5 != 4, F.expr("timestamp_ntz'2022-03-01 00:00:00'")).alias("published"))
    return [corpus(spark, folder).select("doc_id", "title", "text", "source", "published"), talk]


@query("clean_corpus", f"""WITH {CORPUS}, every AS (
  SELECT doc_id, title, text, source, published FROM corpus
  UNION ALL SELECT 1000000000000 + conv_id * 1000 + turn, NULL, text, role,
    CASE WHEN turn % 5 <> 4 THEN TIMESTAMP '2022-03-01' END FROM conversations)
SELECT doc_id, {CLEAN.format('title')} AS title, {CLEAN.format('text')} AS text, source, published FROM every WHERE published IS NOT NULL""")
def clean_corpus(spark, folder):
    return ops.clean_corpus(_frames(spark, folder))


@query("numbered_rows", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS ids FROM events")
def numbered_rows(spark, folder):
    rows = ops.number_rows(read_table(spark, folder, "events").drop("props"), "row_id", stable_input=True)
    once = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("c"))
    return once.agg(F.sum("c").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count(F.lit(1)).alias("ids"))


@query("numbered_union", """SELECT row_number() OVER (ORDER BY part, key) - 1 AS row_id, part, key FROM (
  SELECT 0 AS part, o_orderkey AS key FROM orders UNION ALL SELECT 1, c_custkey FROM customer UNION ALL SELECT 2, o_orderkey FROM orders)""")
def numbered_union(spark, folder):
    """Ids of three frames without ids, in the order of the frames and of the rows in them."""
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("key")).orderBy("key")
    customers = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("key")).orderBy("key")
    frames = [f.withColumn("part", F.lit(k)) for k, f in enumerate((orders, customers, orders))]
    return ops.number_rows(ops.union_by_name(frames), "row_id").select("row_id", "part", "key")


@query("concept_match", f"""WITH {CONCEPTS_SQL}, hit AS (
  SELECT doc_id, concept, regexp_matches(lower(text), lower(concept)) AS a, contains(lower(text), lower(concept)) AS b,
    regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || lower(concept) || '($|[^\\p{{L}}\\p{{N}}_])') AS c FROM documents, concepts)
SELECT concept, CAST(count(*) FILTER (a) AS BIGINT) AS regex, CAST(count(*) FILTER (b) AS BIGINT) AS literal,
  CAST(count(*) FILTER (c) AS BIGINT) AS word FROM hit GROUP BY concept""")
def concept_match(spark, folder):
    docs = documents(spark, folder).select("text")
    flags = docs.agg(*[
        F.sum(F.when(text.mentions("text", c, m), 1).otherwise(0)).alias(f"{m}_{i}")
        for i, c in enumerate(CONCEPTS) for m in ("regex", "literal", "word")])
    return flags.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("concept"), *[F.col(f"{m}_{i}").alias(m) for m in ("regex", "literal", "word")])
        for i, c in enumerate(CONCEPTS)])))


@query("weak_pairs", f"""WITH {CORPUS} SELECT doc_id, title, text, CAST(1 AS DOUBLE) AS label FROM (
  SELECT doc_id, title, text FROM corpus WHERE length(title) > 10 AND length(text) > 40)""")
def weak_pairs(spark, folder):
    return ops.weak_pairs(corpus(spark, folder))


@query("source_labels", """SELECT DISTINCT o_orderpriority AS priority, replace(lower(o_orderpriority), '/', '_') AS plain,
  'news_' || lower(o_orderpriority) AS prefixed FROM orders""")
def source_labels(spark, folder):
    rows = read_table(spark, folder, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()
    return rows.select("priority", text.source_label("priority").alias("plain"), text.source_label("priority", "news_").alias("prefixed"))


@query("squeezed_text", f"SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g'), ' ') AS text FROM conversations")
def squeezed_text(spark, folder):
    return read_table(spark, folder, "conversations").select("conv_id", "turn", text.squeeze_whitespace("text").alias("text"))


@query("clamped_stats", f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE
  ELSE value / 50 - 0.1 END AS q FROM events)
SELECT event_id, {r("CASE WHEN isnan(q) OR isinf(q) THEN 1 ELSE greatest(0, least(1, q)) END")} AS p,
  {r("CASE WHEN isnan(q) OR isinf(q) OR q < 0 THEN 0 ELSE q END")} AS f FROM s""")
def clamped_stats(spark, folder):
    q = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value") / 50 - 0.1)
    rows = read_table(spark, folder, "events").select("event_id", q.alias("q"))
    return rows.select("event_id", stats.clamp_p(F.col("q")).alias("p"), stats.clamp_f(F.col("q")).alias("f"))


@query("category_codes", "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code FROM documents")
def category_codes(spark, folder):
    return ops.category_codes(documents(spark, folder).select("doc_id", "lang"), "lang")


@query("time_bins", """SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w,
  CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q FROM orders""")
def time_bins(spark, folder):
    rows = read_table(spark, folder, "orders")
    return rows.select("o_orderkey", *[ops.bin_start("o_orderdate", f).alias(f.lower()) for f in ("D", "W", "M", "Q")])


def _slot_sql(slots: int, step: int, unit: str) -> str:
    at = f"TIMESTAMP '2022-01-01' + to_days(CAST(doc_id % {slots} * {step} AS INTEGER))"
    return f"{at} AS published, CAST(date_trunc('{unit}', {at}) AS TIMESTAMP) AS time_bin"


@query("slot_dates", f"""SELECT doc_id, 'W' AS freq, {_slot_sql(96, 7, 'week')} FROM documents
UNION ALL SELECT doc_id, 'M', {_slot_sql(24, 30, 'month')} FROM documents
UNION ALL SELECT doc_id, 'D', {_slot_sql(720, 1, 'week')} FROM documents""")
def slot_dates(spark, folder):
    docs = documents(spark, folder).select("doc_id")
    return ops.union_by_name([
        ops.spread_over_bins(docs, "doc_id", f).select("doc_id", F.lit(f).alias("freq"), "published", "time_bin") for f in ("W", "M", "D")])


@query("bin_coverage", f"""WITH {CORPUS} SELECT count(DISTINCT time_bin) AS bins, min(time_bin) AS first, max(time_bin) AS last,
  CAST(date_diff('day', min(time_bin), max(time_bin)) AS INTEGER) AS span_days, count(DISTINCT time_bin) >= 10 AS enough FROM corpus""")
def bin_coverage(spark, folder):
    return ops.bin_coverage(corpus(spark, folder))


@query("series_frequency", f"""WITH {SALES_SERIES}, d AS (SELECT series, epoch(time_bin) - epoch(lag(time_bin) OVER (PARTITION BY series ORDER BY time_bin)) AS s FROM sales_series)
SELECT series, count(*) AS n, {r('avg(s)')} AS mean_step, {r('median(s)')} AS median_step FROM d GROUP BY series""")
def series_frequency(spark, folder):
    return series.frequency(sales_series(spark, folder), ["series"])


# Calendars planted in the order dates: each date moved to the beginning or end of its week, month, quarter or year; all business days of its week.
CALENDARS_SQL = """days AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS d FROM orders),
planted AS (SELECT DISTINCT series, t FROM (
  SELECT 'month_start' AS series, CAST(date_trunc('month', d) AS TIMESTAMP) AS t FROM days UNION ALL SELECT 'month_end', CAST(last_day(d) AS TIMESTAMP) + INTERVAL 18 HOUR FROM days
  UNION ALL SELECT 'quarter_start', CAST(date_trunc('quarter', d) AS TIMESTAMP) FROM days UNION ALL SELECT 'quarter_end', CAST(last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH) AS TIMESTAMP) FROM days
  UNION ALL SELECT 'year_start', CAST(date_trunc('year', d) AS TIMESTAMP) FROM days UNION ALL SELECT 'week', CAST(date_trunc('week', d) AS TIMESTAMP) + INTERVAL 9 HOUR FROM days
  UNION ALL SELECT 'business', CAST(date_trunc('week', d) AS TIMESTAMP) + to_days(CAST(k AS INTEGER)) FROM days, (SELECT unnest(range(5)) AS k)
  UNION ALL SELECT 'irregular', d FROM days WHERE day(d) IN (1, 2, 5, 11))),
steps AS (SELECT *, lag(t) OVER w AS b, epoch(t) - epoch(lag(t) OVER w) AS s, (year(t) * 12 + month(t)) - lag(year(t) * 12 + month(t)) OVER w AS m
  FROM planted WINDOW w AS (PARTITION BY series ORDER BY t)),
one AS (SELECT series, count(*) AS n, min(s) AS lo, max(s) AS hi, median(s) AS median_step, min(m) AS m, max(m) AS m_hi, bool_and(day(t) = 1) AS first,
  bool_and(CAST(t AS DATE) = last_day(t)) AS last, count(DISTINCT CAST(t AS TIME)) = 1 AS clock, max(t) AS t,
  bool_and(isodow(t) < 6 AND (s IS NULL OR s = 86400 OR (s = 3 * 86400 AND isodow(b) = 5))) AS business FROM steps GROUP BY series),
named AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN clock AND (first OR last) AND m = m_hi THEN CASE WHEN m % 12 = 0 THEN 'Y' WHEN m % 3 = 0 THEN 'Q' ELSE 'M' END || CASE WHEN first THEN 'S' ELSE 'E' END
  WHEN lo = hi AND lo % (7 * 86400) = 0 THEN 'W' WHEN lo = hi AND lo % 86400 = 0 THEN 'D' WHEN clock AND business THEN 'B' END AS unit FROM one),
sized AS (SELECT *, CAST(CASE left(unit, 1) WHEN 'Y' THEN m / 12 WHEN 'Q' THEN m / 3 WHEN 'M' THEN m WHEN 'W' THEN lo / (7 * 86400) WHEN 'D' THEN lo / 86400 WHEN 'B' THEN 1 END AS INTEGER) AS every,
  CASE WHEN unit LIKE 'Y%' THEN upper(strftime(t, '%b')) WHEN unit LIKE 'Q%' THEN ['OCT', 'NOV', 'DEC'][(month(t) - 1) % 3 + 1] WHEN unit = 'W' THEN upper(strftime(t, '%a')) END AS anchor FROM named),
calendars AS (SELECT series, n, CASE WHEN every > 1 THEN CAST(every AS VARCHAR) ELSE '' END || unit || coalesce('-' || anchor, '') AS freq, unit, every, median_step, t FROM sized)"""


def _calendars(spark, folder):
    days = read_table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("d")).distinct()
    moved = lambda unit: F.date_trunc(unit, "d").cast("timestamp_ntz")
    end = lambda c: F.last_day(c).cast("timestamp_ntz")
    planted = {
        "month_start": moved("month"), "month_end": end("d") + F.expr("interval 18 hours"), "quarter_start": moved("quarter"),
        "quarter_end": end(F.add_months(moved("quarter"), 2)), "year_start": moved("year"), "week": moved("week") + F.expr("interval 9 hours")}
    rows = days.select(F.inline(F.array(*[F.struct(F.lit(k).alias("series"), t.alias("time_bin")) for k, t in planted.items()])))
    business = days.select(F.lit("business").alias("series"), F.explode(F.array(*[moved("week") + F.expr(f"interval {k} days") for k in range(5)])).alias("time_bin"))
    odd = days.where(F.day("d").isin(1, 2, 5, 11)).select(F.lit("irregular").alias("series"), F.col("d").alias("time_bin"))
    return rows.unionByName(business).unionByName(odd).distinct()


@query("calendar_frequency", f"WITH {CALENDARS_SQL} SELECT series, n, freq, unit, coalesce(every, 0) AS every, {r('median_step')} AS median_step FROM calendars")
def calendar_frequency(spark, folder):
    return series.calendar_frequency(_calendars(spark, folder), ["series"]).withColumn("every", F.coalesce("every", F.lit(0)))


@query("calendar_future", f"""WITH {CALENDARS_SQL}, ahead AS (SELECT *, CAST(step AS INTEGER) AS step, CAST(every * step * CASE left(unit, 1) WHEN 'Y' THEN 12 WHEN 'Q' THEN 3 ELSE 1 END AS INTEGER) AS months
  FROM calendars, unnest(range(1, 7)) AS u(step))
SELECT series, step, freq, CAST(CASE WHEN unit LIKE '_S' THEN t + to_months(months) WHEN unit LIKE '_E' THEN CAST(last_day(date_trunc('month', t) + to_months(months)) AS TIMESTAMP) + (t - date_trunc('day', t))
  WHEN unit = 'B' THEN t + to_days(CAST(step + 2 * ((isodow(t) - 1 + step) // 5) AS INTEGER)) WHEN unit = 'W' THEN t + to_days(CAST(7 * every * step AS INTEGER)) WHEN unit = 'D' THEN t + to_days(CAST(every * step AS INTEGER))
  ELSE t + to_microseconds(CAST(round(median_step * step * 1000000) AS BIGINT)) END AS TIMESTAMP) AS time_bin FROM ahead""")
def calendar_future(spark, folder):
    return series.calendar_future(_calendars(spark, folder), ["series"], 6)


@query("future_bins", f"""WITH {SALES_SERIES}, s AS (SELECT series, count(*) AS n, min(time_bin) AS a, max(time_bin) AS b FROM sales_series GROUP BY series)
SELECT series, CAST(step AS INTEGER) AS step, b + to_microseconds(CAST(round((epoch_us(b) - epoch_us(a)) / (n - 1) * step) AS BIGINT)) AS time_bin
FROM s, unnest(range(1, 13)) AS t(step)""")
def future_bins(spark, folder):
    return series.future_bins(sales_series(spark, folder), ["series"], 12)


@query("recent_window", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY")
def recent_window(spark, folder):
    return ops.default_window(read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), 180, "o_orderdate")


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark, folder):
    return ops.value_counts(documents(spark, folder), "lang")


@query("seeded_sample", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 200)")
def seeded_sample(spark, folder):
    return ranking.sample_rows(documents(spark, folder).select("doc_id"), 200, "doc_id")


@query("share_sample", f"SELECT event_id FROM events WHERE CAST('0x' || substr(md5('42|' || event_id), 1, 6) AS BIGINT) < {int(0.2 * 16**6)}")
def share_sample(spark, folder):
    return ranking.sample_share(read_table(spark, folder, "events").select("event_id"), 0.2, "event_id")


RANKED = """ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r,
  count(*) OVER (PARTITION BY lang) AS size FROM documents)"""


@query("stratified_split", f"WITH {RANKED} SELECT doc_id, lang, CASE WHEN r <= round(size * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ranked")
def stratified_split(spark, folder):
    return ranking.stratified_split(documents(spark, folder).select("doc_id", "lang"), "lang", "doc_id")


@query("stratified_folds", f"WITH {RANKED} SELECT doc_id, lang, CAST((r - 1) % 5 AS INTEGER) AS fold FROM ranked")
def stratified_folds(spark, folder):
    return ranking.stratified_folds(documents(spark, folder).select("doc_id", "lang"), "lang", "doc_id", 5)


@query("head_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5000")
def head_rows(spark, folder):
    return ranking.head_rows(documents(spark, folder).select("doc_id", "lang"), 5000, "doc_id")


@query("dense_grid", f"""WITH {EVENT_SERIES}, obs AS (SELECT * FROM event_series WHERE value > (SELECT avg(value) FROM event_series))
SELECT b.time_bin, s.source, {r('o.value')} AS value FROM (SELECT DISTINCT time_bin FROM obs) b
CROSS JOIN (SELECT DISTINCT series AS source FROM obs) s LEFT JOIN obs o ON o.time_bin = b.time_bin AND o.series = s.source""")
def dense_grid(spark, folder):
    rows = event_series(spark, folder).withColumnRenamed("series", "source")
    return trajectory.dense_grid(rows.filter(F.col("value") > rows.agg(F.avg("value")).scalar()))
