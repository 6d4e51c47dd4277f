"""Text features and classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.catalog.base import documents, MARKERS, PREDICTIONS, PROBS, corpus, marker_predictions, marker_probs, query, r, vectors
from driftline.functions.text import STOP_WORDS, tokens
from driftline.operators import classify, features, quality, trajectory
from driftline.session import settle
from driftline.sources.labelled import read_table

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS = f"""toks AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({STOP_SQL})) AS toks FROM documents),
terms AS (SELECT doc_id, lang, unnest(list_concat(toks, list_transform(list_zip(toks[1:len(toks) - 1], toks[2:]), lambda p: p[1] || ' ' || p[2]))) AS term FROM toks)"""


def _vocab(source: str = "terms", size: int = 10_000, where: str = "true") -> str:
    return f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM {source} GROUP BY ALL),
total AS (SELECT count(DISTINCT doc_id) AS docs FROM docset),
vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, max(docs) AS docs, ln((1 + max(docs)) / (1 + count(*))) + 1 AS idf
  FROM tf CROSS JOIN total GROUP BY term HAVING {where} ORDER BY sum(tf) DESC, term LIMIT {size})"""


@query("token_counts", f"""WITH {TERMS.split(',' + chr(10) + 'terms')[0]}, t AS (SELECT doc_id, unnest(toks) AS t FROM toks)
SELECT doc_id, count(*) AS tokens, count(DISTINCT t) AS words, min(t) AS first_word, max(t) AS last_word FROM t GROUP BY doc_id""")
def token_counts(spark, folder):
    rows = documents(spark, folder).select("doc_id", tokens("text", STOP_WORDS).alias("t")).filter(F.size("t") > 0)
    return rows.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("words"),
        F.array_min("t").alias("first_word"), F.array_max("t").alias("last_word"))


def _terms(spark, folder):
    return features.add_terms(documents(spark, folder).select("doc_id", "lang", "text")).drop("text")


def _words(spark, folder):
    return features.add_terms(documents(spark, folder).select("doc_id", "text"), bigrams=False).drop("text")


@query("bigram_counts", f"WITH {TERMS} SELECT doc_id, count(*) AS terms, count(*) FILTER (contains(term, ' ')) AS pairs FROM terms GROUP BY doc_id")
def bigram_counts(spark, folder):
    rows = _terms(spark, folder).filter(F.size("terms") > 0)
    pairs = F.size(F.filter("terms", lambda t: F.contains(t, F.lit(" "))))
    return rows.select("doc_id", F.size("terms").cast("bigint").alias("terms"), pairs.cast("bigint").alias("pairs"))


DOCSET = "docset AS (SELECT doc_id FROM documents)"


@query("vocabulary", f"WITH {TERMS}, {DOCSET}, {_vocab(where='count(*) >= 2 AND count(*) <= max(docs) * 0.95::DOUBLE')} SELECT term, cf, df, docs, {r('idf')} AS idf FROM vocab")
def vocabulary(spark, folder):
    return features.vocabulary(settle(_words(spark, folder)), min_df=2, max_df=0.95, pairs=True)


TFIDF = """w AS (SELECT doc_id, term, {tf} * idf AS w FROM tf JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""


@query("tfidf", f"WITH {TERMS}, {DOCSET}, {_vocab()}, {TFIDF.format(tf='tf')} SELECT doc_id, term, {r('tfidf')} AS tfidf FROM tfidf")
def tfidf(spark, folder):
    words = settle(_words(spark, folder))
    return features.tfidf_rows(words, features.vocabulary(words, pairs=True), pairs=True)


@query("tfidf_sublinear", f"WITH {TERMS}, {DOCSET}, {_vocab()}, {TFIDF.format(tf='(1 + ln(tf))')} SELECT doc_id, term, {r('tfidf')} AS tfidf FROM tfidf")
def tfidf_sublinear(spark, folder):
    words = settle(_words(spark, folder))
    return features.tfidf_rows(words, features.vocabulary(words, pairs=True), sublinear=True, pairs=True)


SPLIT = """split AS (SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id)
  <= round(count(*) OVER (PARTITION BY lang) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM documents),
docset AS (SELECT doc_id FROM split WHERE split = 'train'),
train_terms AS (SELECT t.* FROM terms t JOIN docset USING (doc_id))"""


def _bundle(spark, folder):
    return classify.text_features(documents(spark, folder), "lang")


def _named(df: DataFrame, names: list[str], cols=("label", "prediction")) -> DataFrame:
    table = F.array(*[F.lit(n) for n in names])
    return df.select(*[c for c in df.columns if c not in cols], *[table[F.col(c).cast("int")].alias(c) for c in cols])


@query("naive_bayes", f"""WITH {TERMS}, {SPLIT}, {_vocab('train_terms')},
all_tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
w AS (SELECT doc_id, term, tf * idf AS w FROM all_tf JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w),
cls AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM docset)) AS prior FROM split WHERE split = 'train' GROUP BY lang),
sums AS (SELECT s.lang, t.term, sum(x) AS s FROM tfidf t JOIN split s ON s.doc_id = t.doc_id AND s.split = 'train' GROUP BY ALL),
theta AS (SELECT c.lang, v.term, ln(coalesce(s.s, 0) + 1) - ln(sum(coalesce(s.s, 0) + 1) OVER (PARTITION BY c.lang)) AS lp
  FROM cls c CROSS JOIN vocab v LEFT JOIN sums s ON s.lang = c.lang AND s.term = v.term),
dots AS (SELECT t.doc_id, h.lang, sum(t.x * h.lp) AS s FROM tfidf t JOIN theta h ON h.term = t.term GROUP BY ALL),
scores AS (SELECT d.doc_id, d.lang AS label, c.lang, c.prior + coalesce(s.s, 0) AS score FROM split d CROSS JOIN cls c LEFT JOIN dots s ON s.doc_id = d.doc_id AND s.lang = c.lang
  WHERE d.split = 'test')
SELECT doc_id, label, arg_max(lang, score) AS prediction, {r('max(score)')} AS score FROM scores GROUP BY ALL""")
def naive_bayes(spark, folder):
    train, test, names = _bundle(spark, folder)
    out = classify.naive_bayes(train)(test).select("doc_id", "label", "prediction", F.array_max("scores").alias("score"))
    return _named(out, names)


def _scored(model: str, train: DataFrame, test: DataFrame, names: list[str], id_col: str = "doc_id") -> DataFrame:
    out = _named(classify.predictions(classify.CLASSIFIERS[model](train), test, id_col).drop("probability"), names)
    return quality.accuracy_scores(out).withColumn("model", F.lit(model))


@query("text_logistic")
def text_logistic(spark, folder):
    return _scored("logistic", *_bundle(spark, folder))


@query("text_linear_svm")
def text_linear_svm(spark, folder):
    return _scored("linear_svm", *_bundle(spark, folder))


@query("text_random_forest")
def text_random_forest(spark, folder):
    return _scored("random_forest", *_bundle(spark, folder))


@query("class_weights", "SELECT quality, count(*) AS rows, " + r("sum(count(*)) OVER () / (count(*) OVER () * count(*))") + " AS weight FROM labels GROUP BY quality")
def class_weights(spark, folder):
    return classify.class_weights(read_table(spark, folder, "labels"), "quality")


@query("category_probabilities")
def category_probabilities(spark, folder):
    return classify.category_probabilities(corpus(spark, folder), "lang", keep=("time_bin",))


@query("classified_trajectory")
def classified_trajectory(spark, folder):
    return trajectory.probability_trajectory(classify.category_probabilities(corpus(spark, folder), "lang", keep=("time_bin",)))


def _first_letters(spark, folder):
    """Three plain classifiers of the language: marker words, stop-word density, accents."""
    marked = marker_predictions(spark, folder).select("doc_id", F.lit("markers").alias("member"), "prediction")
    docs = documents(spark, folder).select("doc_id", "text")
    the = F.when(F.contains(F.lower("text"), F.lit("the")), "en").otherwise("fr")
    accent = F.when(F.contains("text", F.lit("ß")), "de").when(F.contains("text", F.lit("ñ")), "es").when(F.contains("text", F.lit("é")), "fr").otherwise("en")
    return reduce(DataFrame.unionByName, [
        marked, docs.select("doc_id", F.lit("the").alias("member"), the.alias("prediction")),
        docs.select("doc_id", F.lit("accent").alias("member"), accent.alias("prediction"))])


VOTES = PREDICTIONS + """,
votes AS (SELECT doc_id, prediction FROM preds
  UNION ALL SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 'en' ELSE 'fr' END FROM documents
  UNION ALL SELECT doc_id, CASE WHEN contains(text, 'ß') THEN 'de' WHEN contains(text, 'ñ') THEN 'es' WHEN contains(text, 'é') THEN 'fr' ELSE 'en' END FROM documents)"""


@query("hard_vote", f"""WITH {VOTES}, t AS (SELECT doc_id, prediction, count(*) AS n FROM votes GROUP BY ALL)
SELECT doc_id, prediction FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, prediction) AS rn FROM t) WHERE rn = 1""")
def hard_vote(spark, folder):
    return classify.hard_vote(_first_letters(spark, folder), "doc_id")


SOFT = PROBS + """,
flat AS (SELECT doc_id, category, prob FROM probs UNION ALL
  SELECT doc_id, category, CASE WHEN category = CASE WHEN contains(lower(text), 'the') THEN 'en' ELSE 'fr' END THEN 0.7 ELSE 0.1 END
  FROM documents, (SELECT unnest(['de', 'en', 'es', 'fr']) AS category))"""


@query("soft_vote", f"""WITH {SOFT}, m AS (SELECT doc_id, category, avg(CAST(prob AS DOUBLE)) AS p FROM flat GROUP BY ALL)
SELECT doc_id, category AS prediction, {r('p')} AS prob FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, category) AS rn FROM m) WHERE rn = 1""")
def soft_vote(spark, folder):
    marked = marker_probs(spark, folder).select("doc_id", "category", "prob")
    docs = documents(spark, folder)
    the = F.when(F.contains(F.lower("text"), F.lit("the")), "en").otherwise("fr")
    fan = docs.select("doc_id", the.alias("p"), F.explode(F.array(*[F.lit(c) for c in MARKERS])).alias("category"))
    other = fan.select("doc_id", "category", F.when(F.col("category") == F.col("p"), 0.7).otherwise(0.1).alias("prob"))
    return classify.soft_vote(marked.unionByName(other), "doc_id")


@query("voting_ensemble")
def voting_ensemble(spark, folder):
    train, test, names = _bundle(spark, folder)
    return quality.accuracy_scores(_named(classify.vote(train, test), names))


@query("soft_voting_ensemble")
def soft_voting_ensemble(spark, folder):
    train, test, names = _bundle(spark, folder)
    return quality.accuracy_scores(_named(classify.vote(train, test, voting="soft"), names))


@query("vector_logistic")
def vector_logistic(spark, folder):
    return _scored("logistic", *classify.vector_features(vectors(spark, folder), "label", "vec_id"), id_col="vec_id")


@query("vector_linear_svm")
def vector_linear_svm(spark, folder):
    return _scored("linear_svm", *classify.vector_features(vectors(spark, folder), "label", "vec_id"), id_col="vec_id")
