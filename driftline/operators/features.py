"""Text features: vocabulary, TF-IDF as rows or as ML vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import STOP_WORDS, tokens, with_bigrams
from driftline.session import settle, small_batches

MAX_TERMS = 10_000  # fixed value: default vocabulary size
KNOWN_WORDS = 500_000  # frequent words that are sent to all tasks
COUNTS = "term string, cf long, df long"


def add_terms(df: DataFrame, text: str = "text", out: str = "terms", bigrams: bool = True,
              stop_words: list[str] | None = None) -> DataFrame:
    """Token array of each document, with adjacent pairs after stop-word removal; a narrow expression."""
    toks = tokens(text, STOP_WORDS if stop_words is None else stop_words)
    if not bigrams:
        return df.withColumn(out, toks)
    return df.withColumn("__t", toks).withColumn(out, with_bigrams("__t")).drop("__t")


def vocabulary(df: DataFrame, terms: str = "terms", size: int = MAX_TERMS, min_df: int = 1, max_df: float = 1.0, pairs: bool = False) -> DataFrame:
    """The `size` most frequent terms: (term, cf, df, docs, idf), ties by term; idf = ln((1 + docs) / (1 + df)) + 1.

    With `pairs`, the arrays hold single words and adjacent pairs are terms as well. Words are counted first. A pair cannot be more frequent
    than its rarer word, so only pairs of words that reach the count of the `size`-th word are counted; the others cannot be among the top.
    Each task counts a batch of documents by numbers of words and sends a row per distinct term.
    """
    small_batches(df.sparkSession)
    docs = df.agg(F.count(F.lit(1))).scalar()
    rows = df.select(F.col(terms).alias("t"))

    def fits(counts: DataFrame) -> DataFrame:
        return counts.withColumn("docs", F.lit(docs).cast("bigint")).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("docs") * F.lit(float(max_df))))

    counts = _summed(rows.mapInArrow(_word_counts, COUNTS))
    if pairs:
        counts = settle(counts)
        last = fits(counts).select("cf").orderBy(F.col("cf").desc()).limit(size).agg(F.min("cf").alias("cf"), F.count(F.lit(1)).alias("n")).first()
        known = None
        if last["n"] == size and last["cf"] > 1:
            found = counts.filter(F.col("cf") >= last["cf"]).select("term").limit(KNOWN_WORDS + 1).collect()
            known = [r["term"] for r in found] if len(found) <= KNOWN_WORDS else None  # beyond that all pairs are counted
        sent = df.sparkSession.sparkContext.broadcast(known)
        counts = counts.unionByName(_summed(rows.mapInArrow(lambda batches: _pair_counts(batches, sent.value), COUNTS)))
    top = fits(counts).orderBy(F.col("cf").desc(), "term").limit(size)
    return top.withColumn("idf", F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _numbered(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch of word lists, the number of each word, and the document it is in."""
    words = lists.flatten().dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _rows(term: pa.Array, kind: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Occurrences and documents per term; `kind` numbers the terms of all occurrences."""
    cf = np.bincount(kind, minlength=len(term))
    df = np.bincount(np.unique(doc * len(term) + kind) % max(len(term), 1), minlength=len(term))
    return pa.RecordBatch.from_arrays([term, pa.array(cf.astype(np.int64)), pa.array(df.astype(np.int64))], ["term", "cf", "df"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, code, doc = _numbered(batch.column(0))
        yield _rows(words, code.astype(np.int64), doc)


def _pair_counts(batches: Iterator[pa.RecordBatch], known: list[str] | None) -> Iterator[pa.RecordBatch]:
    wanted = None if known is None else pa.array(known, pa.string())
    for batch in batches:
        words, code, doc = _numbered(batch.column(0))
        kept = doc[1:] == doc[:-1]
        if wanted is not None:
            held = pc.is_in(words, value_set=wanted.cast(words.type)).to_numpy(zero_copy_only=False)
            kept &= held[code[:-1]] & held[code[1:]]
        at = np.flatnonzero(kept)
        kinds, kind = np.unique(code[at].astype(np.int64) * len(words) + code[at + 1], return_inverse=True)
        left, right = (words.take(pa.array(k)) for k in np.divmod(kinds, max(len(words), 1)))
        yield _rows(pc.binary_join_element_wise(left, right, " "), kind, doc[at])


class _Terms:
    """A vocabulary by word: which term a word is, and which two words next to each other are. Sent to tasks inside their function."""

    def __init__(self, terms: list[str], idf: list[float], pairs: bool):
        self.names, self.idf = terms, np.array(idf, float)
        split = [tuple(t.split(" ", 1)) if pairs and " " in t else (t,) for t in terms]
        self.words = sorted({w for t in split for w in t})
        number = {w: i for i, w in enumerate(self.words)}
        self.single = np.full(len(self.words) + 1, -1)  # the last place is for words that are in no term
        for i, t in enumerate(split):
            if len(t) == 1:
                self.single[number[t[0]]] = i
        both = sorted((number[t[0]] * len(self.words) + number[t[1]], i) for i, t in enumerate(split) if len(t) == 2)
        self.pair_keys, self.pair = np.array([k for k, _ in both], np.int64), np.array([i for _, i in both], np.int64)

    def weights(self, lists: pa.Array, sublinear: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of the terms in a batch of word lists, by document and term; unit L2 norm per document."""
        words, code, doc = _numbered(lists)
        found = pc.index_in(words, value_set=pa.array(self.words, pa.string()).cast(words.type))
        at = found.fill_null(len(self.words)).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        term = self.single[at]
        own = term >= 0
        keys = doc[own] * len(self.names) + term[own]
        if len(self.pair):
            next_to = np.flatnonzero((doc[1:] == doc[:-1]) & (at[:-1] < len(self.words)) & (at[1:] < len(self.words)))
            wanted = at[next_to] * len(self.words) + at[next_to + 1]
            k = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair) - 1)
            hit = self.pair_keys[k] == wanted
            keys = np.concatenate([keys, doc[next_to[hit]] * len(self.names) + self.pair[k[hit]]])
        keys, tf = np.unique(keys, return_counts=True)
        doc, term = np.divmod(keys, len(self.names))
        weight = (1 + np.log(tf) if sublinear else tf) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, weight * weight, minlength=len(lists)))
        return doc, term, weight / np.where(norm == 0, 1.0, norm)[doc]


def _vocabulary_rows(vocab: DataFrame) -> tuple[list[str], list[float]]:
    """Terms in order and their idf; only the vocabulary (at most its `size`) comes to the driver."""
    rows = vocab.select("term", "idf").orderBy("term").collect()
    # Without a term the vectors have one place, for a term that no text holds.
    return [r["term"] for r in rows] or [" "], [r["idf"] for r in rows] or [0.0]


def tfidf_rows(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id", terms: str = "terms", sublinear: bool = False, pairs: bool = False) -> DataFrame:
    """(id, term, tfidf) with unit L2 norm per document. `sublinear` uses 1 + ln(tf). With `pairs`, the arrays hold single
    words and adjacent pairs are terms as well.

    Every batch of documents is counted, weighted and scaled by itself, so nothing is shuffled.
    """
    small_batches(df.sparkSession)
    known = _Terms(*_vocabulary_rows(vocab), pairs)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(known.names, pa.string())
        for batch in batches:
            doc, term, weight = known.weights(batch.column(1), sublinear)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), names.take(pa.array(term)), pa.array(weight)], [id_col, "term", "tfidf"])

    rows = df.select(id_col, terms)
    return rows.mapInArrow(weigh, T.StructType([rows.schema[id_col], T.StructField("term", T.StringType()), T.StructField("tfidf", T.DoubleType())]))


def tfidf_vectors(df: DataFrame, vocab: DataFrame, terms: str = "terms", out: str = "features", pairs: bool = False) -> DataFrame:
    """`df` with a unit TF-IDF vector (sparse) in place of the column `terms`; a narrow pass, no shuffle."""
    small_batches(df.sparkSession)
    known = _Terms(*_vocabulary_rows(vocab), pairs)
    kept = [c for c in df.columns if c != terms]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, weight = known.weights(batch.column(len(kept)))
            n = batch.num_rows
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=n))].astype(np.int32))
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(known.names), np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight))]
            vectors = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], vectors], [*kept, out])

    rows = df.select(*kept, terms)
    return rows.mapInArrow(weigh, T.StructType([*rows.schema.fields[:-1], T.StructField(out, VectorUDT())]))


def tfidf_model(vocab: DataFrame, terms: str = "terms", out: str = "features") -> PipelineModel:
    """The same vectors by built-in transformers, from arrays that hold all terms, pairs included."""
    names, idf = _vocabulary_rows(vocab)
    counter = CountVectorizerModel.from_vocabulary(names, inputCol=terms, outputCol="counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted")
    return PipelineModel([counter, scale, Normalizer(p=2.0, inputCol="weighted", outputCol=out)])


class TfIdf:
    """Vocabulary and idf learned on the training rows only; `features(df)` puts the vectors in place of the words.

    Both read word arrays (`add_terms` without bigrams): settle them, and texts are cut into words once for all passes.
    """

    def __init__(self, train: DataFrame, words: str = "words", size: int = MAX_TERMS, min_df: int = 1, max_df: float = 1.0, bigrams: bool = True):
        self.words, self.bigrams = words, bigrams
        self.vocabulary = settle(vocabulary(train, words, size, min_df, max_df, pairs=bigrams))

    def features(self, df: DataFrame, out: str = "features") -> DataFrame:
        return tfidf_vectors(df, self.vocabulary, self.words, out, self.bigrams)
