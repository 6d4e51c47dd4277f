"""Document vectors: a pluggable encoder, pooled vectors and whole-corpus vector statistics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from driftline.functions.vectors import doubles, norm, total, unit
from driftline.session import small_batches

WORD = re.compile(r"\w\w+")


class HashedTerms:
    """Signed hashed term counts, L2-normalised; the same in every engine because the hash is md5.

    Token t adds +1 or -1 to component (first 8 hex digits of md5(t)) mod dims; the 9th hex digit gives the sign.
    """

    def __init__(self, dims: int = 64, cache: int = 200_000):
        self.dims, self.cache = dims, cache
        self._slots: dict[str, int] = {}

    def _slot(self, token: str) -> int:
        digest = hashlib.md5(token.encode()).hexdigest()
        at = int(digest[:8], 16) % self.dims
        slot = at if digest[8] < "8" else at + self.dims
        if len(self._slots) < self.cache:
            self._slots[token] = slot
        return slot

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float64)
        for i, text in enumerate(texts):
            words = WORD.findall(text.lower())
            if not words:
                continue
            known = self._slots
            slots = [known[w] if w in known else self._slot(w) for w in words]
            both = np.bincount(slots, minlength=2 * self.dims)
            out[i] = both[: self.dims] - both[self.dims :]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


def embed(df: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, text: str = "text",
          out: str = "embedding", batch: int = 64) -> DataFrame:
    """Add one vector per row. `encoder` maps a list of texts to an (n, d) array; it is unpickled once per task, so a
    loaded model stays in memory over all batches. A narrow pass: no shuffle, null text counts as empty.
    """
    small_batches(df.sparkSession)
    encoder = encoder or HashedTerms()
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType(), False))])

    def run(batches):
        for table in batches:
            texts = [t or "" for t in table.column(text).to_pylist()]
            parts = [np.asarray(encoder(texts[i : i + batch]), dtype=np.float32) for i in range(0, len(texts), batch)]
            if not parts:
                continue
            mat = np.vstack(parts)
            ends = np.arange(len(mat) + 1, dtype=np.int32) * mat.shape[1]
            vecs = pa.ListArray.from_arrays(pa.array(ends), pa.array(mat.ravel()))
            yield pa.RecordBatch.from_arrays([*table.columns, vecs], names=[*table.schema.names, out])

    return df.mapInArrow(run, schema)


def as_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as an (n, d) float64 array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pooled(vec: Column | str) -> Column:
    """Aggregate expression: elementwise mean vector. Partial sums are merged before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(vec))))


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "embedding", out: str = "centroid") -> DataFrame:
    """Elementwise mean and row count per key; one d-sized partial per key and task crosses the network."""
    rows = df.filter(F.col(vec).isNotNull())
    return rows.groupBy(*keys).agg(pooled(vec).alias(out), F.count(F.lit(1)).alias("docs"))


def unit_vectors(df: DataFrame, vec: str = "embedding", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, unit(vec))


def component_mean(vec: Column | str) -> Column:
    """Aggregate expression: mean over all components of all vectors of the group."""
    col = F.col(vec) if isinstance(vec, str) else vec
    return F.sum(total(col)) / F.sum(F.size(col))


def embedding_variance(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Population variance per component, averaged: one pass, one d-sized partial per task."""
    v = array_to_vector(doubles(vec))
    stats = df.filter(F.col(vec).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.variance(v)).alias("s")
    )
    # The summarizer gives sample variances.
    return stats.select((total("s") / F.size("s") * (F.col("n") - 1) / F.col("n")).alias("mean_variance"))


def norm_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    n = norm(vec)
    return df.agg(F.avg(n).alias("norm_mean"), F.stddev_pop(n).alias("norm_std"))


def _gram_parts(batches):
    """Partial sums of x and x xT over the unit vectors of one task."""
    acc = None
    for table in batches:
        x = as_matrix(table.column(0))
        if not len(x):
            continue
        size = np.linalg.norm(x, axis=1, keepdims=True)
        live = size[:, 0] > 0
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        part = (len(x), int(live.sum()), x.sum(axis=0), x.T @ x)
        acc = part if acc is None else tuple(a + b for a, b in zip(acc, part))
    if acc is None:
        return
    n, live, s, g = acc
    d = len(s)
    yield pa.RecordBatch.from_pydict({
        "i": np.arange(d + 1, dtype=np.int32),
        "row": [np.array([n, live], dtype=np.float64), *g],
    })
    yield pa.RecordBatch.from_pydict({"i": np.array([-1], dtype=np.int32), "row": [s]})


def pairwise_cosine(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Mean and population std of the cosine over all ordered pairs of different rows, without forming pairs.

    With S the sum of the n unit vectors and G the sum of their outer products, the sum of all cosines is |S|^2 and
    of all squared cosines is |G|^2, each including the n self-pairs (0 for a zero vector).
    """
    parts = df.select(vec).filter(F.col(vec).isNotNull()).mapInArrow(_gram_parts, "i int, row array<double>")
    sums = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    sq = F.aggregate("row", F.lit(0.0), lambda a, x: a + x * x)
    one = sums.agg(
        F.max(F.when(F.col("i") == 0, F.col("row")[0])).alias("n"),
        F.max(F.when(F.col("i") == 0, F.col("row")[1])).alias("live"),
        F.sum(F.when(F.col("i") == -1, sq)).alias("s2"),
        F.sum(F.when(F.col("i") > 0, sq)).alias("g2"),
    )
    pairs = F.col("n") * (F.col("n") - 1)
    mean = F.try_divide(F.col("s2") - F.col("live"), pairs)
    return one.select(
        mean.alias("cosine_mean"),
        F.sqrt(F.greatest(F.try_divide(F.col("g2") - F.col("live"), pairs) - mean * mean, F.lit(0.0))).alias("cosine_std"),
    )
