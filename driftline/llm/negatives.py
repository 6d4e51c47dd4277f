"""Hard negatives of anchors: exact integer products of tiles by Strassen's recursion, then mergeable heaps.

Vectors become integers, floor(scale * x). Candidates are sorted by label and cut into groups, a group being what one task holds; anchors are
sent to the groups, so that of the two sides only the small one is copied. A tile of anchors and a tile of candidates are multiplied by
Strassen's seven half-size products, down to small leaves, padded with zero rows and columns; only additions, subtractions and products of
int64 occur, which are exact modulo 2^64, and so is every score.

Two passes take the pairs apart. Anchors first meet the groups that hold their own label and keep a heap of their best positives per
group; merged heaps give the windows `low * positive <= 100 * negative <= 100 * positive`. Then anchors with their windows meet the candidates
of other labels and keep a heap per window and group, merged in the same way. A heap holds `keep` rows, so what returns to Spark is `keep`
rows per anchor (or window) and group, whatever the size of a label: a label that holds a third of all rows is just more groups.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part, nor do rows with a component whose integer
passes 2^31. Rows that repeat an id are one: the one with the smallest (label, vector). Vectors of different lengths are multiplied over the
components both have (the shorter is padded with zeros). Ties of score go to the smaller id. An anchor without a row of its label, and a positive
without a negative in its window, give no rows. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.session import lookup, settle

TILE = 512  # rows of a tile
LEAF = 32  # a side up to which a product is taken directly
GROUP_BYTES = 64 << 20  # candidate integers that a task holds


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, exact modulo 2^64, by seven half-size products per level; sides are padded with zeros to even halves."""
    (n, k), m = a.shape, b.shape[1]
    depth = 0
    while min(n, k, m) >> depth > leaf:
        depth += 1
    if depth == 0:
        return a @ b
    up = lambda size: -(-size // (1 << depth)) << depth
    x, y = np.zeros((up(n), up(k)), np.int64), np.zeros((up(k), up(m)), np.int64)
    x[:n, :k], y[:k, :m] = a, b
    return _halved(x, y, depth)[:n, :m]


def _halved(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if depth == 0:
        return a @ b
    n, k, m = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    p1 = _halved(a11 + a22, b11 + b22, depth - 1)
    p2 = _halved(a21 + a22, b11, depth - 1)
    p3 = _halved(a11, b12 - b22, depth - 1)
    p4 = _halved(a22, b21 - b11, depth - 1)
    p5 = _halved(a11 + a12, b22, depth - 1)
    p6 = _halved(a21 - a11, b11 + b12, depth - 1)
    p7 = _halved(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((2 * n, 2 * m), np.int64)
    out[:n, :m] = p1 + p4 - p5 + p7
    out[:n, m:] = p3 + p5
    out[n:, :m] = p2 + p4
    out[n:, m:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """For each of n rows the `keep` best (score, id) seen: higher scores first, ties by smaller id."""

    def __init__(self, n: int, keep: int):
        self.keep, self.row = keep, np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)  # a row's worst kept score once its heap is full

    def add(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        new = score >= self.least[row]
        row, score, ident = (np.concatenate(p) for p in ((self.row, row[new]), (self.score, score[new]), (self.id, ident[new])))
        order = np.lexsort((ident, -score, row))
        row, score, ident = row[order], score[order], ident[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.keep
        self.row, self.score, self.id = row[best], score[best], ident[best]
        full = rank[best] == self.keep - 1
        self.least[self.row[full]] = self.score[full]


def _best(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """Merge heaps: the first `keep` rows per key by score (higher first) and id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def integers(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, label, x) of the rows that take part, one per id; x are the vector's integers."""
    vector = F.col("vector")
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < float(1 << 31)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & sound)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return one.select("id", "r.label", F.transform("r.vector", lambda v: F.floor(v * scale).cast("int")).alias("x"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of integers as rows of an int64 matrix, padded with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(lengths.max(initial=0), 1)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = min(a.shape[1], b.shape[1])
    return strassen(a[:, :k], np.ascontiguousarray(b[:, :k].T))


def grouped(candidates: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """The candidates with the group each belongs to, and the number of groups; a group is a range of labels and ids of about `group_bytes`."""
    size = candidates.agg(F.sum(F.size("x")).alias("n")).first().n or 0
    parts = max(candidates.sparkSession.sparkContext.defaultParallelism, -(-size * 8 // group_bytes))
    groups = settle(candidates.repartitionByRange(parts, "label", "id").withColumn("grp", F.spark_partition_id()))
    return groups, (groups.agg(F.max("grp").alias("last")).first().last or 0) + 1


def _meet(sent: DataFrame, groups: DataFrame, n: int, work, schema: str) -> DataFrame:
    """Run `work(anchors, candidate tiles)` for every tile of the anchors (grp, id, label, x, windows) that are sent to a group.

    In a group the candidates come first and are held as tiles; anchors pass by, a tile at a time.
    """
    own = groups.select("grp", F.lit(0).alias("kind"), "label", "id", "x", F.lit(None).cast(sent.schema["windows"].dataType).alias("windows"))
    rows = own.unionByName(sent.withColumn("kind", F.lit(1))).select("grp", "kind", "label", "id", "x", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            grp, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(grp) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(grp)]):
                if grp[start] != group:
                    group, held = grp[start], []
                for at in range(start, stop, TILE):
                    part = batch.slice(at, min(TILE, stop - at))
                    tile = (part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4)))
                    if kind[start] == 0:
                        held.append(tile)
                    else:
                        yield work(tile, part.column(5), held)

    # One task per group; a group's anchors are sorted by label, so that a tile has few labels.
    return rows.repartition(n, "grp").sortWithinPartitions("grp", "kind", "label", "id").mapInArrow(run, schema)


def positives(anchors: DataFrame, groups: DataFrame, n: int, keep: int) -> DataFrame:
    """(anchor, label, x, windows): each anchor with its best other rows of the same label as (id, score), best first."""
    homes = lookup(groups.select("label", "grp").distinct())  # a row per group and label that it holds
    sent = anchors.withColumn("windows", F.lit(None).cast("array<struct<id:long,score:long>>")).join(homes, "label")

    def work(tile, _, held):
        label, ident, x = tile
        heaps = Heaps(len(ident), keep)
        for other, names, y in held:
            if other[0] <= label[-1] and label[0] <= other[-1]:
                score = _product(x, y)
                i, j = np.nonzero((label[:, None] == other) & (ident[:, None] != names) & (score >= heaps.least[:, None]))
                heaps.add(i, score[i, j], names[j])
        return pa.RecordBatch.from_arrays([pa.array(ident[heaps.row]), pa.array(heaps.score), pa.array(heaps.id)], ["anchor", "score", "id"])

    best = _best(_meet(sent, groups, n, work, "anchor long, score long, id long"), ["anchor"], keep)
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("w"))
    windows = windows.select(F.col("anchor").alias("id"), F.transform("w", lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score"))).alias("windows"))
    return anchors.join(windows, "id")


def negatives(anchors: DataFrame, groups: DataFrame, n: int, keep: int, low: int) -> DataFrame:
    """(anchor, positive, positive_score, rank, id, score): per positive of an anchor the best rows of other labels in its window."""
    sent = anchors.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def work(tile, windows, held):
        label, ident, x = tile
        lengths = np.diff(windows.offsets.to_numpy())
        owner = np.repeat(np.arange(len(ident)), lengths)
        positive, high = (windows.flatten().field(k).to_numpy() for k in (0, 1))
        least = -(-low * high // 100)
        heaps = Heaps(len(owner), keep)
        for other, names, y in held:
            if label[0] == label[-1] == other[0] == other[-1]:
                continue
            score = _product(x, y)
            differs = label[:, None] != other
            for a in range(0, len(owner), TILE):  # windows, as many at a time as a tile has rows
                w = owner[a : a + TILE]
                s = score[w]
                i, j = np.nonzero(differs[w] & (s <= high[a : a + TILE, None]) & (s >= np.maximum(least, heaps.least)[a : a + TILE, None]))
                heaps.add(i + a, s[i, j], names[j])
        at = heaps.row
        return pa.RecordBatch.from_arrays(
            [pa.array(ident[owner[at]]), pa.array(positive[at]), pa.array(high[at]), pa.array(heaps.score), pa.array(heaps.id)], ["anchor", "positive", "positive_score", "score", "id"])

    found = _meet(sent, groups, n, work, "anchor long, positive long, positive_score long, score long, id long")
    return _best(found, ["anchor", "positive", "positive_score"], keep)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    keep: int = 5, low: int = 80, scale: int = 256, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score): the hard negatives of every anchor and positive.

    `is_anchor` is a condition on the column `id`.
    """
    groups, n = grouped(integers(vectors, id_col, label_col, vector_col, scale), group_bytes)
    anchors = groups.where(is_anchor).drop("grp")
    windows = settle(positives(anchors, groups, n, keep))
    found = negatives(windows, groups, n, keep, low)
    return found.select("anchor", "positive", "rank", F.col("id").alias("negative"), "positive_score", F.col("score").alias("negative_score"))
