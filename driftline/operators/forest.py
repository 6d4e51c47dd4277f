"""Random forest over sparse, non-negative features such as TF-IDF: all trees grow a level in the same scan.

Rows are cut into bins once and written as blocks of bytes. A scan lays a block out as a matrix of bins, walks every row down every tree there and counts, for
each node of the present level, class weights by (feature, bin) of the features the node looks at; the bin of zeros is what is missing from the node's totals. A node
looks at about the root of all features, chosen by hash once a scan; one that finds no split looks again at four times as many. A task adds up its blocks;
counts of a run of nodes meet in one task, which chooses their splits. A split tells the classes of both children, so pure ones are leaves without
a scan. The driver holds the trees, never rows. Rows are drawn with replacement by hash, so a fit repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.svm import _sparse
from driftline.session import freed_shuffles, settle

SLOTS = 20_000  # nodes whose counts are taken in one scan
LOOKS = 8_000_000  # features that these nodes look at, in all
CELLS = 1 << 24  # rows by features of a block
KEYS = 1 << 21  # counts that a task collects before it adds them up
DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])  # a row's times in a sample of as many rows: Poisson with mean 1


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _share(x: np.ndarray) -> np.ndarray:
    return (_mixed(x) >> np.uint64(11)) / float(1 << 53)


class Forest:
    """Trees as arrays over nodes: feature (-1: a leaf), threshold (up to it: left), left child (right is next to it), class weights."""

    def __init__(self, trees: int, classes: int, size: int):
        self.size, self.classes = size, classes
        self.root = np.arange(trees)
        self.feature, self.threshold = np.full(trees, -1), np.zeros(trees)
        self.left, self.weights = np.zeros(trees, np.int64), np.zeros((trees, classes))

    def grow(self, nodes: np.ndarray, features: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        """Split nodes; the numbers of their children."""
        first = len(self.feature)
        self.feature[nodes], self.threshold[nodes], self.left[nodes] = features, thresholds, first + 2 * np.arange(len(nodes))
        self.feature = np.append(self.feature, np.full(2 * len(nodes), -1))
        self.threshold, self.left = np.append(self.threshold, np.zeros(2 * len(nodes))), np.append(self.left, np.zeros(2 * len(nodes), np.int64))
        self.weights = np.vstack([self.weights, np.zeros((2 * len(nodes), self.classes))])
        return np.arange(first, len(self.feature))

    def arrays(self) -> tuple:
        """What `walk` needs, without the class: a broadcast is pickled by reference, and executors need not have this module."""
        return self.size, self.feature, self.threshold, self.left

    def probabilities(self, features: str = "features") -> Column:
        """Mean over the trees of the class shares of a row's leaf."""
        shares = self.weights / np.maximum(self.weights.sum(1, keepdims=True), 1e-300)
        trees, classes, roots = self.arrays(), self.classes, self.root.tolist()

        @F.arrow_udf("array<double>")
        def score(vectors: pa.Array) -> pa.Array:
            entries, n = _ordered(*_sparse(vectors)), len(vectors)
            out = sum(shares[walk(trees, *entries, n, t)] for t in roots) / len(roots)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * classes), pa.array(out.ravel()))

        return score(F.unwrap_udt(features))


def walk(trees: tuple, row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, root: int) -> np.ndarray:
    """The node that each of n rows ends in, below a root."""
    size, feature, threshold, left = trees
    key = row * size + place
    node = np.full(n, root)
    going = np.arange(n)
    while len(going := going[feature[node[going]] >= 0]):
        at = node[going]
        wanted = going * size + feature[at]
        k = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        x = np.where(key[k] == wanted, value[k], 0.0) if len(key) else np.zeros(len(going))
        node[going] = left[at] + (x > threshold[at])
    return node


def _ordered(row, place, value):
    order = np.lexsort((place, row))
    live = order[value[order] != 0]
    return row[live], place[live], value[live]


def best_splits(keys: np.ndarray, weights: np.ndarray, totals: np.ndarray, bins: int) -> tuple[np.ndarray, ...]:
    """(group, gain in Gini impurity times weight, last bin of the left side, class weights of the left side) of sorted counts.

    A key is (group * (bins + 1) + bin) * classes + class, a group one feature of one node; `totals` has the node's class weights by group. Bin 0 are the zeros.
    """
    classes = totals.shape[1]
    width = (bins + 1) * classes
    groups, at = np.unique(keys // width, return_inverse=True)
    gains, cuts, lefts = np.zeros(len(groups)), np.zeros(len(groups), np.int64), np.zeros((len(groups), classes))
    step = max(1, (1 << 20) // width)
    for lo in range(0, len(groups), step):
        own = slice(*np.searchsorted(at, [lo, lo + step]))
        n = min(step, len(groups) - lo)
        table = np.bincount((at[own] - lo) * width + keys[own] % width, weights[own], n * width).reshape(n, bins + 1, classes)
        total = totals[groups[lo : lo + n]]
        table[:, 0] = np.maximum(total - table.sum(1), 0.0)
        left = np.cumsum(table, axis=1)[:, :-1]
        right = total[:, None] - left
        a, b = left.sum(2), right.sum(2)
        with np.errstate(all="ignore"):
            gain = np.where((a > 1e-9) & (b > 1e-9), (left**2).sum(2) / a + (right**2).sum(2) / b - ((total**2).sum(1) / total.sum(1))[:, None], 0.0)
        cut, line = gain.argmax(1), np.arange(n)
        gains[lo : lo + n], cuts[lo : lo + n], lefts[lo : lo + n] = gain[line, cut], cut, left[line, cut]
    return groups, gains, cuts, lefts


def _added(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, their weights summed."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(weights), minlength=len(key)).astype(float)  # of nothing, NumPy's sum is an integer


def _packed(rows: DataFrame, edges: np.ndarray, size: int) -> DataFrame:
    """Blocks of rows (x, label, h), each column the bytes of one array: label, h, and for each entry its place row * size + feature and its bin."""
    length, wide = max(1, min(1000, CELLS // size)), np.uint8 if len(edges) < 255 else np.uint16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, length):
                batch = whole.slice(lo, length)
                row, place, value = _sparse(batch.column(0))
                live = np.flatnonzero(value)
                bin_ = (1 + np.searchsorted(edges, value[live], "left")).astype(wide)
                at = (row[live] * size + place[live]).astype(np.int64 if size > CELLS else np.int32)
                parts = [batch.column(1).to_numpy().astype(np.int32), batch.column(2).to_numpy().astype(np.int64), at, bin_]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["label", "h", "place", "bin"])

    return settle(rows.mapInArrow(pack, "label binary, h binary, place binary, bin binary"))


def fit_forest(train: DataFrame, trees: int = 100, max_depth: int = 30, seed: int = 42, bins: int = 16, tries: int = 4, share: float | None = None) -> Forest:
    """Fit (features, label, ...); rows are told apart by their other columns. Values are cut at common quantiles of the non-zero ones.

    `share` of the features are looked at in a node, 1 / root of their number unless given.
    """
    names = [c for c in train.columns if c != "features"]
    rows = settle(train.select(F.unwrap_udt("features").alias("x"), F.col("label").cast("int").alias("label"), F.xxhash64(*names).alias("h")))
    about = rows.agg(F.max("label").alias("k"), F.max("x.size").alias("d"), F.max(F.size("x.values")).alias("dense")).first()
    classes, size = about.k + 1, max(about.d or 0, about.dense or 0, 1)
    values = rows.select(F.explode("x.values").alias("v")).where("v <> 0")
    edges = np.unique(values.approxQuantile("v", [k / bins for k in range(1, bins)], 0.001)) if bins > 1 else np.zeros(0)
    forest, spark = Forest(trees, classes, size), train.sparkSession
    context, blocks = spark.sparkContext, _packed(rows, edges, size)
    active, attempt = forest.root.copy(), np.zeros(trees, np.int64)
    tree_of, depth_of, cut_of = np.arange(trees), np.zeros(trees, np.int64), np.zeros(trees, np.int64)  # cut_of: last bin of the left side
    rate_of = lambda looks: np.minimum(1.0, 4.0**looks * (share or 1 / math.sqrt(size)))

    def looked_at(nodes: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features that nodes look at, node after node, and where each node's begin."""

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = _mixed(np.arange(size) + seed)
            for batch in batches:
                slots = batch.column(0).to_numpy()
                found = [np.flatnonzero(_share((nodes[k : k + 1].astype(np.uint64) << np.uint64(32)) + places) < rate[k]).astype(np.int32).tobytes() for k in slots]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["slot", "features"])

        parts = max(1, min(context.defaultParallelism, len(nodes) * size >> 22))
        drawn = sorted(spark.range(0, len(nodes), 1, parts).mapInArrow(draw, "slot long, features binary").collect())
        features = [np.frombuffer(r.features, np.int32) for r in drawn]
        return np.concatenate(features), np.cumsum([0, *map(len, features)])

    def scan(nodes: np.ndarray, looks: np.ndarray):
        """Class totals of the nodes, and their best splits as {slot: (feature, bin, class weights of the left side)}."""
        slot_of = np.full(len(forest.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))
        sent = context.broadcast((forest.feature, cut_of, forest.left, slot_of, np.unique(tree_of[nodes]), *looked_at(nodes, rate_of(looks))))
        run = -(-len(nodes) // (4 * context.defaultParallelism))  # nodes whose counts meet in one task

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feature, cut, left, slot_of, used, looked, start = sent.value
            totals, keys, weights, room = np.zeros((len(start) - 1) * classes), [], [], KEYS
            salt = _mixed(np.array([seed * 100_003 + t for t in used.tolist()]))

            def one(label: np.ndarray, h: np.ndarray, cells: np.ndarray) -> None:
                weight = np.searchsorted(DRAWS, _share(h[:, None] ^ salt[None, :]))
                row, tree = np.nonzero(weight)  # row after row: its bins stay in the cache
                node, going = used[tree], np.arange(len(row))
                while len(going := going[feature[node[going]] >= 0]):
                    at = node[going]
                    node[going] = left[at] + (cells[row[going] * size + feature[at]] > cut[at])
                slot = slot_of[node]
                live = np.flatnonzero(slot >= 0)
                slot, row, weight = slot[live], row[live], weight[row[live], tree[live]]
                totals[:] += np.bincount(slot * classes + label[row], weight, len(totals))
                many = start[slot + 1] - start[slot]
                ends, lo = np.cumsum(many), 0
                while lo < len(slot):
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - many[lo] + (1 << 17))))
                    n = many[lo:hi]
                    which = np.repeat(np.arange(lo, hi), n)
                    f = looked[np.arange(len(which)) + np.repeat(start[slot[lo:hi]] - (np.cumsum(n) - n), n)]
                    b = cells[np.repeat(row[lo:hi] * size, n) + f]
                    hit = np.flatnonzero(b)
                    k = which[hit]
                    keys.append(((slot[k] * size + f[hit]) * (bins + 1) + b[hit]) * classes + label[row[k]])
                    weights.append(weight[k])
                    lo = hi

            for batch in batches:
                for k in range(batch.num_rows):
                    label, h, place, bin_ = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in enumerate((np.int32, np.uint64, np.int64 if size > CELLS else np.int32, np.uint8 if len(edges) < 255 else np.uint16)))
                    cells = np.zeros(len(label) * size, bin_.dtype)
                    cells[place] = bin_
                    one(label, h, cells)
                    if sum(map(len, keys)) > room:
                        keys, weights = ([x] for x in _added(keys, weights))
                        room = max(KEYS, 2 * len(keys[0]))
            key, weight = _added(keys, weights) if keys else (np.zeros(0, np.int64), np.zeros(0))
            ends = np.searchsorted(key, np.arange(0, len(start) - 1 + run, run) * size * (bins + 1) * classes)
            for k, lo in enumerate(range(0, len(start) - 1, run)):
                own = slice(ends[k], ends[k + 1])
                parts = [x.tobytes() for x in (totals[lo * classes : (lo + run) * classes], key[own], weight[own])]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], ["run", "totals", "keys", "weights"])

        def choose(table: pa.Table) -> pa.Table:
            totals, keys, weights = ([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)] for c, kind in (("totals", np.float64), ("keys", np.int64), ("weights", np.float64)))
            total, first = np.sum(totals, axis=0).reshape(-1, classes), int(table.column("run")[0].as_py()) * run
            key, weight = _added(keys, weights)
            width, nodes_here = size * (bins + 1) * classes, len(total)
            key = key - first * width
            group = np.unique(key // ((bins + 1) * classes))
            place = np.searchsorted(group, key // ((bins + 1) * classes))
            _, gain, cut, left = best_splits(place * (bins + 1) * classes + key % ((bins + 1) * classes), weight, total[group // size], bins)
            near = np.round(gain, 9)
            order = np.lexsort((cut, group % size, -near, group // size))  # the best of a node comes first; ties go to the smaller feature
            order = order[gain[order] > 1e-9]
            slot, at = np.unique(group[order] // size, return_index=True)
            best = order[at]
            out = [[0.0, -1, 0, [0.0] * classes] for _ in range(nodes_here)]
            for s, k in zip(slot.tolist(), best.tolist(), strict=True):
                out[s] = [float(gain[k]), int(group[k] % size), int(cut[k]), left[k].tolist()]
            return pa.table({
                "slot": pa.array(np.arange(first, first + nodes_here), pa.int64()), "total": pa.array(total.tolist(), pa.list_(pa.float64())), "feature": pa.array([o[1] for o in out], pa.int64()),
                "bin": pa.array([o[2] for o in out], pa.int64()), "left": pa.array([o[3] for o in out], pa.list_(pa.float64()))})

        parts = blocks.mapInArrow(count, "run int, totals binary, keys binary, weights binary")
        with freed_shuffles(spark):
            chosen = parts.groupBy("run").applyInArrow(choose, "slot long, total array<double>, feature long, bin long, left array<double>").collect()  # a row per node
        sent.unpersist()
        totals = np.zeros((len(nodes), classes))
        for r in chosen:
            totals[r.slot] = r.total
        return totals, {r.slot: (r.feature, r.bin, r.left) for r in chosen if r.feature >= 0}

    while len(active):
        following, looks, lo = [], [], 0
        wanted = np.cumsum(rate_of(attempt) * size)
        while lo < len(active):
            hi = max(lo + 1, min(lo + SLOTS, int(np.searchsorted(wanted, (wanted[lo - 1] if lo else 0.0) + LOOKS))))
            nodes, attempts = active[lo:hi], attempt[lo:hi]
            totals, splits = scan(nodes, attempts)
            forest.weights[nodes] = totals
            mixed = (totals > 0).sum(1) > 1
            found = np.array(sorted(splits), np.int64)
            if len(found):
                split = [splits[k] for k in found.tolist()]
                children = forest.grow(nodes[found], np.array([f for f, _, _ in split]), np.array([edges[b - 1] if b else 0.0 for _, b, _ in split]))
                tree_of, depth_of = np.append(tree_of, np.repeat(tree_of[nodes[found]], 2)), np.append(depth_of, np.repeat(depth_of[nodes[found]] + 1, 2))
                cut_of = np.append(cut_of, np.zeros(len(children), np.int64))
                cut_of[nodes[found]] = [b for _, b, _ in split]
                left = np.array([x for _, _, x in split])
                forest.weights[children[::2]], forest.weights[children[1::2]] = left, totals[found] - left
                following.append(children[((forest.weights[children] > 0).sum(1) > 1) & (depth_of[children] < max_depth)])  # the others are leaves
                looks.append(np.zeros(len(following[-1]), np.int64))
            again = [k for k in range(len(nodes)) if mixed[k] and k not in splits and attempts[k] + 1 < tries]
            following.append(nodes[again])
            looks.append(attempts[again] + 1)
            lo = hi
        active, attempt = np.concatenate(following), np.concatenate(looks)
    return forest
