"""Exact k nearest neighbours by cosine, and other all-against-all measures, in bounded blocks.

A two-level tree of pivots cuts the rows into cells: a row goes to its nearest top pivot and there to its nearest fine one, so it is compared with
about twice the root of their number. There is a pivot for every few rows, up to a fixed number. For every cell of queries an upper bound on the distance of its k-th neighbour follows from the cell radii (triangle
inequality on unit vectors). Cells of one top pivot make a group; groups that lie side by side travel together as a load that fills a task
(`BLOCK_BYTES`). A corpus row travels once to each load it can still reach, found by going down the tree, and is compared there with the groups it
can reach. A cell full of copies is cut into several parts, and a load that many corpus rows reach takes them in several parts; a task returns
k rows per query, never pairs. Pivots decide the speed only, never the result. Without structure every load is in reach: the work is then
quadratic, with one copy of a row per load.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from driftline.operators.embedding import as_matrix
from driftline.operators.ranking import sample_rows, stratified_folds
from driftline.session import settle

MAX_CELLS = 1 << 16  # pivots are brought to the driver and sent to all tasks: 32 MB for 64 dimensions
CELL_ROWS = 8  # rows per pivot
BLOCK_BYTES = 32 << 20  # vectors of one side in a task
TILE = 2048  # rows of each side whose similarities are held at once
SLACK = 1e-6
DIGITS = 9  # similarities closer than this are ties and go to the smaller id


def _lift(x: np.ndarray, query: bool) -> np.ndarray:
    """Unit vectors in two extra dimensions; zero vectors become unit vectors orthogonal to everything they meet."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    extra = np.zeros((len(x), 2))
    extra[size[:, 0] == 0, 1 if query else 0] = 1.0
    return np.hstack([unit, extra])


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _slot(ids: pa.Array, n: int) -> np.ndarray:
    """A stable block number per id."""
    if pa.types.is_integer(ids.type):
        v = ids.to_numpy(zero_copy_only=False).astype(np.uint64)
        v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((v ^ (v >> np.uint64(33))) % np.uint64(n)).astype(np.int32)
    return np.array([zlib.crc32(str(v).encode()) % n for v in ids.to_pylist()], dtype=np.int32)


def _chain(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which each is followed by the nearest of those left."""
    gap, at, left, out = _gap(x, x), 0, np.ones(len(x), bool), []
    for _ in range(len(x)):
        out.append(at)
        left[at] = False
        at = int(np.where(left, gap[at], np.inf).argmin())
    return np.array(out)


class PivotTree:
    """Fine pivots in order of the top pivot they belong to."""

    def __init__(self, sample: np.ndarray):
        lifted = _lift(sample, False)
        tops = lifted[: math.isqrt(len(lifted) - 1) + 1]
        owner = _gap(lifted, tops).argmin(axis=1)
        order = np.argsort(owner, kind="stable")
        used, first = np.unique(owner[order], return_index=True)
        line = _chain(tops[used])  # neighbours of a top pivot come next to it
        ends = np.append(first, len(order))
        order = np.concatenate([order[ends[t] : ends[t + 1]] for t in line])
        used, first = used[line], np.cumsum(np.append(0, np.diff(ends)[line]))[:-1]
        self.fine, self.tops, self.start = lifted[order], tops[used], np.append(first, len(lifted))
        self.arm = np.concatenate([_gap(self.tops[t : t + 1], self.fine[self.start[t] : self.start[t + 1]])[0] for t in range(len(self.tops))])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of every row and its distance from the pivot."""
        top = _gap(x, self.tops).argmin(axis=1)
        cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for t in np.unique(top):
            own = np.flatnonzero(top == t)
            gap = _gap(x[own], self.fine[self.start[t] : self.start[t + 1]])
            at = gap.argmin(axis=1)
            cell[own], far[own] = self.start[t] + at, gap[np.arange(len(own)), at]
        return cell, far


def _cell_stats(df: DataFrame, tree, query: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and radius of every cell; at most a row per cell reaches the driver."""

    def run(batches):
        n = len(tree.value.fine)
        rows, radius = np.zeros(n, np.int64), np.zeros(n)
        for table in batches:
            x = as_matrix(table.column(1))
            if len(x):
                cell, far = tree.value.cells(_lift(x, query))
                np.add.at(rows, cell, 1)
                np.maximum.at(radius, cell, far)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32), "rows": rows[at], "radius": radius[at]})

    parts = df.mapInArrow(run, "cell int, rows bigint, radius double")
    rows, radius = np.zeros(len(tree.value.fine), np.int64), np.zeros(len(tree.value.fine))
    for r in parts.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius")).collect():
        rows[r["cell"]], radius[r["cell"]] = r["rows"], r["radius"]
    return rows, radius


class Groups:
    """How far corpus rows of each query cell may lie, and which task works on it."""

    def __init__(self, spark, tree, queries, corpus, need: int, block_rows: int):
        (self.rows, radius), (count, rad) = queries, corpus
        known = spark.sparkContext.broadcast((self.rows, radius, count, rad))

        def plan(batches):
            rows, radius, count, rad = known.value
            fine, held = tree.value.fine, np.flatnonzero(count)
            for batch in batches:
                for lo in batch.column(0).to_pylist():
                    own = lo + np.flatnonzero(rows[lo : lo + 64])
                    gap = _gap(fine[own], fine[held])
                    upper = gap + radius[own, None] + rad[held]
                    order = np.argsort(upper, axis=1)
                    enough = (np.cumsum(count[held][order], axis=1) < need).sum(axis=1)
                    line = np.arange(len(own))
                    theta = np.where(enough < len(held), upper[line, order[line, np.minimum(enough, len(held) - 1)]], 2.0)
                    reach = np.minimum(theta, 2.0) + radius[own] + SLACK
                    met = ((gap - rad[held] <= reach[:, None]) * count[held]).sum(axis=1)
                    yield pa.RecordBatch.from_pydict({"cell": own.astype(np.int32), "reach": reach, "met": met})

        self.reach, met = np.full(len(self.rows), -1.0), np.zeros(len(self.rows), np.int64)
        for r in spark.range(0, len(self.rows), 64).mapInArrow(plan, "cell int, reach double, met bigint").collect():  # a row per cell
            self.reach[r["cell"]], met[r["cell"]] = r["reach"], r["met"]
        # Cells of one top pivot, one after the other, until a group is full; groups, one after the other, until a load is full.
        self.group, sizes, total = np.full(len(self.rows), -1, np.int64), [], int(count.sum())
        self.start = start = tree.value.start
        for t in range(len(start) - 1):
            held = 0
            for cell in range(start[t], start[t + 1]):
                if not self.rows[cell]:
                    continue
                if not held or held + self.rows[cell] > block_rows:
                    sizes.append([0, 0])
                    held = 0
                held += int(self.rows[cell])
                self.group[cell] = len(sizes) - 1
                sizes[-1] = [held, min(total, sizes[-1][1] + int(met[cell]))]
        self.load, self.parts, held, room = np.zeros(len(sizes), np.int64), [], 0, 0
        for g, (rows_, met_) in enumerate(sizes):
            if not held or held + rows_ > block_rows:
                self.parts.append([0, 0])
                held = room = 0
            held, room = held + rows_, min(total, room + met_)
            self.load[g] = len(self.parts) - 1
            self.parts[-1] = [math.ceil(held / block_rows), max(1, math.ceil(room / block_rows))]
        self.bound = np.array([max((self.reach[start[t] : start[t + 1]] + tree.value.arm[start[t] : start[t + 1]])[self.rows[start[t] : start[t + 1]] > 0], default=-1.0)
                               for t in range(len(start) - 1)])
        owners = np.array([(self.group[c], t) for t in range(len(start) - 1) for c in range(start[t], start[t + 1]) if self.rows[c]], np.int64).reshape(-1, 2)
        self.top = np.zeros(len(sizes), np.int64)  # the top pivot of a group
        self.top[owners[:, 0]] = owners[:, 1]

    def near(self, x: np.ndarray, gap: np.ndarray, tree: PivotTree, group: int) -> np.ndarray:
        """Which rows of x some query of the group may need; `gap` are their distances from the top pivots."""
        t, out = self.top[group], np.zeros(len(x), bool)
        some = np.flatnonzero(gap[:, t] <= self.bound[t] + SLACK)
        cells = self.start[t] + np.flatnonzero(self.group[self.start[t] : self.start[t + 1]] == group)
        out[some] = (_gap(x[some], tree.fine[cells]) <= self.reach[cells]).any(axis=1)
        return out

    def reached(self, x: np.ndarray, tree: PivotTree):
        """(load, row numbers of x that some query of the load may need), load by load."""
        gap = _gap(x, tree.tops)
        for load in range(len(self.parts)):
            need = np.zeros(len(x), bool)
            for g in np.flatnonzero(self.load == load):
                left = np.flatnonzero(~need)
                need[left] = self.near(x[left], gap[left], tree, g)
            if need.any():
                yield load, np.flatnonzero(need)


def _scatter(df: DataFrame, id_type, tree, groups, query: bool) -> DataFrame:
    """Send each row to the tasks that need it: a query to all parts of its group, a corpus row to its part of every group in reach."""
    single = df.schema["vec"].dataType == ArrayType(FloatType()) or df.schema["vec"].dataType == ArrayType(FloatType(), False)
    wire = pa.list_(pa.float32() if single else pa.float64())
    schema = StructType([
        StructField("load", IntegerType()), StructField("qb", IntegerType()), StructField("cb", IntegerType()), StructField("own", IntegerType()),
        StructField("id", id_type), StructField("vec", ArrayType(FloatType() if single else DoubleType())),
    ])

    def emit(table, rows, load, qb, cb, own):
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(np.asarray(v, np.int32), rows.shape)) for v in (load, qb, cb, own)]
            + [table.column(0).take(take), table.column(1).take(take).cast(wire)],
            names=["load", "qb", "cb", "own", "id", "vec"],
        )

    def run(batches):
        plan = groups.value
        for table in batches:
            x = as_matrix(table.column(1))
            if not len(x):
                continue
            x = _lift(x, query)
            own = plan.group[tree.value.cells(x)[0]] if query else np.full(len(x), -1)
            load = plan.load[own] if query else None
            for g, rows in ((int(g), np.flatnonzero(load == g)) for g in np.unique(load)) if query else plan.reached(x, tree.value):
                q_blocks, c_blocks = plan.parts[g]
                slot = _slot(table.column(0).take(pa.array(rows)), q_blocks if query else c_blocks)
                for other in range(c_blocks if query else q_blocks):
                    yield emit(table, rows, g, slot, other, own[rows]) if query else emit(table, rows, g, other, slot, own[rows])

    return df.mapInArrow(run, schema)


def _best(sims: np.ndarray, q_at: np.ndarray, ids: np.ndarray, k: int):
    """Row, column of the k best entries per row: higher similarity first, then smaller id. Columns are in id order."""
    n, m = sims.shape
    if m > k:
        cut = np.partition(sims, m - k, axis=1)[:, m - k]
        row, col = np.nonzero(sims >= cut[:, None])
    else:
        row, col = np.divmod(np.arange(n * m), m)
    order = np.lexsort((col, -sims[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(n))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def index(q: DataFrame, c: DataFrame, need: int, block_rows: int | None = None):
    """Pivot tree of the corpus rows (id, vec) and task groups of the queries, both broadcast; (None, None) without corpus rows.

    Unless given, the rows of a block follow from `BLOCK_BYTES`, less where there are too few rows to keep all cores busy.
    """
    sc = q.sparkSession.sparkContext
    size = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    picked = sample_rows(c, int(min(MAX_CELLS, -(-size["n"] // CELL_ROWS))), "id").collect() if size["n"] else []
    if not picked:
        return None, None
    tree = sc.broadcast(PivotTree(np.array([r["vec"] for r in picked], dtype=np.float64)))
    q_cells, c_cells = _cell_stats(q, tree, True), _cell_stats(c, tree, False)
    if block_rows is None:
        spread = math.ceil(max(q_cells[0].sum(), c_cells[0].sum()) / sc.defaultParallelism)
        block_rows = max(1, min(BLOCK_BYTES // (8 * ((size["d"] or 0) + 2)), max(512, spread)))
    return tree, sc.broadcast(Groups(q.sparkSession, tree, q_cells, c_cells, need, block_rows))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, corpus_id: str, query_vec: str = "embedding",
            corpus_vec: str = "embedding", exclude_same_id: bool = False, block_rows: int | None = None) -> DataFrame:
    """Exact k nearest corpus rows of every query: (query_id, neighbour_id, similarity, rank).

    Similarities equal to 9 places are ties and go to the smaller id.
    """
    spark = queries.sparkSession
    q = queries.filter(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("id"), F.col(query_vec).alias("vec"))
    c = corpus.filter(F.col(corpus_vec).isNotNull()).select(F.col(corpus_id).alias("id"), F.col(corpus_vec).alias("vec"))
    id_type, other_type = q.schema["id"].dataType, c.schema["id"].dataType
    out_schema = StructType([StructField("query_id", id_type), StructField("neighbour_id", other_type), StructField("similarity", DoubleType())])
    tree, groups = index(q, c, k + (1 if exclude_same_id else 0), block_rows)
    if groups is None:
        return spark.createDataFrame([], out_schema).withColumn("rank", F.lit(1))
    left, right = _scatter(q, id_type, tree, groups, True), _scatter(c, other_type, tree, groups, False)

    def match(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if not qt.num_rows or not ct.num_rows:
            return pa.table({"query_id": qt.column("id")[:0], "neighbour_id": ct.column("id")[:0], "similarity": pa.array([], pa.float64())})
        ct = ct.sort_by("id")
        a, b = _lift(as_matrix(qt.column("vec")), True), _lift(as_matrix(ct.column("vec")), False)
        q_ids = qt.column("id").to_pylist() if exclude_same_id else None
        c_ids = {v: i for i, v in enumerate(ct.column("id").to_pylist())} if exclude_same_id else {}
        same = np.array([c_ids.get(v, -1) for v in q_ids]) if exclude_same_id else None
        own, gap, rows, cols, vals = qt.column("own").to_numpy(), _gap(b, tree.value.tops), [], [], []
        for g in np.unique(own):
            mine, near = np.flatnonzero(own == g), np.flatnonzero(groups.value.near(b, gap, tree.value, int(g)))
            for top in range(0, len(mine) if len(near) else 0, TILE):
                line, found = mine[top : top + TILE], []
                for lo in range(0, len(near), TILE):
                    held = near[lo : lo + TILE]
                    sims = np.round(a[line] @ b[held].T, DIGITS) + 0.0
                    if exclude_same_id:
                        at = np.searchsorted(held, same[line])
                        hit = np.flatnonzero(held[np.minimum(at, len(held) - 1)] == same[line])
                        sims[hit, at[hit]] = -np.inf
                    r, col = _best(sims, None, None, k)
                    live = np.isfinite(sims[r, col])
                    found.append((r[live], held[col[live]], sims[r, col][live]))
                r, col, v = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((col, -v, r))
                r, col, v = r[order], col[order], v[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                rows.append(line[r[keep]]); cols.append(col[keep]); vals.append(v[keep])
        r, col, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, vals))
        return pa.table({
            "query_id": qt.column("id").take(pa.array(r)), "neighbour_id": ct.column("id").take(pa.array(col)),
            "similarity": pa.array(v, pa.float64()),
        })

    parts = left.groupBy("load", "qb", "cb").cogroup(right.groupBy("load", "qb", "cb")).applyInArrow(match, out_schema)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "neighbour_id")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_neighbour(df: DataFrame, id_col: str, vec: str = "embedding") -> DataFrame:
    """Nearest other row of every row."""
    out = nearest(df, df, 1, id_col, id_col, vec, vec, exclude_same_id=True)
    return out.select(F.col("query_id").alias(id_col), F.col("neighbour_id").alias("neighbour"), "similarity")


def knn_classify(train: DataFrame, test: DataFrame, id_col: str, label: str, k: int = 5, vec: str = "embedding",
                 weights: str = "uniform") -> DataFrame:
    """Majority label of the k nearest training rows; ties go to the smallest label.

    `weights="distance"` weighs votes by 1 / (1 - cosine).
    """
    near = nearest(test, train, k, id_col, id_col, vec, vec)
    votes = near.join(train.select(F.col(id_col).alias("neighbour_id"), F.col(label).alias("__l")), "neighbour_id")
    weight = F.lit(1.0) if weights == "uniform" else 1 / F.greatest(1 - F.col("similarity"), F.lit(1e-12))
    tally = votes.groupBy("query_id", "__l").agg(F.sum(weight).alias("w"))
    best = tally.groupBy("query_id").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("__l"))).alias("b"))
    return best.select(F.col("query_id").alias(id_col), F.col("b.__l").alias("prediction"))


def knn_cross_validate(df: DataFrame, id_col: str, label: str, k: int = 5, folds: int | None = None, vec: str = "embedding") -> DataFrame:
    """Accuracy of the k-NN vote per stratified fold: min(5, number of classes) folds unless given."""
    folds = folds or min(5, df.select(label).distinct().count())
    rows = settle(stratified_folds(df.select(id_col, label, vec), label, id_col, folds))
    parts = []
    for i in range(folds):
        held = rows.filter(F.col("fold") == i)
        out = knn_classify(rows.filter(F.col("fold") != i), held, id_col, label, k, vec).join(held.select(id_col, label), id_col)
        parts.append(out.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")).withColumn("fold", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def _own_similarity(q: DataFrame, c: DataFrame) -> DataFrame:
    """(id, own): the best similarity between a query and a corpus row of the same id; both sides are (id, vec)."""
    pairs = q.distinct().join(c.distinct().withColumnRenamed("vec", "other"), "id").select("id", "vec", "other")

    def run(batches):
        for table in batches:
            a, b = _lift(as_matrix(table.column(1)), True), _lift(as_matrix(table.column(2)), False)
            yield pa.RecordBatch.from_arrays([table.column(0), pa.array(np.round((a * b).sum(axis=1), DIGITS) + 0.0)], ["id", "own"])

    schema = StructType([pairs.schema["id"], StructField("own", DoubleType())])
    return pairs.mapInArrow(run, schema).where(~F.isnan("own")).groupBy("id").agg(F.max("own").alias("own"))


def _rows_before(q: DataFrame, c: DataFrame, most: int, block_rows: int | None = None, shares: tuple[int, ...] = (2, 20, 100)) -> DataFrame:
    """(id, before): corpus rows (id, vec) that come before the own row of a query (id, vec, own); a count of `most` or more may be short.

    Blocks of queries meet blocks of the corpus, in as many rounds as there are `shares` (percent of the corpus); a query that has enough
    rows before it leaves. Products are in single precision where that decides, in double precision where it is too close.
    """
    spark = q.sparkSession
    cut = F.pmod(F.xxhash64("id", "vec"), F.lit(100))
    dims = c.agg(F.max(F.size("vec"))).first()[0] or 0
    fits = max(1, BLOCK_BYTES // (8 * (dims + 2)))
    q, c, total = settle(q), settle(c.withColumn("cut", cut)), None
    schema = StructType([q.schema["id"], StructField("before", LongType())])

    def count(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if not qt.num_rows or not ct.num_rows:
            return pa.table([qt.column("id")[:0], pa.array([], pa.int64())], ["id", "before"])
        ct = ct.sort_by("id")  # null ids come last
        known = ct.column("id").drop_null()
        at = known.to_numpy() if pa.types.is_integer(known.type) else np.array(known.to_pylist(), object)
        ask = qt.column("id").to_numpy() if pa.types.is_integer(known.type) else np.array(qt.column("id").to_pylist(), object)
        first, last = (np.searchsorted(at, ask, side) for side in ("left", "right"))  # rows of the same id
        a, b, own, n = _lift(as_matrix(qt.column("vec")), True), _lift(as_matrix(ct.column("vec")), False), qt.column("own").to_numpy(), np.zeros(len(qt), np.int64)
        a32, b32 = a.astype(np.float32), b.astype(np.float32)
        # Twice what a product of unit vectors in single precision may be off; only rows with something this close to their own are multiplied again.
        off = 10.0**-DIGITS + (a.shape[1] + 8) * 2.0**-23
        least, sure = ((own + x).astype(np.float32)[:, None] for x in (-off, off))
        for top in range(0, len(a), TILE):
            line = np.arange(top, min(top + TILE, len(a)))
            for lo in range(0, len(b), TILE):
                sims = a32[line] @ b32[lo : lo + TILE].T
                some = np.count_nonzero(sims > least[line], axis=1)
                held = np.flatnonzero(some)
                ahead = np.zeros(len(line), np.int64)
                ahead[held] = np.count_nonzero(sims[held] > sure[line[held]], axis=1)  # never rows of the query's id: its own is the best of them
                n[line] += np.where(some > ahead, 0, ahead)
                near = line[some > ahead]
                sims = a[near] @ b[lo : lo + TILE].T
                r, col = np.nonzero(sims > (own[near] - 10.0**-DIGITS)[:, None])
                s, col, r = np.round(sims[r, col], DIGITS) + 0.0, col + lo, near[r]
                before = ((s > own[r]) & ((col < first[r]) | (col >= last[r]))) | ((s == own[r]) & (col < first[r]))
                n[line] += np.bincount(r[before] - top, minlength=TILE)[line - top]
                line = line[n[line] < most]
                if not len(line):
                    break
        return pa.table([qt.column("id"), pa.array(n)], ["id", "before"])

    lo = 0
    for hi in shares:
        part = c.where((F.col("cut") >= lo) & (F.col("cut") < hi)).select("id", "vec")
        sizes = [q.count(), part.count()]
        if not sizes[0]:
            break
        room = block_rows or min(fits, max(TILE, math.isqrt(sizes[0] * sizes[1] // (4 * spark.sparkContext.defaultParallelism))))
        blocks = [max(1, math.ceil(n / room)) for n in sizes]
        slot = [F.pmod(F.xxhash64(F.lit(hi), "id", "vec"), F.lit(n)).cast("int") for n in blocks]
        every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
        left = q.withColumn("qb", slot[0]).withColumn("cb", every[1])
        right = part.withColumn("cb", slot[1]).withColumn("qb", every[0])
        found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(count, schema).where("before > 0")
        total = settle((found if total is None else total.unionByName(found)).groupBy("id").agg(F.sum("before").alias("before")))
        q, lo = q.join(total.where(F.col("before") >= most), "id", "left_anti"), hi
    return spark.createDataFrame([], schema) if total is None else total


def retrieval_recall(queries: DataFrame, corpus: DataFrame, id_col: str, query_vec: str, corpus_vec: str,
                     ks: tuple[int, ...] = (1, 3, 5), min_rows: int = 5, compat: bool = False) -> DataFrame:
    """Share of queries whose own row is among their k nearest corpus rows; `compat` gives 0 for fewer than `min_rows` rows.

    A query's own similarity is known from its id, so its rank is one more than the corpus rows that come before it; those are counted, and counting
    stops at the largest k. A part of the corpus settles most of the queries whose own row is far down; the others meet the rest.
    """
    single = lambda f: f.dataType in (ArrayType(FloatType()), ArrayType(FloatType(), False))
    sides = [(df, df.schema[vec]) for df, vec in ((queries, query_vec), (corpus, corpus_vec))]
    wire = "array<float>" if all(single(f) for _, f in sides) else "array<double>"
    q, c = (df.where(F.col(f.name).isNotNull()).select(F.col(id_col).alias("id"), F.col(f.name).cast(wire).alias("vec")) for df, f in sides)
    own = settle(_own_similarity(q, c))
    before = _rows_before(q.join(own, "id"), c, max(ks))
    ids = q.select("id").distinct() if c.limit(1).count() else q.select("id").limit(0)
    hit = ids.join(own, "id", "left").join(before, "id", "left").select(F.when(F.col("own").isNotNull(), F.coalesce("before", F.lit(0)) + 1).alias("own"))
    n = F.count(F.lit(1))
    flags = hit.agg(n.alias("n"), *[F.avg(F.coalesce(F.col("own") <= k, F.lit(False)).cast("double")).alias(f"r{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), (F.when(F.col("n") < min_rows, 0.0).otherwise(F.col(f"r{k}")) if compat else F.col(f"r{k}")).alias("recall")) for k in ks])
    return flags.select(F.inline(rows))


def masked_self_recall(df: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Compatibility form: self matches are masked first, so a row can never retrieve itself and recall is 0.

    It becomes 1 only when k reaches the number of rows.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.when((F.col("n") >= 5) & (F.col("n") <= k), 1.0).otherwise(0.0).alias("recall")) for k in ks])
    return n.select(F.inline(rows))


def label_agreement(df: DataFrame, id_col: str, label: str, k: int = 5, vec: str = "embedding") -> DataFrame:
    """Share of each row's k nearest other rows that carry its label, averaged."""
    near = nearest(df, df, k, id_col, id_col, vec, vec, exclude_same_id=True)
    a = df.select(F.col(id_col).alias("query_id"), F.col(label).alias("__a"))
    b = df.select(F.col(id_col).alias("neighbour_id"), F.col(label).alias("__b"))
    same = (F.col("__a") == F.col("__b")).cast("double")
    rows = near.join(a, "query_id").join(b, "neighbour_id").groupBy("query_id").agg(F.avg(same).alias("s"))
    return rows.agg(F.avg("s").alias("agreement"))


def distance_sums(df: DataFrame, id_col: str, label: str, vec: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """Sum of Euclidean distances from every row to the rows of every label: (id, label, total, rows).

    There is no closed form for plain Euclidean distance, so this is quadratic work, in blocks; a task returns one row
    per (row, label), not per pair.
    """
    rows = df.filter(F.col(vec).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).alias("vec"))
    blocks = max(1, math.ceil(rows.count() / block_rows))
    slot = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.drop("label").withColumn("qb", slot).withColumn("cb", every)
    right = rows.withColumn("cb", slot).withColumn("qb", every).drop("id")

    def run(qt: pa.Table, ct: pa.Table) -> pa.Table:
        empty = {"id": pa.array([], qt.schema.field("id").type), "label": pa.array([], pa.string()), "total": pa.array([], pa.float64()), "rows": pa.array([], pa.int64())}
        if not qt.num_rows or not ct.num_rows:
            return pa.table(empty)
        a, b = as_matrix(qt.column("vec")), as_matrix(ct.column("vec"))
        codes = pc.dictionary_encode(ct.column("label").combine_chunks())
        names, code = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
        sums = np.zeros((len(a), len(names)))
        for lo in range(0, len(b), 1024):
            part = b[lo : lo + 1024]
            d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (part**2).sum(1)[None, :] - 2 * a @ part.T, 0.0))
            pick = np.zeros((len(part), len(names)))
            pick[np.arange(len(part)), code[lo : lo + 1024]] = 1.0
            sums += d @ pick
        per = np.bincount(code, minlength=len(names)).astype(np.int64)
        return pa.table({
            "id": qt.column("id").take(pa.array(np.repeat(np.arange(len(a)), len(names)))),
            "label": names.take(pa.array(np.tile(np.arange(len(names)), len(a)))),
            "total": pa.array(sums.ravel()), "rows": pa.array(np.tile(per, len(a))),
        })

    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("label", rows.schema["label"].dataType), StructField("total", DoubleType()), StructField("rows", LongType())])
    parts = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, schema)
    return parts.groupBy("id", "label").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
