"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine of at least `least` lie within eps = sqrt(2 - 2 * least) of each other. They are projected on their
leading principal directions, laid on a grid of side eps, and sorted by grid cell, first direction first. The sorted
sequence is cut into blocks of bounded size; blocks make intervals, intervals of intervals, up to one. The join goes
down from the whole sequence with itself: a pair of intervals is split into the pairs of their parts, and a pair whose bounding boxes lie
further apart than eps is dropped, since projecting never lengthens a distance. Block pairs that are left are compared by
matrix product, and pairs near the limit again component by component in double precision. They travel by tiles, runs of blocks: a task gets
the blocks of two tiles once and compares the block pairs among them.

Equal vectors are one class, compared once. A pair of tiles returns counts per vector and a few joining links per group,
not all pairs, so a group of thousands of near copies stays small.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing, and so do vectors of different
lengths. Null ids are left out; rows that repeat an id with the same vector are one, with different vectors the smallest counts.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from driftline.llm.components import components
from driftline.session import lookup, settle

BLOCK = 512  # vectors of a block
FAN = 8  # parts of an interval
TILE_BYTES = 16 << 20  # vectors of a tile, a run of blocks
LINKS = 1 << 20  # joining links that a task collects before it shortens them


def _units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    a = rows.astype(np.float64)
    a /= np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Lists of one length, without nulls, as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def unit_classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members (id, class; null if the vector links with nothing); classes (id, n, size, x), n members of the vector x.

    Vectors keep their width, single or double, until they are compared. Only vectors that several rows share are joined back to the rows.
    """
    x = F.col(vector_col)
    kind = "array<float>" if vectors.schema[vector_col].dataType.elementType == FloatType() else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.cast(kind).alias("x")).where("id is not null").groupBy("id").agg(F.min("x").alias("x"))
    sound = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = settle(rows.select("id", F.when(sound, F.col("x")).alias("x")))
    heads = rows.where("x is not null").groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = settle(heads.select("id", "n", F.size("x").alias("size"), "x"))
    shared = lookup(classes.where("n > 1").select("x", F.col("id").alias("class")))
    own = F.when(F.col("x").isNotNull(), F.col("id"))
    return rows.join(shared, "x", "left").select("id", F.coalesce("class", own).alias("class")), classes


def principal(classes: DataFrame, size: int, directions: int) -> np.ndarray:
    """The leading principal directions of the vectors of one length (a matrix of length x directions)."""

    def sums(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                m = np.hstack([_units(_matrix(batch.column(0), size)), np.ones((batch.num_rows, 1))])
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    parts = classes.where(F.col("size") == size).select("x").mapInArrow(sums, "row int, sums array<double>")
    rows = parts.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(size + 1)]).alias("sums")).collect()
    total = np.zeros((size + 1, size + 1))
    for r in rows:
        total[r.row] = r.sums
    n = max(total[size, size], 1)
    mean = total[size, :size] / n
    values, axes = np.linalg.eigh(total[:size, :size] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :directions])


def blocks_in_grid_order(classes: DataFrame, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """(part, k, ids, counts, xs, low, high): the vectors of one length in grid order, cut into blocks; box in the principal directions."""
    known = classes.sparkSession.sparkContext.broadcast(axes)
    size, m = axes.shape
    wire = classes.schema["x"].dataType

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(_units(_matrix(batch.column(2), size)) @ known.value / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], ["id", "n", "x", "cell"])

    # Cells are cheap to compute and computed twice, for the ranges and for the shuffle, rather than written out.
    placed = classes.select("id", "n", "x").mapInArrow(project, f"id long, n long, x {wire.simpleString()}, cell array<int>")
    parts = max(1, min(-(-classes.count() // (block * 4)), 1 << 14))
    # The id is part of the sort key, so that one cell with very many vectors still is cut.
    order = placed.repartitionByRange(parts, *[F.col("cell")[k] for k in range(m)], "id").sortWithinPartitions(*[F.col("cell")[k] for k in range(m)], "id")

    def cut(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        rest, k = [], 0
        for batch in batches:
            rest.append(batch.select(["id", "n", "x"]))
            table = pa.Table.from_batches(rest).combine_chunks()
            while table.num_rows >= block:
                yield one(part, k, table.slice(0, block))
                table, k = table.slice(block), k + 1
            rest = table.to_batches()
        if rest and sum(b.num_rows for b in rest):
            yield one(part, k, pa.Table.from_batches(rest).combine_chunks())

    def one(part, k, table):
        rows = _matrix(table.column(2).combine_chunks(), size)
        p = _units(rows) @ known.value
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([table.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([table.column(1).to_pylist()], pa.list_(pa.int64())),
            pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary()), pa.array([list(p.min(0))], pa.list_(pa.float64())), pa.array([list(p.max(0))], pa.list_(pa.float64()))],
            ["part", "k", "ids", "counts", "xs", "low", "high"])

    return settle(order.mapInArrow(cut, "part int, k int, ids array<long>, counts array<long>, xs binary, low array<double>, high array<double>"))


def near_intervals(boxes: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: block pairs whose boxes are within eps, found from the whole sequence downwards; boxes has (block, low, high)."""
    levels, total = [boxes.select(F.col("block").alias("at"), "low", "high")], boxes.count()
    width = len(boxes.first().low) if total else 0
    while total > 1:
        up = levels[-1].groupBy(F.floor(F.col("at") / FAN).alias("at")).agg(
            F.array(*[F.min(F.col("low")[k]) for k in range(width)]).alias("low"), F.array(*[F.max(F.col("high")[k]) for k in range(width)]).alias("high"))
        levels.append(settle(up))
        total = -(-total // FAN)
    pairs = levels[-1].select(F.col("at").alias("a"), F.col("at").alias("b"))
    gap = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    for level in reversed(levels[:-1]):
        part = lambda s: level.select(F.floor(F.col("at") / FAN).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("at", "low", "high")])  # noqa: B023, E731
        split = pairs.join(part("a"), "a").join(part("b"), "b").where("at_a <= at_b")
        pairs = settle(split.where(apart <= eps * eps * (1 + 1e-9) + 1e-12).select(F.col("at_a").alias("a"), F.col("at_b").alias("b")))
    return pairs


def compare_blocks(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of x, of y) of pairs with cosine of at least `least`; of one block with itself, each pair once."""
    cos = x @ y.T
    i, j = np.nonzero(cos >= least - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    close = np.abs(cos[i, j] - least) < 1e-9
    if close.any():  # the product's rounding may decide: sum again, exactly
        keep = np.ones(len(i), bool)
        for k in np.flatnonzero(close):
            a, b = x[i[k]], y[j[k]]
            keep[k] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= least
        i, j = i[keep], j[keep]
    return i, j


def _joining(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (id, smallest id of its group) that join what the links (a, b) join, one per id at most."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    group = np.arange(len(ids))
    while True:
        least = np.minimum(group[u], group[v])
        new = group.copy()
        np.minimum.at(new, group[u], least)  # hang the groups' heads on each other, then shorten the way to the head
        np.minimum.at(new, group[v], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, group):
            break
        group = new
    other = group != np.arange(len(ids))
    return ids[other], ids[group[other]]


def _requests(pairs: DataFrame, tile: int) -> DataFrame:
    """(block, to): each block once with all the tile pairs (ta, tb) that need it, and there the later blocks `with` that it has to meet."""
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    near = pairs.select("a", "b", at("a").alias("ta"), at("b").alias("tb"))
    first = near.groupBy("ta", "tb", F.col("a").alias("block")).agg(F.collect_list("b").alias("with"))
    second = near.select("ta", "tb", F.col("b").alias("block")).distinct().withColumn("with", F.array().cast("array<long>"))
    each = first.unionByName(second).groupBy("ta", "tb", "block").agg(F.flatten(F.collect_list("with")).alias("with"))
    return each.groupBy("block").agg(F.collect_list(F.struct("ta", "tb", "with")).alias("to"))


def links(classes: DataFrame, least: float = 0.95, directions: int = 8, block: int = BLOCK, tile_bytes: int = TILE_BYTES, tiles: int | None = None) -> DataFrame:
    """(kind, a, b, n): kind 0: vector a has n more links; kind 1: a joining link of a and b.

    Blocks that follow each other make tiles, and a task compares a pair of tiles: a block travels once to each tile pair that needs it, not to each
    block. Tile pairs are taken in rounds whose shuffle holds about twice the vectors, or `tile_bytes` a core; its files go with the round.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    cores = classes.sparkSession.sparkContext.defaultParallelism
    width = np.float32 if classes.schema["x"].dataType.elementType == FloatType() else np.float64
    out = []
    for r in classes.select("size").distinct().orderBy("size").collect():  # vector lengths: one in any sound table
        size = r.size
        own = classes.where(F.col("size") == size)
        axes = principal(own, size, min(directions, size))
        cut = blocks_in_grid_order(own, axes, eps, block)
        parts = cut.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).orderBy("part").collect()  # one row per partition
        first, so_far = [], 0
        for p in parts:
            first.append(F.struct(F.lit(p.part), F.lit(so_far)))
            so_far += p.n
        number = F.element_at(F.map_from_entries(F.array(*first)), F.col("part")) + F.col("k")
        cut = cut.withColumn("block", number.cast("long")).drop("part", "k")
        pairs = near_intervals(cut.select("block", "low", "high"), eps)
        data = sum(p.rows for p in parts) * (size * np.dtype(width).itemsize + 16)
        tile = -(-so_far // min(so_far, max(-(-data // tile_bytes), tiles or 2 * cores)))
        n_tiles = -(-so_far // tile)
        rounds = max(1, -(-n_tiles * data // max(2 * data, tile_bytes * cores)))
        sent = cut.select("block", "ids", "counts", "xs").join(lookup(_requests(pairs, tile)), "block")

        def compare(table: pa.Table) -> pa.Table:
            blocks, partners = table.column("block").to_pylist(), table.column("with").to_pylist()
            ids, counts = ([np.asarray(x.values) for x in table.column(c)] for c in ("ids", "counts"))
            units = [_units(np.frombuffer(x.as_buffer(), width).reshape(-1, size)) for x in table.column("xs")]
            at, more = {b: k for k, b in enumerate(blocks)}, [np.zeros(len(x), np.int64) for x in ids]
            joined, held, room = [], 0, LINKS
            for k, later in enumerate(partners):
                for m in (at[b] for b in later):
                    i, j = compare_blocks(units[k], units[m], least, k == m)
                    if not len(i):
                        continue
                    np.add.at(more[k], i, counts[m][j])
                    np.add.at(more[m], j, counts[k][i])
                    joined.append(_joining(ids[k][i], ids[m][j]))
                    held += len(joined[-1][0])
                    if held > room:  # one per vector at most is left
                        joined = [_joining(*(np.concatenate(x) for x in zip(*joined, strict=True)))]
                        held = len(joined[0][0])
                        room = LINKS + 2 * held
            who, n = np.concatenate(ids), np.concatenate(more)
            who, n = who[n > 0], n[n > 0]
            u, v = _joining(*(np.concatenate(x) for x in zip(*joined, strict=True))) if joined else (who[:0], who[:0])
            return pa.table([
                pa.array(np.r_[np.zeros(len(who), np.int8), np.ones(len(u), np.int8)]), pa.array(np.r_[who, u]), pa.array(np.r_[who, v]), pa.array(np.r_[n, np.zeros(len(u), np.int64)])],
                ["kind", "a", "b", "n"])

        for k in range(rounds):  # (ta + tb) deals the pairs of every tile evenly over the rounds
            wanted = sent.withColumn("to", F.filter("to", lambda t: (t["ta"] + t["tb"]) % rounds == k)).where("size(to) > 0")  # noqa: B023
            each = wanted.select("block", "ids", "counts", "xs", F.inline("to"))
            out.append(settle(each.groupBy("ta", "tb").applyInArrow(compare, "kind byte, a long, b long, n long")))
    if not out:
        return classes.select(F.lit(0).cast("byte").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), "n").limit(0)
    return reduce(DataFrame.unionByName, out)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, **options) -> DataFrame:
    """(id, n_links, component, kept) for every id: other vectors linked directly, smallest id reachable, whether it is that id."""
    members, classes = unit_classes(vectors, id_col, vector_col)
    found = links(classes, least, **options)
    more = found.where("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("more"))
    groups = components(found.where("kind = 1")).withColumnRenamed("id", "class")
    per = classes.select(F.col("id").alias("class"), "n").join(more, "class", "left").join(groups, "class", "left").select(
        "class", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    out = members.join(per, "class", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), (component == F.col("id")).alias("kept"))
