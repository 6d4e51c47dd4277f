"""Many k-means fits in the same passes: all starts, of one k or of several, take each Lloyd step together.

A step is one scan: every row is compared with the centres of all starts that still move, in one matrix product, and each task returns one sum
per centre. What the driver and the tasks hold is the centres of all starts, whose number is a parameter; rows never leave their partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.embedding import as_matrix

SLICE_CELLS = 4_000_000  # entries of a rows-by-centres matrix: 32 MB


@dataclass
class Fit:
    """The centres of one start, rows and squared distance per centre (of the last scan), and the steps taken."""

    centres: np.ndarray
    sizes: np.ndarray
    costs: np.ndarray
    steps: int = 0
    moving: bool = True

    @property
    def cost(self) -> float:
        return float(self.costs.sum())


def spread_starts(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of a sample, each chosen by its squared distance from those before, best of a few tries."""
    rng = np.random.default_rng(seed)
    picked = [sample[rng.integers(len(sample))]]
    left = ((sample - picked[0]) ** 2).sum(1)
    tries = 2 + int(np.log(k))
    while len(picked) < k:
        total = left.sum()
        at = rng.choice(len(sample), tries, p=left / total) if total > 0 else rng.integers(len(sample), size=tries)
        after = np.minimum(left, ((sample[None] - sample[at][:, None]) ** 2).sum(2))
        best = after.sum(1).argmin()
        picked.append(sample[at[best]])
        left = after[best]
    return np.array(picked)


def _slices(batches, width: int):
    for batch in batches:
        step = max(1, SLICE_CELLS // max(1, width))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0.0)


def _scan(rows: DataFrame, vec: str, fits: list[Fit]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sizes, costs, vector sums) per fit from one scan."""
    ends = np.cumsum([0, *[len(f.centres) for f in fits]])
    sent = rows.sparkSession.sparkContext.broadcast((np.vstack([f.centres for f in fits]), ends))

    def run(batches):
        centres, ends = sent.value
        n, cost, total = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(centres.shape)
        for batch in _slices(batches, len(centres)):
            x = as_matrix(batch.column(0))
            if not len(x):
                continue
            gap = _gaps(x, centres)
            for lo, hi in zip(ends, ends[1:]):
                best = gap[:, lo:hi].argmin(axis=1)
                n[lo:hi] += np.bincount(best, minlength=hi - lo)
                cost[lo:hi] += np.bincount(best, gap[np.arange(len(x)), lo + best], minlength=hi - lo)
                member = np.zeros((len(x), hi - lo))
                member[np.arange(len(x)), best] = 1.0
                total[lo:hi] += member.T @ x
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(cost[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["c", "n", "cost", "s"])

    parts = rows.select(vec).mapInArrow(run, "c int, n long, cost double, s array<double>")
    found = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect()
    n, cost, total = np.zeros(ends[-1], np.int64), np.zeros(ends[-1]), np.zeros(sent.value[0].shape)
    for r in found:  # a row per centre
        n[r["c"]], cost[r["c"]], total[r["c"]] = r["n"], r["cost"], r["s"]
    return [(n[lo:hi], cost[lo:hi], total[lo:hi]) for lo, hi in zip(ends, ends[1:])]


def fit_many(rows: DataFrame, vec: str, starts: list[np.ndarray], max_steps: int = 100, tolerance: float = 1e-4) -> list[Fit]:
    """Fit all starts; a fit rests when no centre moves further than `tolerance`. A centre without rows stays where it is."""
    fits = [Fit(np.asarray(s, float), np.zeros(len(s), np.int64), np.zeros(len(s))) for s in starts]
    for _ in range(max_steps):
        moving = [f for f in fits if f.moving]
        if not moving:
            break
        for f, (n, cost, total) in zip(moving, _scan(rows, vec, moving)):
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], f.centres)
            f.moving = bool((((new - f.centres) ** 2).sum(1) > tolerance**2).any())
            f.centres, f.steps = new, f.steps + 1
    for f, (n, cost, _) in zip(fits, _scan(rows, vec, fits)):  # of the final centres
        f.sizes, f.costs = n, cost
    return fits


def assigned(rows: DataFrame, id_col: str, vec: str, centres: np.ndarray, out: str) -> DataFrame:
    """(id, out): number of the nearest centre; a narrow pass."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(centres, float))

    def run(batches):
        for batch in _slices(batches, len(centres)):
            x = as_matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_gaps(x, sent.value).argmin(axis=1) if len(x) else np.zeros(0), pa.int32())], [id_col, out])

    return rows.select(id_col, vec).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, `{out}` int")


def silhouettes(rows: DataFrame, vec: str, fits: list[Fit]) -> list[float | None]:
    """Mean silhouette by squared Euclidean distance of every fit, in two scans for all; null where it is undefined.

    Distances to a cluster come from its size, vector sum and squared norms: sum |x - y|^2 = n |x|^2 - 2 x.S + Q.
    """
    sums = _scan(rows, vec, fits)
    # Q of a cluster: the squared distances from a centre c are Q - 2 c.S + n |c|^2.
    squares = [cost + 2 * (f.centres * s).sum(1) - n * (f.centres**2).sum(1) for f, (n, cost, s) in zip(fits, sums)]
    sent = rows.sparkSession.sparkContext.broadcast([(f.centres, n, s, q) for f, (n, _, s), q in zip(fits, sums, squares)])

    def run(batches):
        total, count = np.zeros(len(sent.value)), 0
        for batch in _slices(batches, max(len(v[1]) for v in sent.value)):
            x = as_matrix(batch.column(0))
            if not len(x):
                continue
            count += len(x)
            own, line = (x**2).sum(1)[:, None], np.arange(len(x))
            for k, (centres, n, s, q) in enumerate(sent.value):
                best = _gaps(x, centres).argmin(axis=1)
                away = np.maximum(n * own - 2 * x @ s.T + q, 0.0)
                with np.errstate(all="ignore"):
                    a = away[line, best] / (n[best] - 1)
                    mean = np.where(n > 0, away / n, np.inf)
                mean[line, best] = np.inf
                b = mean.min(axis=1)
                with np.errstate(all="ignore"):
                    value = np.where((n[best] < 2) | (np.maximum(a, b) == 0), 0.0, (b - a) / np.maximum(a, b))
                total[k] += value.sum()
        yield pa.RecordBatch.from_arrays([pa.array([list(total)], pa.list_(pa.float64())), pa.array([count], pa.int64())], ["total", "n"])

    one = rows.select(vec).mapInArrow(run, "total array<double>, n long").agg(
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("n").alias("n")).first()
    live = [(n > 0).sum() for n, _, _ in sums]
    return [one["total"][k] / one["n"] if 2 <= live[k] < one["n"] else None for k in range(len(fits))]
