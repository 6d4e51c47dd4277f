"""Linear SVM with squared hinge loss: every class against the rest, all in the same scans, by Newton steps.

Per class the objective is |w|^2 / 2 + C * sum of max(0, 1 - y (w . x))^2, with a constant 1 as last feature. A Newton step solves for its direction by
conjugate gradients; each product with the second derivative is one scan for all classes, and each task returns one sum per class and run of
features. The fits of a cross-validation go through the same scans. The driver holds the weights, fits times classes times features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import settle

RUN = 4096  # numbers of a sum that travel together
BLOCK = 1000  # rows of a block


def _sparse(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the entries of ML vectors, sparse or dense."""
    values, indices = vectors.field("values"), vectors.field("indices")
    counts = np.diff(values.offsets.to_numpy())
    value = values.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), counts)
    place = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)  # the feature, in a dense vector
    if indices.null_count < len(indices):
        sparse = np.asarray(indices.is_valid())[row]
        place[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, place, value


def _products(row, place, value, n: int, weights: np.ndarray) -> np.ndarray:
    """Rows by classes: w . x with the constant feature."""
    return np.stack([np.bincount(row, value * w[place], minlength=n) for w in weights[:, :-1]], axis=1) + weights[:, -1]


def _summed(row, place, value, by: np.ndarray, size: int) -> np.ndarray:
    """Classes by features: sum of by[i] * x_i."""
    return np.stack([np.r_[np.bincount(place, value * r[row], minlength=size), r.sum()] for r in by.T])


@dataclass
class SquaredHinge:
    """Weights per class (constant last), objective, and the gradient's norm as a share of the first one's."""

    weights: np.ndarray
    objective: np.ndarray
    gradient: np.ndarray
    steps: int
    scans: int = field(default=0)

    def margins(self, features: str = "features") -> Column:
        weights = self.weights

        @F.arrow_udf("array<double>")
        def score(vectors: pa.Array) -> pa.Array:
            out = _products(*_sparse(vectors), len(vectors), weights)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

        return score(F.unwrap_udt(features))


def _packed(train: DataFrame, fold: str | None) -> DataFrame:
    """Blocks of rows, each column the bytes of one array: every scan reads them as they are, without a list per row."""
    rows = train.select(F.unwrap_udt("features").alias("x"), F.col("label").cast("int").alias("label"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                row, place, value = _sparse(batch.column(0))
                parts = [batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.bincount(row, minlength=batch.num_rows), place]
                data = [p.astype(np.int32).tobytes() for p in parts] + [np.asarray(value, float).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], ["label", "fold", "n", "place", "value"])

    return settle(rows.mapInArrow(pack, "label binary, fold binary, n binary, place binary, value binary"))


def fit_squared_hinge(train: DataFrame, c: float = 1.0, tolerance: float = 1e-4, max_steps: int = 50, max_products: int = 30) -> SquaredHinge:
    """Fit (features, label) until every class's gradient norm is below `tolerance` times that at zero."""
    return _fit(train, None, [-1], c, tolerance, max_steps, max_products)[0]


def fit_without_folds(train: DataFrame, fold: str, folds: int, c: float = 1.0, tolerance: float = 1e-4, max_steps: int = 50, max_products: int = 30) -> list[SquaredHinge]:
    """One fit per fold, on the rows of the other folds; all of them share their scans."""
    return _fit(train, fold, list(range(folds)), c, tolerance, max_steps, max_products)


def _fit(train: DataFrame, fold: str | None, left_out: list[int], c: float, tolerance: float, max_steps: int, max_products: int) -> list[SquaredHinge]:
    x = F.unwrap_udt("features")
    last = [F.max(F.when(F.col(fold) != k, F.col("label")) if fold else F.col("label")).cast("int").alias(f"k{k}") for k in left_out]
    known = train.agg(*last, F.max(x["size"]).alias("d"), F.max(F.size(x["values"])).alias("dense")).first()
    size = max(known.d or 0, known.dense or 0)
    # A model is a class against the rest in one fit; it never sees the rows of its fit's fold.
    own = np.concatenate([np.arange(known[f"k{k}"] + 1) for k in left_out])
    without = np.concatenate([np.full(known[f"k{k}"] + 1, k) for k in left_out])
    blocks = _packed(train, fold)
    context, scans = train.sparkSession.sparkContext, [0]

    def scan(weights: tuple, wanted: np.ndarray, work: Callable) -> np.ndarray:
        """Sum of work(...) over all tasks for the wanted models: models by (loss, features, constant)."""
        scans[0] += 1
        sent = context.broadcast((weights, own[wanted], without[wanted]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, own, without = sent.value
            total = np.zeros((len(own), size + 2))
            for batch in batches:
                for cells in zip(*batch.columns, strict=True):
                    label, fold, n, place = (np.frombuffer(x.as_buffer(), np.int32) for x in cells[:4])
                    row, value = np.repeat(np.arange(len(n)), n), np.frombuffer(cells[4].as_buffer(), float)
                    sign = np.where(label[:, None] == own, 1.0, -1.0)
                    total += work(row, place, value, sign, fold[:, None] != without if without.max() >= 0 else True, *weights)
            flat = total.ravel()
            runs = [flat[k : k + RUN].tolist() for k in range(0, len(flat), RUN)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(runs)), pa.int32()), pa.array(runs, pa.list_(pa.float64()))], ["run", "s"])

        parts = blocks.mapInArrow(run, "run int, s array<double>").groupBy("run").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
        return np.concatenate([r["s"] for r in sorted(parts.collect(), key=lambda r: r["run"])]).reshape(len(wanted), size + 2)

    def slope(row, place, value, sign, seen, w):
        slack = np.maximum(1 - sign * _products(row, place, value, len(sign), w), 0.0) * seen
        return np.column_stack([c * (slack**2).sum(0), _summed(row, place, value, -2 * c * slack * sign, size)])

    def curve(row, place, value, sign, seen, w, v):
        active = (sign * _products(row, place, value, len(sign), w) < 1) & seen
        used = active.any(1)
        if used.mean() < 0.7:  # the others add nothing
            at = used[row]
            row, place, value, active = (np.cumsum(used) - 1)[row[at]], place[at], value[at], active[used]
        return np.column_stack([np.zeros(len(w)), _summed(row, place, value, 2 * c * active * _products(row, place, value, len(active), v), size)])

    def objective(w, wanted):
        found = scan((w[wanted],), wanted, slope)
        return found[:, 0] + (w[wanted] ** 2).sum(1) / 2, found[:, 1:] + w[wanted]

    w = np.zeros((len(own), size + 1))
    value, gradient = objective(w, np.arange(len(own)))
    first = np.maximum(np.linalg.norm(gradient, axis=1), 1e-300)
    steps = 0
    while steps < max_steps:
        live = np.linalg.norm(gradient, axis=1) > tolerance * first
        if not live.any():
            break
        steps += 1
        direction, rest = np.zeros_like(w), np.where(live[:, None], -gradient, 0.0)
        along, size2 = rest.copy(), (rest**2).sum(1)
        enough = 0.1 * np.sqrt(size2)
        for _ in range(max_products):
            todo = np.flatnonzero(np.sqrt(size2) > enough)
            if not len(todo):
                break
            ahead = along[todo]
            bent = scan((w[todo], ahead), todo, curve)[:, 1:] + ahead
            by = (size2[todo] / np.maximum((ahead * bent).sum(1), 1e-300))[:, None]
            direction[todo] += by * ahead
            rest[todo] -= by * bent
            new = (rest[todo] ** 2).sum(1)
            along[todo] = rest[todo] + (new / np.maximum(size2[todo], 1e-300))[:, None] * ahead
            size2[todo] = new
        down, stride = (gradient * direction).sum(1), np.ones(len(own))
        start, start_value, tried = w.copy(), value.copy(), np.flatnonzero(live)
        for _ in range(30):
            w[tried] = start[tried] + stride[tried, None] * direction[tried]
            value[tried], gradient[tried] = objective(w, tried)
            tried = tried[value[tried] > start_value[tried] + 0.01 * stride[tried] * down[tried]]
            if not len(tried):
                break
            stride[tried] /= 2
    shares = np.linalg.norm(gradient, axis=1) / first
    return [SquaredHinge(w[without == k], value[without == k], shares[without == k], steps, scans[0]) for k in left_out]
