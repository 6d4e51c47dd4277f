"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text are cut into bins at sample quantiles. Boosting goes round the features: each turn fits a tree of up to four leaves
to one feature's gradients and adds it to that feature's lookup table. Then the pairs of features that leave most to
explain get a small table of two features each, boosted the same way. A score is a sum of table entries: a
vectorised lookup per feature and pair.

The model is fitted on a sample of labelled rows chosen by hash, about `most_rows` at most; everything else covers all rows. Null and
empty texts have features of their own (zeros) and get a score. Labels: null ones do not count; several of one id are
averaged and rounded up at a half. Without labels of both kinds every score is the share of label 1 (0.5 without any). Rows with null
id are scored like others; repeated rows get equal scores; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrays import SPACE, blocks, runs_of, word_hashes, word_spans

NAMES = ("bytes", "words", "word_length", "upper", "digits", "symbols", "stops", "distinct", "top_word", "repeated_runs", "line_words",
         "symbol_words", "symbol_ends", "non_ascii", "entropy", "repeated_lines")
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
UPPER, DIGIT, LETTER, STOP, HIGH = (np.zeros(256, bool) for _ in range(5))
UPPER[65:91] = DIGIT[48:58] = LETTER[65:91] = LETTER[97:123] = HIGH[128:] = True
STOP[[ord(c) for c in ".,;:"]] = True


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _share(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(row, feature) of a block of texts."""
    n = np.diff(offsets).astype(float)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    lines_s, lines_e, lines_f = word_spans(data, offsets, NEWLINE)
    lines = word_hashes(data, lines_s, lines_e)
    count = np.diff(first).astype(float)
    runs = runs_of(words, 5)
    out = np.zeros((len(n), len(NAMES)))
    letters = _counts(LETTER[data], offsets)
    out[:, 0], out[:, 1] = np.log1p(n), np.log1p(count)
    out[:, 2] = _share(n - _counts(SPACE[data], offsets), count)
    out[:, 3] = _share(_counts(UPPER[data], offsets), letters)
    for k, mask in ((4, DIGIT), (5, SYMBOL), (6, STOP), (13, HIGH)):
        out[:, k] = _share(_counts(mask[data], offsets), n)
    alone = SYMBOL[data[starts]] & (ends - starts == 1) if len(starts) else np.zeros(0, bool)
    tail = SYMBOL[data[ends - 1]] if len(starts) else np.zeros(0, bool)
    out[:, 11], out[:, 12] = _share(_counts(alone, first), count), _share(_counts(tail, first), count)
    out[:, 10] = np.log1p(_share(count, np.diff(lines_f)))
    for k in range(len(n)):
        own = words[first[k] : first[k + 1]]
        if len(own):
            _, times = np.unique(own, return_counts=True)
            out[k, 7], out[k, 8] = len(times) / len(own), times.max() / len(own)
            if len(own) >= 5:
                grams = runs[first[k] : first[k + 1] - 4]
                out[k, 9] = 1 - len(np.unique(grams)) / len(grams)
            rows = lines[lines_f[k] : lines_f[k + 1]]
            out[k, 15] = 1 - len(np.unique(rows)) / max(1, len(rows))
            p = np.bincount(data[offsets[k] : offsets[k + 1]], minlength=256) / n[k]
            p = p[p > 0]
            out[k, 14] = -(p * np.log2(p)).sum()
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every row, in the order of NAMES."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(block_features(data, offsets)), pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, x array<double>")


@dataclass
class Model:
    start: float = 0.0
    edges: list = field(default_factory=list)  # bin edges per feature
    tables: list = field(default_factory=list)  # one value per bin and feature
    coarse: list = field(default_factory=list)  # bin edges for pairs
    pairs: list = field(default_factory=list)  # (feature, feature, table)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Best cut of a run of bins: (gain, number of bins to its left); gain 0 if none helps."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(left_h < least) | (right_h < least)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A tree of up to four leaves over the bins of one feature: its value per bin."""
    out = np.zeros(len(g))
    gain, at = _split(g, h, ridge, least)
    cuts = [(0, at), (at, len(g))] if gain > 0 else [(0, len(g))]
    for lo, hi in cuts:
        inner, mid = _split(g[lo:hi], h[lo:hi], ridge, least)
        for a, b in [(lo, lo + mid), (lo + mid, hi)] if gain > 0 and inner > 0 else [(lo, hi)]:
            out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _plane(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, float]:
    """A tree over two features: one cut of the first, then one of the second on either side. Also returns its gain."""
    out, total = np.zeros(g.shape), 0.0
    _, at = max((_two_sided(g[:k], h[:k], ridge, least) + _two_sided(g[k:], h[k:], ridge, least), k) for k in range(1, g.shape[0])) if g.shape[0] > 1 else (0.0, g.shape[0])
    for rows in (slice(0, at), slice(at, g.shape[0])):
        if not g[rows].size:
            continue
        own_g, own_h = g[rows].sum(0), h[rows].sum(0)
        gain, mid = _split(own_g, own_h, ridge, least)
        for cols in (slice(0, mid), slice(mid, g.shape[1])) if gain > 0 else (slice(0, g.shape[1]),):
            s, t = own_g[cols].sum(), own_h[cols].sum()
            out[rows, cols] = -s / (t + ridge)
            total += s * s / (t + ridge)
    return out, total - g.sum() ** 2 / (h.sum() + ridge)


def _two_sided(g, h, ridge, least):
    own_g, own_h = g.sum(0), h.sum(0)
    return own_g.sum() ** 2 / (own_h.sum() + ridge) + _split(own_g, own_h, ridge, least)[0]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, pair_bins: int = 8, pairs: int = 8, pair_rounds: int = 25,
          ridge: float = 1.0, least: float = 2.0) -> Model:
    """Fit the lookup tables to labels y (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    model = Model(float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    if len(y) == 0 or share in (0.0, 1.0):
        return model
    model.edges, model.coarse = ([_edges(x[:, k], b) for k in range(x.shape[1])] for b in (bins, pair_bins))
    bin_of = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    coarse_of = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, at in enumerate(bin_of):
            g, h = slopes()
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(at, g, size), np.bincount(at, h, size), ridge, least)
            model.tables[k] += step
            total += step[at]

    def planes(i, j, g, h):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        at = coarse_of[i] * shape[1] + coarse_of[j]
        return [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    g, h = slopes()
    gains = sorted(((_plane(*planes(i, j, g, h), ridge, least)[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    chosen = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in gains[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            step, _ = _plane(*planes(i, j, *slopes()), ridge, least)
            table += rate * step
            total += rate * step[coarse_of[i], coarse_of[j]]
    model.pairs = chosen
    return model


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", most_rows: int = 30_000, **options) -> Model:
    """Fit on (id, x) rows that have a label; about `most_rows` of them at most, chosen by hash."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("y"))
    both = rows.dropDuplicates(["id"]).join(known, "id")
    n = known.count()
    dice = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    frame = both.where(dice < min(1.0, most_rows / max(n, 1))).select("id", "x", "y").toPandas().sort_values("id")
    x = np.array(frame["x"].tolist(), float).reshape(len(frame), len(NAMES))
    return boost(x, frame["y"].to_numpy(float), **options)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(id, score): the probability of label 1."""
    known = rows.sparkSession.sparkContext.broadcast((model.start, model.edges, model.tables, model.coarse, model.pairs))

    def run(batches):
        fitted = Model(*known.value)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(x))], ["id", "score"])

    return rows.select("id", "x").mapInArrow(run, "id long, score double")
