"""Strassen's products against plain ones; mined negatives against all pairs in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 65), (70, 33, 129), (128, 128, 128), (7, 300, 90), (40, 1, 40)])
@pytest.mark.parametrize("leaf", [1, 5, 32])
def test_strassen(shape, leaf):
    rng = np.random.default_rng(sum(shape))
    n, k, m = shape
    a, b = rng.integers(-(2**20), 2**20, (n, k)), rng.integers(-(2**20), 2**20, (k, m))
    assert np.array_equal(negatives.strassen(a, b, leaf), a @ b)


def test_strassen_wraps_exactly():
    """Sums inside the recursion may pass 2^63; scores that fit come out exact."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**31), 2**31, (64, 64)), np.zeros((64, 64), np.int64)
    b[3], b[40] = 2**30, -(2**31)
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b.T] for r in a]
    assert negatives.strassen(a, b, 4).tolist() == want


def brute(rows, keep, low, anchor):
    sound = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound[i] = min(sound.get(i, (label, v)), (label, v))
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in sound.items()}
    out = []
    for a in (i for i in q if anchor(i)):
        scores = sorted((-sum(x * y for x, y in zip(q[a][1], v)), i) for i, (_, v) in q.items() if i != a)
        for s, p in [(s, p) for s, p in scores if q[p][0] == q[a][0]][:keep]:
            window = [(t, i) for t, i in scores if q[i][0] != q[a][0] and low * -s <= 100 * -t <= 100 * -s][:keep]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(window, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0, **options).collect())


@pytest.mark.parametrize("keep,low,group", [(5, 80, 64 << 20), (3, 50, 4000), (1, 100, 20_000)])
def test_against_all_pairs(spark, keep, low, group):
    rng = random.Random(keep)
    rows = [(k, rng.choices([0, 1, 2, 3], [60, 20, 10, 1])[0], [rng.choice([rng.gauss(0, 0.3), 0.125, 0.0]) for _ in range(40)]) for k in range(400)]
    rows += [(k, rng.randint(0, 2), rows[k % 7][2]) for k in range(400, 560)]  # copies: ties of score
    rows += [(k, 1, [0.1] * rng.randint(0, 50)) for k in range(560, 600)]  # other lengths, empty
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, id string, grp int, score int").repartition(6)
    assert mined(df, keep=keep, low=low, group_bytes=group) == brute(rows, keep, low, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    v = [0.5, 0.25]
    rows = [(0, 1, v), (1, 1, v), (2, 2, v), (3, 2, None), (4, None, v), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (None, 2, v),
            (10, 3, v), (20, None, v), (2, 2, v), (8, 2, [0.5, 0.25]), (8, 1, [9.0, 9.0]), (30, 5, [0.0, 0.0]), (31, 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    assert mined(df) == brute(rows, 5, 80, lambda i: i % 10 == 0)
    huge = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0]), (2, 2, [1.0])], df.schema)
    assert mined(huge) == []
    assert mined(df.limit(0)) == []
