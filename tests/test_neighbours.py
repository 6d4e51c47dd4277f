import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import neighbours


def frame(spark, x, ids=None, labels=None):
    rows = [(ids[i] if ids else i, [float(v) for v in x[i]], int(labels[i]) if labels is not None else i % 3) for i in range(len(x))]
    return spark.createDataFrame(rows, f"id {'string' if ids else 'long'}, embedding array<double>, label int")


def brute(q, c, k, same=False):
    def unit(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    s = np.round(unit(q) @ unit(c).T, 9) + 0.0
    if same:
        np.fill_diagonal(s, -np.inf)
    return {(i, j): r + 1 for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(c)), -s[i]))[:k]) if np.isfinite(s[i, j])}


def got(df):
    return {(r["query_id"], r["neighbour_id"]): r["rank"] for r in df.collect()}


@pytest.fixture(scope="module")
def hot():
    """Clusters, a third of all rows the same vector, some zero vectors."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(5, 6))[i % 5] + 0.1 * rng.normal(size=6) for i in range(300)])
    x[::3] = x[0]
    x[[7, 50]] = 0.0
    return x


@pytest.mark.parametrize("block", [20, 64, 4096])
def test_nearest_with_hot_copies(spark, hot, block):
    df = frame(spark, hot)
    assert got(neighbours.nearest(df, df, 4, "id", "id", block_rows=block)) == brute(hot, hot, 4)
    assert got(neighbours.nearest(df, df, 3, "id", "id", exclude_same_id=True, block_rows=block)) == brute(hot, hot, 3, True)


def test_two_tables_and_few_rows(spark, hot):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(37, 6))
    out = neighbours.nearest(frame(spark, q), frame(spark, hot[:50]), 5, "id", "id", block_rows=16)
    assert got(out) == brute(q, hot[:50], 5)
    assert got(neighbours.nearest(frame(spark, q[:2]), frame(spark, hot[:3]), 5, "id", "id")) == brute(q[:2], hot[:3], 5)


def copies(df, k, block):
    """How many tasks a corpus row is sent to, on average."""
    rows = df.select("id", F.col("embedding").alias("vec"))
    tree, groups = neighbours.index(rows, rows, k, block)
    return neighbours._scatter(rows, rows.schema["id"].dataType, tree, groups, False).count() / rows.count()


def test_copies_per_row_do_not_grow_with_the_rows(spark):
    """Clusters of 50 rows: four times as many rows make twice the cells, and a row still meets its own neighbourhood only."""
    rng = np.random.default_rng(2)
    sent = []
    for n in (1000, 4000):
        centers = rng.normal(size=(n // 50, 10))
        x = np.vstack([centers[i % len(centers)] + 0.005 * rng.normal(size=10) for i in range(n)])
        df = frame(spark, x)
        sent.append(copies(df, 5, 100))
    assert sent[1] < 1.3 * sent[0] < 8
    assert got(neighbours.nearest(df, df, 5, "id", "id", block_rows=100)) == brute(x, x, 5)


def test_groups_are_sized_by_bytes(spark, monkeypatch):
    """Without structure a row is copied once per group, and groups hold a fixed number of bytes."""
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 600 * 8 * 34)
    x = np.random.default_rng(5).normal(size=(6000, 32))
    assert copies(frame(spark, x), 5, None) <= 6000 / 600 * 2 + math.isqrt(78)
    tree = neighbours.PivotTree(x[:100])
    assert len(tree.fine) == 100 and len(tree.tops) <= 10 and tree.start[-1] == 100


def test_groups_of_many_pivots_travel_together(spark):
    """Without structure a row is copied once per load, and loads are full: 28 top pivots make no more of them than their rows fill."""
    x = np.random.default_rng(6).normal(size=(6000, 32))
    rows = frame(spark, x).select("id", F.col("embedding").alias("vec"))
    tree, groups = neighbours.index(rows, rows, 5, 2000)
    assert len(tree.value.tops) > 20 and len(groups.value.parts) <= 2 * 6000 / 2000
    assert copies(frame(spark, x), 5, 2000) <= 2 * 6000 / 2000


def test_single_precision_vectors_travel_as_such(spark, hot):
    df = frame(spark, hot).withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows = df.select("id", F.col("embedding").alias("vec"))
    sent = neighbours._scatter(rows, rows.schema["id"].dataType, *neighbours.index(rows, rows, 4, 64), False)
    assert sent.schema["vec"].dataType.simpleString() == "array<float>"
    assert got(neighbours.nearest(df, df, 4, "id", "id", block_rows=64)) == brute(hot.astype(np.float32).astype(float), hot.astype(np.float32).astype(float), 4)


def test_string_ids(spark, hot):
    ids = [f"d{i:03d}" for i in range(60)]
    df = frame(spark, hot[:60], ids)
    want = {(ids[i], ids[j]): r for (i, j), r in brute(hot[:60], hot[:60], 2, True).items()}
    assert got(neighbours.nearest(df, df, 2, "id", "id", exclude_same_id=True, block_rows=16)) == want


def test_knn_vote_and_ties(spark):
    x = np.array([[1, 0], [1, 0.01], [0, 1], [0.01, 1], [1, 1.0]])
    train, test = frame(spark, x[:4], labels=[2, 2, 1, 1]), frame(spark, x[4:])
    assert neighbours.knn_classify(train, test, "id", "label", 4).first()["prediction"] == 1
    assert neighbours.knn_classify(train, frame(spark, x[:1]), "id", "label", 3).first()["prediction"] == 2
    assert neighbours.knn_classify(train, frame(spark, x[:1]), "id", "label", 4, weights="distance").first()["prediction"] == 2


def test_recall(spark, hot):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, x[i].tolist(), (x[i] + 0.01 * rng.normal(size=8)).tolist()) for i in range(40)], "id long, t array<double>, b array<double>")
    assert {r["k"]: r["recall"] for r in neighbours.retrieval_recall(df, df, "id", "t", "b").collect()} == {1: 1.0, 3: 1.0, 5: 1.0}
    assert {r["recall"] for r in neighbours.retrieval_recall(df.limit(4), df, "id", "t", "b", compat=True).collect()} == {0.0}
    assert {r["k"]: r["recall"] for r in neighbours.masked_self_recall(df.limit(5)).collect()} == {1: 0.0, 3: 0.0, 5: 1.0}


@pytest.mark.parametrize("names", [int, "d{:03d}".format])
def test_recall_from_counts(spark, hot, names):
    """The same as the ranks among all neighbours, with copies, ties, zero vectors, ids that repeat, are null or have no own row; and no pairs are kept."""
    rng = np.random.default_rng(4)
    title = hot + 0.3 * rng.normal(size=hot.shape) * (rng.random((len(hot), 1)) < 0.7)
    ids = [names(i) for i in range(len(hot))]
    ids[10], ids[11], ids[20], ids[21] = ids[12], ids[12], None, None
    kind = "string" if names is not int else "long"
    make = lambda ids, x: spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], f"id {kind}, vec array<double>")
    q, c = make(ids, title), make([*ids[:280], *ids[:30]], np.vstack([hot[:280], hot[:30]]))
    held, unit = [*ids[:280], *ids[:30]], lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims, own = np.round(unit(title) @ unit(np.vstack([hot[:280], hot[:30]])).T, 9) + 0.0, []
    for i in set(ids):  # rows that share an id share one list
        order = sorted((-s, c is None, c or 0 if kind == "long" else c or "") for r in range(300) if ids[r] == i for s, c in zip(sims[r], held))
        own.append(next((n for n, (_, none, c) in enumerate(order, 1) if i is not None and not none and c == i), 999))
    assert {r.k: r.recall for r in neighbours.retrieval_recall(q, c, "id", "vec", "vec").collect()} == {k: pytest.approx(np.mean(np.array(own) <= k)) for k in (1, 3, 5)}
    known = neighbours._own_similarity(q, c)
    counts = [{r.id: min(r.before, 5) for r in neighbours._rows_before(q.join(known, "id"), c, 5, block, shares).collect()} for block, shares in ((None, (100,)), (50, (2, 100)), (7, (30, 60, 100)))]
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) > 50
    assert [r.recall for r in neighbours.retrieval_recall(q, c.limit(0), "id", "vec", "vec").collect()] == [None] * 3


def test_recall_counts_what_single_precision_cannot_tell(spark):
    """Rows a few billionths around the own one, far below what single precision resolves, are counted by their rounded similarity and id."""
    rng = np.random.default_rng(6)
    axes, q, c, want = np.linalg.qr(rng.normal(size=(24, 24)))[0], [], [], {}
    for i in range(8):  # a query is one axis; its corpus rows lie at known cosines from it and at 0 from the others
        near = 0.3 + 0.08 * i + np.r_[0.0, rng.choice([-4e-8, -3e-9, -2e-10, 0.0, 2e-10, 3e-9, 4e-8, 0.01], 60)]
        ids = np.r_[100 * i + 30, rng.permutation(np.setdiff1d(np.arange(61), 30)) + 100 * i]
        q.append((int(ids[0]), axes[i].tolist()))
        c += [(int(k), (s * axes[i] + np.sqrt(1 - s * s) * axes[8 + i]).tolist()) for k, s in zip(ids, near)]
        own = np.round(near[0], 9)
        want[int(ids[0])] = sum(np.round(s, 9) > own or (np.round(s, 9) == own and k < ids[0]) for k, s in zip(ids[1:], near[1:]))
    make = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>")
    known = neighbours._own_similarity(make(q), make(c))
    got = {r.id: r.before for r in neighbours._rows_before(make(q).join(known, "id"), make(c), 1000).collect()}
    assert got == {k: n for k, n in want.items() if n} and len(got) == 8


def test_distance_sums(spark, hot):
    df = frame(spark, hot)
    d = np.linalg.norm(hot[:, None] - hot[None], axis=2)
    label = np.arange(300) % 3
    for r in neighbours.distance_sums(df, "id", "label", block_rows=64).collect():
        mine = label == int(r["label"])
        assert abs(r["total"] - d[r["id"], mine].sum()) < 1e-4 and r["rows"] == mine.sum()
