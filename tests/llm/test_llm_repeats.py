import hashlib
from os.path import commonprefix

import numpy as np
import pytest

from driftline.llm import repeats
from driftline.llm.repeats import _common, _left_matches, lcp_intervals, without_repeats


def brute(rows, length):
    """Per id (bytes, removed, runs, hash of the rest), by looking at every string."""
    seen, out = set(), {}
    for i, text in sorted((i, t or "") for i, t in rows if i is not None):
        raw = text.encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            piece = raw[k : k + length]
            if piece in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(piece)
        rest = bytes(x for x, m in zip(raw, mark, strict=True) if not m)
        out[i] = (len(raw), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), hashlib.sha256(rest).hexdigest())
    return out


def got(df):
    return {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_intervals():
    assert sorted(lcp_intervals(np.array([3, 5, 3, 1]))) == [(0, 3, 3), (0, 4, 1), (1, 2, 5)]


def test_left_matches_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(2, 12))
        sizes = rng.integers(0, 9, n)
        rows = np.zeros((n, 8), np.uint8)
        for k in range(n):
            rows[k, : sizes[k]] = rng.integers(97, 99, sizes[k])
        age = rng.permutation(n)
        want = [max([int(_common(rows[[k]], rows[[j]], np.array([min(sizes[k], sizes[j])]))[0]) for j in range(n) if age[j] < age[k]], default=-1) for k in range(n)]
        assert _left_matches(rows, sizes, age).tolist() == want


@pytest.mark.parametrize("most", [2, 2048])
def test_against_every_string(spark, most):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 5))) for _ in range(12)]
    common = " ".join(rng.choice(words, 30))
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words, rng.integers(0, 60)))
        if i % 3 == 0:
            text += common[: int(rng.integers(20, len(common)))] + " ".join(rng.choice(words, 9))
        rows.append((i, text))
    rows += [(200, rows[3][1]), (201, rows[3][1][:70] + "x" + rows[3][1][70:]), (202, None), (203, ""), (204, "ab" * 400), (205, "z" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(without_repeats(df, length=40, gram=12, most=most)) == brute(rows, 40)


def test_odd_rows(spark):
    """Null ids are kept whole, repeated rows are one document, other columns may have any name, no rows give no rows."""
    text = "a passage of some words that is long enough to count as a repeat when it comes again, " * 2
    rows = [(1, text), (1, text), (None, text), (2, text)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, start int")
    out = without_repeats(df).collect()
    assert sorted((r.id or 0, r.n_removed) for r in out) == [(0, 0), (1, brute(rows[:1], 100)[1][1]), (1, brute(rows[:1], 100)[1][1]), (2, len(text))]
    assert without_repeats(df.limit(0)).count() == 0


def test_a_shared_passage_is_halved_once_a_task(spark, monkeypatch):
    """Rows of frequent grams grow with the documents, not with documents times strings of the passage."""
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = letters(160)
    texts = [letters(50) + passage for _ in range(80)]
    rows = [(7, i, 60, 28, text[32:100].encode()) for i, text in enumerate(texts)]
    contexts = spark.createDataFrame(rows, "g long, id long, pos int, before int, bytes binary").repartition(2)
    joined, settle = [], repeats.settle

    def counted(table):
        out = settle(table)
        joined.extend([out.count()] if {"n", "first"} <= set(out.columns) else [])
        return out

    monkeypatch.setattr(repeats, "settle", counted)
    groups, told = repeats._longer_anchors(contexts, 40, 12, 16)
    found = repeats._tree(groups, 40, 12).unionByName(told).collect()
    reached = {i: (min(r.start for r in found if r.id == i), max(r.stop for r in found if r.id == i)) for i in {r.id for r in found}}
    shared = {i: max(len(commonprefix([text[:50][::-1], other[:50][::-1]])) for other in texts[:i]) for i, text in enumerate(texts) if i}
    assert reached == {i: (50 - n, 100) for i, n in shared.items()}
    assert sum(joined) <= 400
