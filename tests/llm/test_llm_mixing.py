import hashlib
import re
from collections import defaultdict

import numpy as np

from driftline.llm.mixing import mix


def plain(rows, weights=(1, 2, 3), most=3):
    """Targets by dealing out in turns, taken words by sorting each source by hash."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {s: sum(n for n, (*_, x) in zip(size, rows, strict=True) if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, stopped = {}, set()
    while True:
        free = [s for s in sources if s not in stopped]
        left = sum(total.values()) - sum(most * total[s] for s in stopped)
        target = {s: most * total[s] if s in stopped else left * weight[s] / sum(weight[x] for x in free) for s in sources}
        new = {s for s in free if target[s] > most * total[s]}
        if not new:
            break
        stopped |= new
    by = defaultdict(dict)
    for (i, _, s), n in zip(rows, size, strict=True):
        h = int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)
        by[s][h] = by[s].get(h, 0) + n
    cut, passes = {}, {}
    for s in sources:
        passes[s] = min(most, int(target[s] // total[s])) if total[s] else 0
        budget, cut[s] = target[s] - passes[s] * total[s], 0
        for h in sorted(by[s]):
            if by[s][h] > budget:
                cut[s] = h + (2 * budget > by[s][h])
                break
            budget -= by[s][h]
    out = []
    for (i, _, s), n in zip(rows, size, strict=True):
        h = int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)
        out.append((i, n, total[s], round(target[s], 6), n * min(most, passes[s] + (h < cut[s]))))
    return sorted(out, key=str)


def test_against_plain_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(k, "w " * int(rng.integers(0, 40)), str(rng.choice(["a", "b", "é", "c", "Z", "tiny"], p=[0.5, 0.2, 0.1, 0.1, 0.09, 0.01]))) for k in range(600)]
    rows += [(700, None, "a"), (701, "", None), (702, "x\ty\u00a0z", None), (None, "one two", "b"), (5, rows[5][1], rows[5][2]), (800, "", "empty")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, source string, size int, hash string").repartition(7)
    got = [(r.id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix(df).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert mix(df.limit(0)).count() == 0


def test_taken_comes_near_the_targets(spark):
    rng = np.random.default_rng(7)
    rows = [(k, "w " * int(rng.integers(1, 30)), f"s{k % 9}") for k in range(5000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 15 for s in target)
