import numpy as np

from driftline.llm.vectors import _requests, near_duplicates


def brute(rows, least):
    sound = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(sound)
    near = {i: set() for i, _ in rows}
    for a in ids:
        for b in ids:
            x, y = sound[a], sound[b]
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                near[a].add(b)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


def got(df):
    return {r.id: (r.n_links, r.component, r.kept) for r in df.collect()}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 10))
    rows = [(k, (centres[k % 12] + rng.normal(size=10) * rng.choice([0.0, 0.1, 0.5])).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[5][1]) for k in range(150)]  # a large group of copies
    rows += [(2000 + k, (rng.normal(size=10)).tolist()) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    assert got(near_duplicates(df, block=32, directions=3)) == brute(rows, 0.95)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, []),
            (9, [1.0, 0.0, 0.0]), (10, [1.0, 1e-3]), (11, [1e300, 1e297])]
    df = spark.createDataFrame([(*r, 1, "x") for r in [*rows, rows[0], (None, [1.0, 0.0])]], "vec_id long, embedding array<double>, n int, id string")
    want = brute(rows[:10], 0.95)
    want[11] = (3, 1, False)
    for i in (1, 2, 10):
        want[i] = (want[i][0] + 1, *want[i][1:])
    assert got(near_duplicates(df)) == want
    assert near_duplicates(df.limit(0)).count() == 0
    assert got(near_duplicates(df.where("vec_id = 3"))) == {3: (0, 3, True)}


def test_blocks_travel_once_to_a_pair_of_tiles(spark):
    """Vectors without structure, so that every block meets every other: the copies of a block follow from the tiles, not from the blocks."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(240, 16)).astype(np.float32)
    x = np.vstack([base, base[:200] + rng.normal(size=(200, 16)).astype(np.float32) * 0.05])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    want = brute([(k, v.tolist()) for k, v in enumerate(x)], 0.95)
    assert sum(n for n, _, _ in want.values()) > 200
    assert got(near_duplicates(df, block=8, tiles=5, tile_bytes=100)) == want  # many tiles, several rounds
    assert got(near_duplicates(df, block=8, tiles=1)) == want

    blocks, tile = 40, 5
    pairs = spark.range(blocks).selectExpr("id as a").crossJoin(spark.range(blocks).selectExpr("id as b")).where("a <= b")
    asked = {r.block: r.to for r in _requests(pairs, tile).collect()}
    assert sorted(asked) == list(range(blocks))
    assert all(sorted({(t.ta, t.tb) for t in to}) == sorted((t.ta, t.tb) for t in to) and len(to) == blocks // tile for to in asked.values())
    assert sorted((b, w) for b, to in asked.items() for t in to for w in t["with"]) == sorted((r.a, r.b) for r in pairs.collect())
