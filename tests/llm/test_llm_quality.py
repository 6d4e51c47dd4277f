import numpy as np

from driftline.llm.quality import NAMES, _split, block_features, boost, features, fit, score


def test_split_against_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        want = max((g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1), k) for k in range(1, 9))
        gain, at = _split(g, h, 1.0, 0.0)
        assert np.isclose(gain, max(want[0], 0)) and (gain == 0 or at == want[1])


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boost(x[:3000], y[:3000], rounds=30, pairs=2, pair_rounds=60)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.scores(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95


def test_features_of_a_text():
    raw = b"The cat | the CAT!\nthe end"
    row = dict(zip(NAMES, block_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], strict=True))
    assert np.isclose(row["words"], np.log1p(7)) and np.isclose(row["distinct"], 5 / 7) and np.isclose(row["top_word"], 3 / 7)
    assert np.isclose(row["symbol_words"], 1 / 7) and np.isclose(row["symbol_ends"], 2 / 7) and np.isclose(row["upper"], 4 / 18)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = ["the cat sat on a mat near some old house and looked out of the window".split()] * 300
    rows = [(k, " ".join(rng.permutation(w)) if k % 3 else " ".join(w).upper() + "!! ## " * 5) for k, w in enumerate(good)]
    rows += [(900, None), (901, ""), (None, "x"), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 300, 2)] + [(0, None), (None, 1)], "doc_id long, quality int")
    x = features(df)
    got = [(r.id, r.score) for r in score(x, fit(x, labels)).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    assert all((s > 0.5) == (k % 3 > 0) for k, s in got if k is not None and k < 300)
    assert features(df.limit(0)).count() == 0
    flat = [r.score for r in score(x, fit(x, labels.limit(0))).collect()]
    assert set(flat) == {0.5}
