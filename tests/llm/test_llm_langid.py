from itertools import product

import numpy as np

from driftline.llm.langid import MODEL, Lattice, fit, predict, vocabulary

PIECES = ["▁a", "a", "b", "ab", "ba", "▁ab", "aba", "▁"]


def every_cut(word, probs):
    """Sum over all segmentations, by listing them."""
    word, total = "▁" + word, 0.0
    for bits in product((0, 1), repeat=len(word) - 1):
        cut, last = [], 0
        for k, b in enumerate(bits, 1):
            if b:
                cut.append(word[last:k])
                last = k
        cut.append(word[last:])
        p = 1.0
        for c in cut:
            p *= probs[PIECES.index(c)] if c in PIECES else probs[len(PIECES)] if len(c) == 1 else 0.0
        total += p
    return total


def test_forward_sums_all_segmentations():
    probs = np.random.default_rng(1).random((len(PIECES) + 1, 2))
    words = ["a", "ab", "abab", "bxa", "ababa", ""]
    got = Lattice(PIECES).log_likelihood(words, probs)
    for k, w in enumerate(words):
        assert np.allclose(np.exp(got[k]), [every_cut(w, probs[:, j]) for j in range(2)])


def test_expected_counts_add_up():
    """Weighted by length, the expected pieces of a word cover it exactly once."""
    lattice, probs = Lattice(PIECES), np.full((len(PIECES) + 1, 1), 0.1)
    got = lattice.expected(["abab", "xa"], np.array([2.0, 1.0]), probs)
    sizes = np.array([len(p) for p in PIECES] + [1])
    assert np.isclose((got * sizes).sum(), 2 * 5 + 3)


def test_many_pieces_are_found():
    pieces = vocabulary(MODEL)
    lattice = Lattice(pieces)
    some = [p for p in pieces if p.startswith("▁") and len(p) > 2][::37]
    lengths, found, _ = lattice.edges([p[1:] for p in some])
    assert [pieces[found[n - 1][k, 0]] for k, n in enumerate(lengths)] == some


def test_languages_and_odd_rows(spark):
    texts = {"en": "the cat and the dog were in the house with a big window", "de": "der hund und die katze waren im haus mit einem großen fenster", "fr": "le chien et le chat étaient dans la maison avec une grande fenêtre"}
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(texts[lang].split(), 20)), lang) for k, lang in enumerate(list(texts) * 40)]
    train = spark.createDataFrame([*rows, (None, None, "en"), (900, "zzz", None)], "doc_id long, text string, lang string")
    fitted = fit(train)
    assert fitted[0] == ["de", "en", "fr"] and np.allclose(fitted[1].sum(0), 1, atol=1e-6)
    odd = [(1000, "The Window AND the house"), (1001, None), (1002, ""), (1003, "123 !! 4"), (1004, "Katze " * 3000), (1005, "x" * 3000), (None, "le chat"), (1000, "The Window AND the house"), (1006, "日本")]
    df = spark.createDataFrame([(*r, 1.0) for r in odd], "doc_id long, text string, lang double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in predict(df, fitted).collect()]
    assert [g[:2] for g in got if g[0] not in (1005, 1006)] == [(1000, "en"), (1001, "und"), (1002, "und"), (1003, "und"), (1004, "de"), (None, "fr"), (1000, "en")]
    assert all(0 <= s <= 1 for *_, s in got) and dict((g[0], g[2]) for g in got)[1001] == 0
    assert predict(df.limit(0), fitted).count() == 0
    assert {r.lang_pred for r in predict(df, fit(train.limit(0))).collect()} == {"und"}
