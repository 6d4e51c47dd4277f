import pickle

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from driftline.operators import classify, features, forest, quality
from driftline.operators.svm import fit_squared_hinge, fit_without_folds
from driftline.session import settle

WORDS = {"art": "paint canvas gallery brush", "sea": "ship wave harbour sail", "sun": "light heat star glow"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        c = list(WORDS)[i % 3 if i % 5 else 0]
        own, other = WORDS[c].split(), sum((w.split() for w in WORDS.values()), [])
        rows.append((i, c, " ".join([*rng.choice(own, 6), *rng.choice(other, 3), "the common filler"])))
    return spark.createDataFrame(rows, "doc_id long, category string, text string")


@pytest.fixture(scope="module")
def bundle(docs):
    return classify.text_features(docs, "category")


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, [])], "doc_id long, terms array<string>")
    got = {r["term"]: (r["cf"], r["df"], r["docs"], round(r["idf"], 9)) for r in features.vocabulary(df).collect()}
    assert got == {"a": (3, 2, 3, round(np.log(4 / 3) + 1, 9)), "b": (1, 1, 3, round(np.log(2) + 1, 9)), "c": (1, 1, 3, round(np.log(2) + 1, 9))}
    assert [r["term"] for r in features.vocabulary(df, size=2).collect()] == ["a", "b"]
    assert [r["term"] for r in features.vocabulary(df, min_df=2).collect()] == ["a"]
    assert {r["term"] for r in features.vocabulary(df, max_df=0.5).collect()} == {"b", "c"}


def test_vectors_equal_rows(spark, docs):
    terms = features.add_terms(docs)
    vocab = features.vocabulary(terms)
    rows = {}
    for r in features.tfidf_rows(terms, vocab).collect():
        rows.setdefault(r["doc_id"], {})[r["term"]] = r["tfidf"]
    model = features.tfidf_model(vocab)
    names = model.stages[0].vocabulary
    for r in model.transform(terms).collect():
        got = {names[i]: v for i, v in zip(r["features"].indices, r["features"].values)}
        assert got.keys() == rows[r["doc_id"]].keys() and all(abs(got[k] - v) < 1e-12 for k, v in rows[r["doc_id"]].items())
        assert abs(sum(v * v for v in got.values()) - 1) < 1e-9


def test_vectors_of_words_equal_those_of_terms(spark, monkeypatch):
    """Words and pairs, looked up by word, give the vectors of the built-in transformers; texts are cut into words once."""
    texts = ["red red blue", "blue red", "", None, "green", "red blue red blue red", "no_such blue", "Blue GREEN red", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    words = features.add_terms(docs, bigrams=False)
    vocab = settle(features.vocabulary(words, size=8, pairs=True))
    want = {r["doc_id"]: r["features"] for r in features.tfidf_model(vocab).transform(features.add_terms(docs)).collect()}
    got = {r["doc_id"]: r["features"] for r in features.tfidf_vectors(words, vocab, pairs=True).collect()}
    assert got == want and any(" " in r["term"] for r in vocab.collect())
    names = [r["term"] for r in vocab.orderBy("term").collect()]
    rows = features.tfidf_rows(words, vocab, pairs=True).collect()
    assert {(r["doc_id"], r["term"], r["tfidf"]) for r in rows} == {(d, names[i], v) for d, x in want.items() for i, v in zip(x.indices, x.values)}
    cut, add = [], classify.add_terms
    monkeypatch.setattr(classify, "add_terms", lambda *a, **k: cut.append(1) or add(*a, **k))
    train, _, _ = classify.text_features(docs.withColumn("c", F.lit("a")), "c")
    assert cut == [1] and "regexp" not in train._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["naive_bayes", "logistic", "linear_svm"])
def test_models_beat_majority(bundle, name):
    train, test, names = bundle
    out = classify.predictions(classify.CLASSIFIERS[name](train), test)
    majority = test.groupBy("label").count().agg(F.max("count")).first()[0] / test.count()
    assert quality.accuracy_scores(out).first()["accuracy"] > majority + 0.2
    assert all(abs(sum(r["probability"]) - 1) < 1e-6 and len(r["probability"]) == 3 for r in out.collect())
    assert names == sorted(WORDS)


def test_squared_hinge_reaches_the_minimum(spark):
    """Gradient under the tolerance, the objective of a plain Newton solution, sparse and dense rows alike."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 6)) * (rng.random((240, 6)) < 0.6)
    label = np.argmax(x[:, :3] + 0.5 * rng.normal(size=(240, 3)), axis=1)
    rows = [(float(c), Vectors.dense(v) if i % 3 else Vectors.sparse(6, [(j, float(a)) for j, a in enumerate(v) if a])) for i, (v, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, ["label", "features"]).repartition(4)
    got = fit_squared_hinge(df, 0.7, 1e-6)
    z = np.column_stack([x, np.ones(240)])
    for k in range(3):
        y, w = np.where(label == k, 1.0, -1.0), np.zeros(7)
        for _ in range(100):
            active = y * (z @ w) < 1
            h = np.eye(7) + 1.4 * z[active].T @ z[active]
            w = np.linalg.solve(h, 1.4 * z[active].T @ y[active])
        assert np.allclose(got.weights[k], w, atol=1e-4) and abs(got.objective[k] - (w @ w / 2 + 0.7 * (np.maximum(1 - y * (z @ w), 0) ** 2).sum())) < 1e-6
    assert (got.gradient < 1e-6).all() and got.scans < 12 * got.steps + 2
    for r in df.withColumn("s", got.margins()).collect():
        assert np.allclose(r["s"], got.weights @ np.r_[r["features"].toArray(), 1.0])


def test_fits_without_folds_share_their_scans(spark):
    """Each equals the fit on the rows of the other folds; together they take hardly more scans than one of them."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 5)) * (rng.random((2500, 5)) < 0.7)
    label = np.argmax(x[:, :3] + 0.5 * rng.normal(size=(2500, 3)), axis=1)
    rows = [(float(k), i % 3, Vectors.sparse(5, [(j, float(a)) for j, a in enumerate(v) if a])) for i, (v, k) in enumerate(zip(x, label)) if k < 2 or i % 3 == 1]
    df = spark.createDataFrame(rows, ["label", "fold", "features"]).repartition(2).cache()
    got = fit_without_folds(df, "fold", 3)
    alone = [fit_squared_hinge(df.filter(F.col("fold") != k)) for k in range(3)]
    assert [len(g.weights) for g in got] == [3, 2, 3]  # class 2 is in fold 1 only
    for g, a in zip(got, alone):
        assert np.allclose(g.weights, a.weights, atol=1e-7) and np.allclose(g.objective, a.objective)
    assert got[0].scans < 1.5 * max(a.scans for a in alone)


def test_squared_hinge_reads_packed_rows(spark, bundle, monkeypatch):
    """A scan reads a row per block, not one per document."""
    from driftline.operators import svm

    packed, settled = svm._packed, []
    monkeypatch.setattr(svm, "_packed", lambda *a: settled.append(packed(*a)) or settled[-1])
    monkeypatch.setattr(svm, "BLOCK", 50)
    fit_squared_hinge(bundle[0].coalesce(1))
    assert settled[0].count() == 3 and bundle[0].count() == 120


def test_squared_hinge_beside_hinge(bundle):
    train, test, _ = bundle
    acc = {loss: quality.accuracy_scores(classify.predictions(classify.linear_svm(train, loss=loss), test)).first()["accuracy"] for loss in ("squared_hinge", "hinge")}
    assert acc["squared_hinge"] >= acc["hinge"] - 0.05


def test_random_forest(bundle):
    """On the whole vocabulary."""
    train, test, _ = bundle
    out = classify.predictions(classify.random_forest(train, trees=15), test)
    assert quality.accuracy_scores(out).first()["accuracy"] > 0.7
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out.collect())


def test_forest_equals_a_plain_tree(spark, monkeypatch):
    """One tree on all rows and all features, node by node as a plain search over every feature and cut finds it."""
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(forest, "DRAWS", np.array([0.0, 1.0]))  # every row once
    rng = np.random.default_rng(7)
    x = np.round(rng.random((160, 4)), 1) * (rng.random((160, 4)) < 0.5)
    label = (x[:, 0] > 0.4).astype(int) + (x[:, 2] > 0) * (x[:, 1] > 0.2)
    df = spark.createDataFrame([(i, float(c), Vectors.sparse(4, [(j, float(v)) for j, v in enumerate(r) if v])) for i, (r, c) in enumerate(zip(x, label))], ["id", "label", "features"])
    got = forest.fit_forest(df.repartition(3), trees=1, bins=64, share=1.0)
    edges = np.unique(x[x > 0])

    def plain(own):
        counts = np.bincount(label[own], minlength=3)
        best = (1e-9, None, None)
        for f in range(4):
            for cut in (0.0, *edges):
                left = x[own, f] <= cut
                if left.any() and not left.all():
                    gain = sum((np.bincount(label[own][s], minlength=3) ** 2).sum() / s.sum() for s in (left, ~left)) - (counts**2).sum() / len(own)
                    if round(gain, 9) > round(best[0], 9):
                        best = (gain, f, cut)
        if best[1] is None:
            return counts.tolist()
        left = x[own, best[1]] <= best[2]
        return best[1], best[2], plain(own[left]), plain(own[~left])

    def built(node):
        if got.feature[node] < 0:
            return got.weights[node].astype(int).tolist()
        return got.feature[node], got.threshold[node], built(got.left[node]), built(got.left[node] + 1)

    def alike(a, b, own):
        """The same rows in the leaves, with the same classes."""
        if isinstance(a, list) or isinstance(b, list):
            return a == b
        return a[0] == b[0] and alike(a[2], b[2], own) and alike(a[3], b[3], own)

    assert alike(plain(np.arange(160)), built(0), None)
    assert all(np.argmax(r["p"]) == r["label"] for r in df.withColumn("p", got.probabilities()).collect())


def test_forest_sends_plain_arrays(bundle, monkeypatch):
    """What is broadcast is pickled by reference; an executor without this library must be able to read it."""
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or broadcast(self, value))
    forest.fit_forest(bundle[0], trees=2)
    assert sent and not any(b"driftline" in s for s in sent)


def test_forest_with_batches_that_count_nothing(spark, monkeypatch):
    """The last 1,000 rows end in a pure leaf; while the others are split, their batch has no count."""
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(forest, "DRAWS", np.array([0.0, 1.0]))
    kinds = [1] * 8 + [2] * 8 + [0] * 2000
    rows = [(i, float(k), Vectors.sparse(3, [(k, 1.0)])) for i, k in enumerate(kinds)]
    got = forest.fit_forest(spark.createDataFrame(rows, ["id", "label", "features"]).coalesce(1), trees=1, share=1.0)
    assert sorted(map(tuple, got.weights[got.feature < 0].tolist())) == [(0.0, 0.0, 8.0), (0.0, 8.0, 0.0), (2000.0, 0.0, 0.0)]


def test_votes(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "b"), (2, "a"), (3, "b"), (3, "b"), (3, "b")]
    got = {r["i"]: r["prediction"] for r in classify.hard_vote(spark.createDataFrame(rows, "i int, prediction string"), "i").collect()}
    assert got == {1: "a", 2: "a", 3: "b"}
    probs = [(1, "a", 0.4), (1, "b", 0.6), (1, "a", 0.8), (1, "b", 0.2), (2, "a", 0.5), (2, "b", 0.5)]
    soft = {r["i"]: (r["prediction"], r["prob"]) for r in classify.soft_vote(spark.createDataFrame(probs, "i int, category string, prob double"), "i").collect()}
    assert soft[1][0] == "a" and abs(soft[1][1] - 0.6) < 1e-12 and soft[2] == ("a", 0.5)


def test_ensembles(bundle):
    train, test, _ = bundle
    members = [{r["doc_id"]: r["prediction"] for r in classify.predictions(classify.CLASSIFIERS[m](train), test).collect()} for m in ("naive_bayes", "logistic", "linear_svm")]
    for r in classify.vote(train, test).collect():
        mine = [m[r["doc_id"]] for m in members]
        if len(set(mine)) == 1:
            assert r["prediction"] == mine[0]
    soft = classify.vote(train, test, voting="soft")
    assert soft.count() == test.count() and quality.accuracy_scores(soft).first()["accuracy"] > 0.6


def test_probabilities_and_weights(spark, docs):
    probs = classify.category_probabilities(docs, "category").groupBy("doc_id").agg(F.sum("prob").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(probs) == 150 and all(abs(r["s"] - 1) < 1e-6 and r["n"] == 3 for r in probs)
    w = {r["category"]: (r["rows"], r["weight"]) for r in classify.class_weights(docs, "category").collect()}
    assert all(abs(weight - 150 / (3 * n)) < 1e-12 for n, weight in w.values())
    assert abs(classify.balanced_weights(docs, "category").agg(F.sum("weight")).first()[0] - 150) < 1e-9


def test_cross_validation(bundle):
    out = classify.cross_validate(bundle[0].select("doc_id", "label", "features"), "doc_id", classify.naive_bayes, 3).collect()
    assert sorted(r["fold"] for r in out) == [0, 1, 2] and all(0.5 < r["accuracy"] <= 1 for r in out)


def test_vector_features(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) + 3 * np.eye(4)[i % 2]).tolist(), i % 2) for i in range(100)]
    train, test, names = classify.vector_features(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "label", "vec_id")
    out = classify.predictions(classify.logistic(train), test, "vec_id")
    assert names == ["0", "1"] and quality.accuracy_scores(out).first()["accuracy"] > 0.9


def test_forest_splits_all_features_of_a_node_at_once():
    """Every feature's best cut as a plain search over its table finds it; the left side's classes come along."""
    rng = np.random.default_rng(3)
    bins, classes, count = 6, 3, 40
    tables = rng.integers(0, 5, (count, bins + 1, classes)) * (rng.random((count, bins + 1, 1)) < 0.6)
    tables[5] = tables[7] = tables[9] = 0  # features without an entry do not occur
    totals = np.maximum(tables.sum(1), 1) + rng.integers(0, 4, (count, classes))
    at = np.argwhere(tables[:, 1:] > 0)
    keys = (at[:, 0] * (bins + 1) + at[:, 1] + 1) * classes + at[:, 2]
    groups, gains, cuts, lefts = forest.best_splits(keys, tables[:, 1:][tables[:, 1:] > 0].astype(float), totals.astype(float), bins)
    assert set(groups) == set(at[:, 0])
    for g, gain, cut, left in zip(groups, gains, cuts, lefts):
        table = tables[g].astype(float)
        table[0] = totals[g] - table[1:].sum(0)
        found = []
        for k in range(bins):
            a, b = table[: k + 1].sum(0), table[k + 1 :].sum(0)
            found.append((a**2).sum() / a.sum() + (b**2).sum() / b.sum() - (totals[g] ** 2).sum() / totals[g].sum() if a.sum() and b.sum() else 0.0)
        assert np.isclose(gain, max(found)) and np.isclose(found[cut], gain) and left.tolist() == table[: cut + 1].sum(0).tolist()


def test_forest_children_need_no_scan_to_be_leaves(spark, monkeypatch):
    """Pure children, and all at the depth limit, have their classes from the split; wide features shorten the blocks."""
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(forest, "DRAWS", np.array([0.0, 1.0]))
    monkeypatch.setattr(forest, "CELLS", 4000)  # blocks of four rows
    rows = [(i, float(i % 2), Vectors.sparse(1000, [(999 * (i % 2), 1.0 + i % 3)])) for i in range(60)]
    df = spark.createDataFrame(rows, ["id", "label", "features"]).repartition(2)
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(1) or broadcast(self, value))
    got = forest.fit_forest(df, trees=1, share=1.0)
    assert len(sent) == 1 and len(got.feature) == 3
    assert sorted(map(tuple, got.weights.tolist())) == [(0.0, 30.0), (30.0, 0.0), (30.0, 30.0)]
