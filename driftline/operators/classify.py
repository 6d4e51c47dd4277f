"""Text and vector classifiers on Spark ML, their probabilities and votes.

Every classifier takes rows with `features` (a vector) and `label` (0.0, 1.0, ... in alphabetical order of the class
names) and returns (id, label, prediction, probability array).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.vectors import doubles, scaled
from driftline.operators.features import TfIdf, add_terms
from driftline.operators.forest import fit_forest
from driftline.operators.ranking import stratified_folds, stratified_split
from driftline.operators.svm import SquaredHinge, fit_squared_hinge, fit_without_folds
from driftline.session import lookup, packed, settle


TOLERANCE = 1e-4  # fixed value: stopping tolerance of the linear models


def index_labels(df: DataFrame, col: str) -> StringIndexerModel:
    """Class index in alphabetical order."""
    return StringIndexer(inputCol=col, outputCol="label", stringOrderType="alphabetAsc").fit(df.select(col).distinct())


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (k * rows of the class) per row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    weights = counts.select(label, (total / (k * F.col("__c"))).alias(out))
    return df.join(lookup(weights), label)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """The balanced weight of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, "rows", (total / (k * F.col("rows"))).alias("weight"))


def _softmax(scores: Column) -> Column:
    e = F.zip_with(scores, F.array_repeat(F.array_max(scores), F.size(scores)), lambda s, top: F.exp(s - top))
    return scaled(e, F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def _argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def naive_bayes(train: DataFrame, smoothing: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """Multinomial naive Bayes. Class priors are the unsmoothed class shares, so the built-in smoothed ones are swapped."""
    model = NaiveBayes(modelType="multinomial", smoothing=smoothing).fit(train)
    counts = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    shift = [
        (math.log(counts[c] / total) if counts.get(c) else -1e300) - float(p) for c, p in enumerate(model.pi.toArray())
    ]

    def predict(df: DataFrame) -> DataFrame:
        raw = F.zip_with(vector_to_array("rawPrediction"), F.array(*[F.lit(s) for s in shift]), lambda a, b: a + b)
        scored = model.transform(df).withColumn("scores", raw)
        return scored.withColumn("prediction", _argmax(F.col("scores"))).withColumn("probability", _softmax(F.col("scores")))

    return predict


def logistic(train: DataFrame, c: float = 1.0, balanced: bool = False, max_iter: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """Multinomial logistic regression with L2 strength 1 / (C * n), optionally with balanced class weights."""
    n = train.count()
    rows = balanced_weights(train, "label") if balanced else train
    lr = LogisticRegression(family="multinomial", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=TOLERANCE)
    model = (lr.setWeightCol("weight") if balanced else lr).fit(rows)
    return lambda df: model.transform(df).withColumn("probability", vector_to_array("probability"))


def linear_svm(train: DataFrame, c: float = 1.0, loss: str = "squared_hinge", max_iter: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """One-vs-rest linear SVM. `scores` holds one margin per class; probability is their softmax.

    `squared_hinge` fits all classes together by Newton steps; `hinge` is the built-in model.
    """
    if loss == "squared_hinge":
        return _by_margins(fit_squared_hinge(train, c, TOLERANCE))
    n = train.count()
    svm = LinearSVC(regParam=1.0 / (c * max(n, 1)), maxIter=max_iter, standardization=False, tol=TOLERANCE)
    model = OneVsRest(classifier=svm, parallelism=4).setRawPredictionCol("rawPrediction").fit(train)

    def predict_hinge(df: DataFrame) -> DataFrame:
        out = model.transform(df).withColumn("scores", vector_to_array("rawPrediction"))
        return out.withColumn("probability", _softmax(F.col("scores")))

    return predict_hinge


def _by_margins(fitted: SquaredHinge) -> Callable[[DataFrame], DataFrame]:
    def predict(df: DataFrame) -> DataFrame:
        out = df.withColumn("scores", fitted.margins())
        return out.withColumn("prediction", _argmax(F.col("scores"))).withColumn("probability", _softmax(F.col("scores")))

    return predict


def random_forest(train: DataFrame, trees: int = 100, max_depth: int = 30, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Random forest over the whole vocabulary, or any sparse features that are not negative."""
    forest = fit_forest(train, trees, max_depth, seed)

    def predict(df: DataFrame) -> DataFrame:
        out = df.withColumn("probability", forest.probabilities())
        return out.withColumn("prediction", _argmax(F.col("probability")))

    return predict


CLASSIFIERS = {"naive_bayes": naive_bayes, "logistic": logistic, "linear_svm": linear_svm, "random_forest": random_forest}


def predictions(model: Callable[[DataFrame], DataFrame], df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return model(df).select(id_col, "label", "prediction", "probability")


def _split_words(df: DataFrame, category: str, id_col: str, text: str, test_share: float = 0.2) -> DataFrame:
    """Stratified split, the texts as word arrays; written out."""
    return settle(add_terms(stratified_split(df, category, id_col, test_share), text, "words", bigrams=False).drop(text))


def text_features(df: DataFrame, category: str, id_col: str = "doc_id", text: str = "text", size: int = 10_000,
                  min_df: int = 1, max_df: float = 1.0, test_share: float = 0.2):
    """Stratified split and TF-IDF vectors learned on its training part; returns (train, test, class names).

    The words are written out once for the passes of the vocabulary, the vectors once for every optimiser step of every model.
    """
    rows = _split_words(df.select(id_col, category, text), category, id_col, text, test_share)
    indexer = index_labels(rows, category)
    tfidf = TfIdf(rows.filter("split = 'train'"), size=size, min_df=min_df, max_df=max_df)
    ready = packed(settle(indexer.transform(tfidf.features(rows)).select(id_col, category, "label", "split", "features")))
    return ready.filter("split = 'train'"), ready.filter("split = 'test'"), list(indexer.labels)


def vector_features(df: DataFrame, category: str, id_col: str, vec: str = "embedding", test_share: float = 0.2):
    """The same for rows that already carry a dense vector."""
    rows = df.filter(F.col(vec).isNotNull()).select(id_col, F.col(category).cast("string").alias("class"), vec)
    rows = stratified_split(rows, "class", id_col, test_share)
    indexer = index_labels(rows, "class")
    ready = packed(settle(indexer.transform(rows.withColumn("features", array_to_vector(doubles(vec)))).drop(vec)))
    return ready.filter("split = 'train'"), ready.filter("split = 'test'"), list(indexer.labels)


def category_probabilities(df: DataFrame, category: str, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Train balanced logistic regression on the training split and score every document: (id, category, prob)."""
    rows = _split_words(df.select(id_col, category, text, *keep), category, id_col, text)
    indexer = index_labels(rows, category)
    tfidf = TfIdf(rows.filter("split = 'train'"))
    ready = packed(settle(indexer.transform(tfidf.features(rows))))
    model = logistic(ready.filter("split = 'train'"), balanced=True)
    scored = model(ready)
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in indexer.labels]).alias("category"), F.col("probability").alias("prob"))
    return scored.select(id_col, *keep, F.inline(pairs).alias("category", "prob"))


def hard_vote(votes: DataFrame, id_col: str, prediction: str = "prediction") -> DataFrame:
    """Majority of the members' predictions per row; ties go to the lowest class. `votes` has one row per member."""
    tally = votes.groupBy(id_col, prediction).agg(F.count(F.lit(1)).alias("__n"))
    best = tally.groupBy(id_col).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(prediction).alias("p"))).alias("b"))
    return best.select(id_col, F.col("b.p").alias(prediction))


def soft_vote(probs: DataFrame, id_col: str, category: str = "category", prob: str = "prob") -> DataFrame:
    """Class with the highest mean probability over the members; ties go to the first class."""
    mean = probs.groupBy(id_col, category).agg(F.avg(prob).alias("__m"))
    pick = F.struct((-F.round("__m", 9)).alias("m"), F.col(category).alias("c"), F.col("__m").alias("p"))
    best = mean.groupBy(id_col).agg(F.min(pick).alias("b"))
    return best.select(id_col, F.col("b.c").alias("prediction"), F.col("b.p").alias("prob"))


def calibrated_svm(train: DataFrame, id_col: str, folds: int = 3) -> Callable[[DataFrame], DataFrame]:
    """SVM whose probabilities come from logistic calibrators fitted on held-out folds, averaged over the folds."""
    parts = packed(settle(stratified_folds(train, "label", id_col, folds)))
    fitted = []
    for i, fit in enumerate(fit_without_folds(parts, "fold", folds, tolerance=TOLERANCE)):
        svm = _by_margins(fit)
        held = svm(parts.filter(F.col("fold") == i)).select("label", array_to_vector("scores").alias("margins"))
        n = held.count()
        fitted.append((svm, LogisticRegression(
            featuresCol="margins", probabilityCol="calibrated", rawPredictionCol="calibrated_raw", predictionCol="calibrated_class",
            family="multinomial", regParam=1.0 / max(n, 1), standardization=False).fit(held)))
    used = ["rawPrediction", "prediction", "scores", "probability", "margins", "calibrated", "calibrated_raw", "calibrated_class"]

    def predict(df: DataFrame) -> DataFrame:
        for i, (svm, calibrator) in enumerate(fitted):
            step = calibrator.transform(svm(df).withColumn("margins", array_to_vector("scores")))
            df = step.withColumn(f"__p{i}", vector_to_array("calibrated")).drop(*used)
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(f"__p{i}") for i in range(folds)])
        out = df.withColumn("probability", F.transform(total, lambda v: v / folds))
        return out.withColumn("prediction", _argmax(F.col("probability"))).drop(*[f"__p{i}" for i in range(folds)])

    return predict


def vote(train: DataFrame, test: DataFrame, id_col: str = "doc_id", voting: str = "hard") -> DataFrame:
    """Naive Bayes, logistic regression and linear SVM together: (id, label, prediction)."""
    svm = calibrated_svm(train, id_col) if voting == "soft" else linear_svm(train)
    members = [predictions(m, test, id_col) for m in (naive_bayes(train), logistic(train), svm)]
    truth = test.select(id_col, "label")
    if voting == "hard":
        votes = reduce(DataFrame.unionByName, [m.select(id_col, "prediction") for m in members])
        return truth.join(hard_vote(votes, id_col), id_col)
    probs = reduce(DataFrame.unionByName, [m.select(id_col, F.posexplode("probability").alias("category", "prob")) for m in members])
    out = soft_vote(probs, id_col).select(id_col, F.col("prediction").cast("double").alias("prediction"))
    return truth.join(out, id_col)


def cross_validate(df: DataFrame, id_col: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], k: int = 5) -> DataFrame:
    """Accuracy per stratified fold."""
    folds = packed(settle(stratified_folds(df, "label", id_col, k)))
    parts = []
    for i in range(k):
        out = fit(folds.filter(F.col("fold") != i))(folds.filter(F.col("fold") == i))
        parts.append(out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")).withColumn("fold", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)
