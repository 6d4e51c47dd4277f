"""Classification metrics from prediction rows, scores and grades.

Everything starts from the (true, predicted) count table, which has classes-squared rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ranking import running_totals
from driftline.session import settle


def confusion(df: DataFrame, truth: str = "label", pred: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """Counts per (true, predicted) and their share of the true class."""
    keys = keys or []
    cells = df.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, truth)))


def top_mistakes(df: DataFrame, truth: str = "label", pred: str = "prediction", n: int = 5, over: int = 10) -> DataFrame:
    """The n most frequent confusions with more than `over` cases."""
    wrong = confusion(df, truth, pred).filter((F.col(truth) != F.col(pred)) & (F.col("n") > over))
    return wrong.orderBy(F.col("n").desc(), truth, pred).limit(n)


def class_report(df: DataFrame, truth: str = "label", pred: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    keys = keys or []
    cells = df.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)
    both = cells.select(*keys, F.inline(F.array(
        F.struct(F.col(truth).alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col(pred).alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )))
    m = both.groupBy(*keys, "class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)

    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    m = m.withColumn("precision", p).withColumn("recall", r)
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return m.withColumn("f1", f1).select(*keys, "class", "precision", "recall", "f1", "support")


def accuracy_scores(df: DataFrame, truth: str = "label", pred: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    keys = keys or []
    rep = class_report(df, truth, pred, keys)

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    # Weighted recall is the share of correct rows.
    return rep.groupBy(*keys).agg(
        weighted("recall").alias("accuracy"), weighted("precision").alias("precision"),
        weighted("recall").alias("recall"), weighted("f1").alias("f1"))


def roc_auc(scores: DataFrame, truth: str = "truth", category: str = "category", score: str = "prob") -> DataFrame:
    """One-vs-rest ROC AUC per category by rank sum, ties counted half; null when one side is empty.

    Rows collapse to distinct scores first; ranks come from running totals over quantile buckets, so no category is
    sorted in one task.
    """
    pos = (F.col(truth) == F.col(category)).cast("bigint")
    per = settle(scores.groupBy(category, F.col(score).cast("double").alias("s")).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")))
    run = running_totals(per, [category], "s", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return run.groupBy(category).agg(F.when(pairs > 0, won / F.when(pairs > 0, pairs)).alias("auc"))


def macro_auc(aucs: DataFrame) -> DataFrame:
    return aucs.agg(F.avg("auc").alias("macro_auc"))


# Lower bounds and names of the two grade scales.
SYSTEM_GRADES = ((0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair"), (None, "Needs Improvement"))
MODEL_GRADES = ((0.92, "Excellent"), (0.88, "Very Good"), (0.85, "Good"), (None, "Fair"))


def grade(score: Column, bands=SYSTEM_GRADES) -> Column:
    out = F.lit(bands[-1][1])
    for low, name in reversed(bands[:-1]):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def overall_score(scores: DataFrame, col: str = "score") -> DataFrame:
    """Mean of the scores that exist, and its grade; no row without any score."""
    return scores.agg(F.avg(col).alias("overall")).filter(F.col("overall").isNotNull()).withColumn("grade", grade(F.col("overall")))


def best_model(scores: DataFrame, model: str = "model", score: str = "accuracy") -> DataFrame:
    """The model with the highest score (first name on ties) and its grade."""
    best = scores.filter(F.col(score).isNotNull()).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(model).alias("m"))).alias("b"))
    return best.select(F.col("b.m").alias(model), (-F.col("b.s")).alias(score)).withColumn("grade", grade(F.col(score), MODEL_GRADES))
