"""Concept trajectories, consensus, source series and category-probability trajectories."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.text import mentions
from driftline.functions.vectors import EPS, cosine, dot, norm, unit
from driftline.operators.embedding import component_mean, mean_vectors
from driftline.session import settle


def _concept_array(concepts: list[str]):
    return F.array(*[F.lit(c) for c in concepts])


def concept_matches(docs: DataFrame, concepts: list[str], text: str = "text", mode: str = "regex") -> DataFrame:
    """One row per (document, matched concept): all concepts are tested in a single scan, no join."""
    hits = F.filter(
        F.array(*[F.when(mentions(text, c, mode), F.lit(c)) for c in concepts]), lambda c: c.isNotNull()
    )
    return docs.withColumn("concept", F.explode(hits))


def concept_prevalence(docs: DataFrame, concepts: list[str], text: str = "text", mode: str = "regex") -> DataFrame:
    """Share of documents containing each concept, and the quality band of that share."""
    flags = docs.agg(
        *[F.avg(F.coalesce(mentions(text, c, mode), F.lit(False)).cast("double")).alias(f"c{i}") for i, c in enumerate(concepts)]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(f"c{i}").alias("prevalence")) for i, c in enumerate(concepts)])
    rows = flags.select(F.inline(pairs))
    return rows.withColumn("quality", prevalence_quality("prevalence"))


def prevalence_quality(col: str):
    return F.when(F.col(col) < 0.01, 0.3).when(F.col(col) < 0.05, 0.6).otherwise(0.9)


def group_means(docs: DataFrame, concepts: list[str], keys: list[str] | None = None, text: str = "text", vec: str = "embedding",
                time_bin: str = "time_bin", mode: str = "regex") -> DataFrame:
    """Mean vectors of all bins and of all concepts' documents from one scan: (keys, time_bin, concept, mean, docs).

    A document counts for its bin (concept null) and for each concept it mentions (time_bin null). The result has one
    row per bin and concept and is written out, since trajectories read it several times.
    """
    keys = keys or []
    when = docs.schema[time_bin].dataType
    hits = F.filter(F.array(*[F.when(mentions(text, c, mode), F.lit(c)) for c in concepts]), lambda c: c.isNotNull())
    slots = F.concat(
        F.array(F.struct(F.col(time_bin).alias("t"), F.lit(None).cast("string").alias("c"))),
        F.transform(hits, lambda c: F.struct(F.lit(None).cast(when).alias("t"), c.alias("c"))))
    rows = docs.select(*keys, vec, F.explode(slots).alias("slot"))
    means = mean_vectors(rows, [*keys, "slot"], vec, "mean")
    return settle(means.select(*keys, F.col("slot.t").alias(time_bin), F.col("slot.c").alias("concept"), "mean", "docs"))


def _weighted_mean():
    return vector_to_array(Summarizer.mean(array_to_vector("mean"), F.col("docs").cast("double")))


def concept_vectors(means: DataFrame, concepts: list[str], keys: list[str] | None = None) -> DataFrame:
    """Unit vector per (keys, concept) from `group_means`: mean of the matching documents, of all when none match."""
    keys = keys or []
    hit = means.filter(F.col("concept").isNotNull()).select(*keys, "concept", F.col("mean").alias("hit"))
    whole = means.filter(F.col("concept").isNull()).groupBy(*keys).agg(_weighted_mean().alias("whole"))
    wanted = whole.withColumn("concept", F.explode(_concept_array(concepts)))
    both = wanted.join(hit, [*keys, "concept"], "left")
    return both.select(*keys, "concept", unit(F.coalesce("hit", "whole")).alias("concept_vec"))


def concept_trajectories(docs: DataFrame, concepts: list[str], keys: list[str] | None = None, text: str = "text",
                         vec: str = "embedding", time_bin: str = "time_bin", mode: str = "regex") -> DataFrame:
    """value(bin) = cosine of the bin's centroid and the concept vector, for many concepts (and corpora) at once.

    Document-level work is one scan and one aggregate; everything after runs on bins.
    """
    keys = keys or []
    means = group_means(docs, concepts, keys, text, vec, time_bin, mode)
    vectors = concept_vectors(means, concepts, keys)
    bins = means.filter(F.col("concept").isNull()).drop("concept")
    rows = bins.withColumn("concept", F.explode(_concept_array(concepts))).join(vectors, [*keys, "concept"])
    out = rows.select(*keys, "concept", time_bin, cosine(unit("mean"), F.col("concept_vec")).alias("value"))
    return out if "source" in keys else out.withColumn("source", F.lit("consensus-free"))


def category_trajectories(docs: DataFrame, category: str = "category", text: str = "text", vec: str = "embedding",
                          time_bin: str = "time_bin") -> DataFrame:
    """A trajectory per category over its own documents, with the category's name as the concept; one scan."""
    when = docs.schema[time_bin].dataType
    own = F.array(F.struct(F.lit(False).alias("hit"), F.col(time_bin).alias("t")))
    named = F.array(F.struct(F.lit(True).alias("hit"), F.lit(None).cast(when).alias("t")))
    slots = F.concat(own, F.when(mentions(text, F.col(category)), named).otherwise(F.slice(named, 1, 0)))
    means = settle(mean_vectors(docs.select(category, vec, F.explode(slots).alias("slot")), [category, "slot"], vec, "mean"))
    hit = means.filter("slot.hit").select(category, F.col("mean").alias("hit"))
    bins = means.filter("not slot.hit").select(category, F.col("slot.t").alias(time_bin), "mean", "docs")
    whole = bins.groupBy(category).agg(_weighted_mean().alias("whole"))
    vectors = whole.join(hit, category, "left").select(category, unit(F.coalesce("hit", "whole")).alias("concept_vec"))
    rows = bins.join(vectors, category)
    return rows.select(category, time_bin, cosine(unit("mean"), F.col("concept_vec")).alias("value"))


def keyword_trajectory(docs: DataFrame, keyword_vec: list[float], vec: str = "embedding", time_bin: str = "time_bin") -> DataFrame:
    """Mean over the bin's documents of their similarity to the keyword's own vector, clipped to [0, 1]."""
    key = F.array(*[F.lit(float(x)) for x in keyword_vec])
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(vec, key)))
    return docs.groupBy(time_bin).agg(F.avg(sim).alias("value"), F.count(F.lit(1)).alias("docs"))


def source_centers(docs: DataFrame, source: str = "source", vec: str = "embedding", time_bin: str = "time_bin") -> DataFrame:
    """Norm of the centroid per (bin, source)."""
    return mean_vectors(docs, [time_bin, source], vec).select(time_bin, source, norm("centroid").alias("scalar"), "docs")


def fuse_consensus(traj: DataFrame, docs: DataFrame, series: list[str] | None = None, source: str = "source",
                   vec: str = "embedding", time_bin: str = "time_bin") -> DataFrame:
    """Trajectory next to the mean of the sources' centroid norms per bin, both z-scored within the series."""
    fused = source_centers(docs, source, vec, time_bin).groupBy(time_bin).agg(F.avg("scalar").alias("consensus"))
    out = traj.join(fused, time_bin, "left")
    whole = Window.partitionBy(*(series or [F.lit(0)]))
    for c in ("value", "consensus"):
        out = out.withColumn(c, (F.col(c) - F.avg(c).over(whole)) / (F.stddev_pop(c).over(whole) + F.lit(EPS)))
    return out


def source_observations(docs: DataFrame, source: str = "source", vec: str = "embedding", time_bin: str = "time_bin",
                        keys: list[str] | None = None) -> DataFrame:
    """Mean over all vector components of all documents, per bin and source."""
    rows = docs.filter(F.col(vec).isNotNull())
    return rows.groupBy(*(keys or []), time_bin, source).agg(component_mean(vec).alias("value"))


def dense_grid(obs: DataFrame, source: str = "source", time_bin: str = "time_bin", keys: list[str] | None = None) -> DataFrame:
    """Every observed bin for every source, with nulls where a source has no documents.

    The observations (one row per bin and source) are written out, since they are read three times. The calendar of a
    corpus travels as one array per corpus (its length is bounded by the time span) and is unrolled
    next to each source, so no row-by-row product of two tables is planned.
    """
    keys = keys or []
    tagged = settle(obs).withColumn("__k", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    calendar = tagged.groupBy("__k").agg(F.collect_set(time_bin).alias("__bins"))
    names = tagged.select("__k", source).distinct()
    grid = names.join(calendar, "__k").select("__k", source, F.explode("__bins").alias(time_bin))
    full = grid.join(tagged.select("__k", source, time_bin, "value"), ["__k", source, time_bin], "left")
    return full.select(*[F.col(f"__k.{k}").alias(k) for k in keys], time_bin, source, "value")


def fill_gaps(grid: DataFrame, source: str = "source", time_bin: str = "time_bin", keys: list[str] | None = None,
              value: str = "value") -> DataFrame:
    """Carry the last value forward in time, then the next one backward, within each source."""
    w = Window.partitionBy(*(keys or []), source).orderBy(time_bin)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return grid.withColumn(value, F.coalesce(back, ahead))


def source_matrix(docs: DataFrame, source: str = "source", vec: str = "embedding", time_bin: str = "time_bin",
                  keys: list[str] | None = None) -> DataFrame:
    """Long-format matrix of source series: dense bins by sources, gaps filled."""
    obs = source_observations(docs, source, vec, time_bin, keys)
    return fill_gaps(dense_grid(obs, source, time_bin, keys), source, time_bin, keys)


def probability_trajectory(probs: DataFrame, time_bin: str = "time_bin") -> DataFrame:
    """Mean, sample std and count of the category probability per bin, with the one-std band."""
    out = probs.groupBy(time_bin, "category").agg(
        F.avg("prob").alias("mean"), F.stddev_samp("prob").alias("std"), F.count(F.lit(1)).alias("count")
    )
    return out.withColumn("low", F.col("mean") - F.col("std")).withColumn("high", F.col("mean") + F.col("std"))


def probability_by_bin(probs: DataFrame, categories: list[str], time_bin: str = "time_bin") -> DataFrame:
    """Mean probability per bin, one column per category."""
    return probs.groupBy(time_bin).pivot("category", categories).agg(F.avg("prob"))


def dominant_category(probs: DataFrame, time_bin: str = "time_bin") -> DataFrame:
    """The category with the highest mean probability in each bin; ties go to the first name."""
    mean = probs.groupBy(time_bin, "category").agg(F.avg("prob").alias("mean"))
    rank = F.struct(-F.round("mean", 9), "category", "mean")
    best = mean.groupBy(time_bin).agg(F.min(rank).alias("b"))
    return best.select(time_bin, F.col("b.category").alias("category"), F.col("b.mean").alias("mean"))
