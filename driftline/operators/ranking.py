"""Ranks, samples and running totals that never put one whole group into one task.

A hash or quantile bucket splits every group first; totals per (group, bucket) give each bucket its offset, and only
rows of one bucket are ordered together. Results equal the plain single-window form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import lookup


def _group(keys: list[str]) -> Column:
    """One grouping column for any number of keys; inside a struct, null keys equal each other in joins too."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def seeded_hash(id_col: Column | str, seed: int = 42) -> Column:
    """A reproducible pseudo-random order of ids: md5 of seed and id."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))


def hash_rank(df: DataFrame, keys: list[str], id_col: str, out: str = "rank", seed: int = 42, digits: int = 3) -> DataFrame:
    """Add each row's 1-based position within its `keys` group, in seeded hash order, and the group's size.

    The first `digits` hex digits of the hash cut every group into 16**digits near-equal buckets.
    """
    rows = df.withColumn("__g", _group(keys)).withColumn("__h", seeded_hash(id_col, seed))
    rows = rows.withColumn("__b", F.substring("__h", 1, digits))
    per = rows.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__g")
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16**digits rows per group reach these windows.
    starts = per.select("__g", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                        F.sum("__n").over(whole).alias(f"{out}_size"))
    # Rows are shuffled once, by (group, bucket); the join reuses that partitioning.
    inside = Window.partitionBy("__g", "__b").orderBy("__h", id_col)
    placed = rows.withColumn("__rn", F.row_number().over(inside)).join(starts, ["__g", "__b"])
    return placed.withColumn(out, (F.col("__rn") + F.col("__off")).cast("bigint")).drop("__g", "__b", "__h", "__rn", "__off")


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows in seeded hash order; every row has the same chance."""
    if n <= 100_000:
        return df.orderBy(seeded_hash(id_col, seed), id_col).limit(n)  # per-task heaps of n, no full sort
    return hash_rank(df, [], id_col, "__rank", seed).filter(F.col("__rank") <= n).drop("__rank", "__rank_size")


def sample_share(df: DataFrame, share: float, id_col: str, seed: int = 42) -> DataFrame:
    """About `share` of the rows, by hash; no shuffle."""
    cut = int(share * 16**6)
    return df.filter(F.conv(F.substring(seeded_hash(id_col, seed), 1, 6), 16, 10).cast("bigint") < cut)


def stratified_split(df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `split` ('train'/'test') with the same test share in every class.

    The first round(size * test_share) rows of each class in hash order are the test rows. Only ids and labels are
    ranked; the last test row of each class then marks the boundary, and whole rows are compared with it in place.
    """
    ranked = hash_rank(df.select(label, id_col), [label], id_col, "__r", seed)
    chosen = ranked.filter(F.col("__r") <= F.round(F.col("__r_size") * F.lit(test_share)))
    place = F.struct(seeded_hash(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    marks = chosen.groupBy(_group([label]).alias("__g")).agg(F.max(place).alias("__last"))
    rows = df.withColumn("__g", _group([label])).join(lookup(marks), "__g", "left")
    split = F.when(place <= F.col("__last"), "test").otherwise("train")
    return rows.withColumn("split", split).drop("__g", "__last")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` in 0..k-1, balanced within every class."""
    ranked = hash_rank(df, [label], id_col, "__r", seed)
    return ranked.withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__r", "__r_size")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, spread_by: str, salts: int = 64) -> DataFrame:
    """The first n rows of every key in `order`, which must be total.

    A salted first cut (by a hash of `spread_by`) leaves at most n rows per (key, salt), so a key with a third of all
    rows is spread over `salts` tasks before its final cut.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    first = Window.partitionBy(*[F.col(k) for k in keys], F.col("__salt")).orderBy(*order)
    last = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
    cut = salted.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= n).drop("__rn", "__salt")
    return cut.withColumn("__rn", F.row_number().over(last)).filter(F.col("__rn") <= n).drop("__rn")


def head_rows(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first n rows by a key; per-task heaps, no full sort."""
    return df.orderBy(order_col).limit(n)


def running_totals(df: DataFrame, keys: list[str], order_col: str, values: list[str], buckets: int = 200) -> DataFrame:
    """Add `<value>_before`: the total of `value` over rows of the same keys with a smaller `order_col`.

    `order_col` is numeric and unique within its keys (aggregate ties first). Approximate quantiles only choose where
    groups are cut; the totals are exact.
    """
    marks = [i / buckets for i in range(1, buckets)]
    keyed = df.withColumn("__g", _group(keys))
    cuts = keyed.groupBy("__g").agg(F.percentile_approx(order_col, marks, 10_000).alias("__cuts"))
    rows = keyed.join(lookup(cuts), "__g")
    below = F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col(order_col))
    rows = rows.withColumn("__b", F.size(below)).drop("__cuts")
    sums = rows.groupBy("__g", "__b").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    earlier = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__g", "__b", *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__o_{v}") for v in values])
    inside = Window.partitionBy("__g", "__b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__w_{v}") for v in values])
    out = out.join(starts, ["__g", "__b"])
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"__w_{v}") + F.col(f"__o_{v}"))
    return out.drop("__g", "__b", *[f"__{x}_{v}" for v in values for x in ("o", "w")])
