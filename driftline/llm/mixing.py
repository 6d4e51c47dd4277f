"""Mixing sources to target weights with hash thresholds.

Every document has a fixed hash. A source's budget is taken as whole passes over it and one part pass; pass k takes the
documents whose hash lies under the k-th threshold, and thresholds are nested, so a larger budget only adds documents. The
threshold of a part pass is found from histograms: sizes summed by source and leading hash bits, then, only inside the
bucket where the budget falls, by the next bits, until one hash is left. Documents are filtered by threshold, not sorted.

Size is the number of words `[^\\x20\\x09-\\x0D]+`; null text has size 0. Null source is a source of its own, last in order.
Rows that repeat an id are taken alike (their hashes are the same). Null ids share one hash. An empty table, or one without words,
gives target 0 and takes nothing. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import lookup, settle

BITS, STEP = 60, 12  # bits of the hash, and how many of them one histogram adds


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def document_hash(id_col: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with `rank` from 0, by code point of `column`, null last; numbered within range partitions with offsets."""
    by = F.col(column).asc_nulls_last()
    lines = settle(rows.orderBy(by).withColumn("line", F.monotonically_increasing_id()))
    part = F.shiftright("line", 33)
    counts = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per partition
    offset, so_far = F.lit(0).cast("long"), 0
    pairs = []
    for r in counts:
        pairs.append((r.part, so_far))
        so_far += r.n
    if pairs:
        offset = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(p).cast("long"), F.lit(o).cast("long")) for p, o in pairs])), part)
    return lines.withColumn("rank", offset + F.col("line").bitwiseAND((1 << 33) - 1)).drop("line")


def shares(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): the sum of sizes dealt by weight; targets stop at `most` times the source's size."""
    table = settle(numbered(sources, "source").withColumn(
        "w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))))
    sums = table.agg(F.sum("source_size").alias("all"), F.sum("w").alias("w")).first()
    total, level = sums["all"] or 0, None
    while sums["w"]:
        # What stopped sources leave is dealt out again by weight, until no further source stops.
        level_now = (total if level is None else total - (fixed["s"] or 0)) / (sums["w"] if level is None else fixed["w"])
        if level_now == level:
            break
        level = level_now
        stopped = F.col("source_size") * most < F.col("w") * F.lit(level)
        fixed = table.agg(F.sum(F.when(stopped, F.col("source_size") * most)).alias("s"), F.sum(F.when(~stopped, F.col("w"))).alias("w")).first()
        if not fixed["w"]:
            break
    target = F.least(F.col("w") * F.lit(float(level or 0.0)), (F.col("source_size") * most).cast("double"))
    return table.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): documents of a source with hash below `cut` come nearest to its `budget`.

    docs has (source, size, hash), budgets (source, budget); sources compare null-safe.
    """
    state = settle(budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix")))
    for bits in range(STEP, BITS + 1, STEP):
        bucket = F.shiftright("hash", BITS - bits)
        # Only documents of the boundary bucket are grouped; the state has a row per source and is sent to them while it is small.
        inside = docs.withColumn("bucket", bucket).alias("h").join(
            lookup(state).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")) & (F.shiftright("h.hash", BITS - bits + STEP) == F.col("s.prefix")))
        near = inside.groupBy("s.source", "left", "bucket").agg(F.sum("h.size").alias("size"))
        # 4,096 buckets of a source at most: a running sum, and the first bucket that passes the budget.
        from_start = F.expr("array_sort(collect_list(struct(bucket, size)))")
        runs = near.groupBy("source", "left").agg(from_start.alias("runs"))
        step = F.aggregate(
            "runs", F.struct(F.col("left").alias("left"), F.lit(None).cast("long").alias("prefix"), F.lit(0).cast("long").alias("size")),
            lambda s, x: F.when(s["prefix"].isNull() & (x["size"] > s["left"]), F.struct(s["left"].alias("left"), x["bucket"].alias("prefix"), x["size"].alias("size")))
            .when(s["prefix"].isNull(), F.struct((s["left"] - x["size"]).alias("left"), s["prefix"].alias("prefix"), s["size"].alias("size"))).otherwise(s))
        state = settle(runs.select("source", step.alias("s")).select("source", "s.left", F.coalesce("s.prefix", F.lit(1 << bits)).alias("prefix"), "s.size"))
    # One hash is left: it goes in if that comes nearer to the budget.
    return state.select("source", F.when(F.col("left") * 2 > F.col("size"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("cut"))


def plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target, full, cut) per source of (source, size, hash) rows: whole passes, and the hash below which one more is taken."""
    per = shares(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    full = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    per = settle(per.withColumn("full", full))
    cuts = thresholds(rows, per.select("source", (F.col("target") - F.col("full") * F.col("source_size")).alias("budget")))
    joined = per.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return settle(joined.select("p.*", F.coalesce("c.cut", F.lit(0)).alias("cut")))


def taken(rows: DataFrame, per_source: DataFrame, source_col: str = "source", most: int = 3) -> DataFrame:
    """`rows` (with size and hash) with source_size, target and taken; only the plan, a row per source, meets them."""
    sides = rows.alias("d").join(per_source.alias("p"), F.col(f"d.`{source_col}`").eqNullSafe(F.col("p.source")))
    passes = F.least(F.lit(most), F.col("p.full") + (F.col("d.hash") < F.col("p.cut")).cast("long"))
    return sides.select("d.*", "p.source_size", "p.target", (F.col("d.size") * passes).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(id, source, size, source_size, target, taken) per row: words the mix takes of it, repeats counted."""
    rows = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), document_hash(id_col).alias("hash")))
    return taken(rows, plan(rows, weights, most), "source", most).drop("hash")
