"""Corpus preparation: cleaning, ids, date filters, caps, time bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.text import normalize_text
from driftline.operators.ranking import sample_rows, top_per_key
from driftline.session import lookup, settle

NTZ = "timestamp_ntz"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def clean_corpus(frames: list[DataFrame]) -> DataFrame:
    """Union the frames by name, clean text and title, drop rows with no date, number the rows as `doc_id`.

    Frames that already carry `doc_id` keep it.
    """
    df = union_by_name(frames)
    if "text" not in df.columns or "published" not in df.columns:
        missing = {"text": "string", "published": NTZ}
        df = df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in df.columns}).limit(0)  # nothing to read: an empty corpus
    df = df.withColumn("text", normalize_text("text"))
    if "title" in df.columns:
        df = df.withColumn("title", normalize_text("title"))
    df = df.filter(F.col("published").isNotNull()).withColumn("published", F.col("published").cast(NTZ))
    return df if "doc_id" in df.columns else number_rows(df)


def number_rows(df: DataFrame, out: str = "doc_id", stable_input: bool = False) -> DataFrame:
    """Dense ids 0..n-1 in input order (partition by partition, frame by frame in a union), without a global sort.

    Each row's partition and place are written down while the input is read, so that later passes may see other
    partitions; the table of partition sizes has one row per partition. `stable_input` saves the write for a plain
    file scan that always gives the same partitions.
    """
    place = F.monotonically_increasing_id()
    rows = df.withColumn("__pid", F.shiftright(place, 33).cast("int")).withColumn("__pos", place.bitwiseAND(F.lit(2**33 - 1)))
    rows = rows if stable_input else settle(rows)
    counts = rows.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = rows.join(F.broadcast(starts), "__pid", "left")  # one row per partition
    return placed.withColumn(out, F.col("__start") + F.col("__pos")).drop("__pid", "__pos", "__start")


def between_dates(df: DataFrame, start=None, end=None, col: str = "published") -> DataFrame:
    """Keep start <= date <= end; a null bound is open. Reaches the Parquet scan as a pushed filter."""
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start).cast(NTZ))
    if end is not None:
        df = df.filter(F.col(col) <= F.lit(end).cast(NTZ))
    return df


def default_window(df: DataFrame, days: int = 180, col: str = "published") -> DataFrame:
    """Rows of the last `days` days, counted back from the newest date in the data."""
    newest = df.agg(F.max(col)).scalar()
    return df.filter(F.col(col) >= newest - F.expr(f"interval {int(days)} days"))


def cap_per_source(df: DataFrame, n: int, source: str = "source", col: str = "published", id_col: str = "doc_id") -> DataFrame:
    """The newest n documents of every source."""
    return top_per_key(df, [source], [F.col(col).desc(), F.col(id_col)], n, id_col)


def ingest_stats(df: DataFrame, col: str = "published", source: str = "source") -> DataFrame:
    """Per source and for all sources ('*'): documents, first and last date, whole days between."""
    per = df.groupBy(source).agg(F.count(F.lit(1)).alias("docs"), F.min(col).alias("first"), F.max(col).alias("last"))
    every = per.agg(F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"))
    both = per.unionByName(every.withColumn(source, F.lit("*")))
    return both.withColumn("span_days", F.datediff("last", "first"))


def bin_start(col: Column | str, freq: str = "M") -> Column:
    """Start of the day, Monday week, month or quarter, as a zone-less timestamp."""
    day = (F.col(col) if isinstance(col, str) else col).cast("date")
    unit = {"D": None, "W": "week", "M": "month", "Q": "quarter"}[freq]
    return (F.trunc(day, unit) if unit else day).cast(NTZ)


def time_bins(df: DataFrame, freq: str = "M", col: str = "published", out: str = "time_bin") -> DataFrame:
    return df.withColumn(out, bin_start(col, freq))


def spread_over_bins(df: DataFrame, id_col: str = "doc_id", freq: str = "W", months: int = 24) -> DataFrame:
    """Give undated rows a date: row i goes to slot i mod n, slots counted from 2022-01-01; then bin.

    Weekly slots are 7 days and 4 per month, monthly ones 30 days, daily ones 1 day and 30 per month. Monthly slots
    are binned by month, all others by week.
    """
    slots, step = {"M": (months, 30), "W": (months * 4, 7)}.get(freq, (months * 30, 1))
    date = F.expr(f"timestamp_ntz'2022-01-01 00:00:00' + make_dt_interval(cast(pmod({id_col}, {slots}) * {step} as int))")
    return time_bins(df.withColumn("published", date), "M" if freq == "M" else "W")


def bin_coverage(df: DataFrame, col: str = "time_bin", wanted: int = 10) -> DataFrame:
    """Distinct bins, their range, and whether there are enough of them."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("docs")).agg(
        F.count(col).alias("bins"), F.min(col).alias("first"), F.max(col).alias("last")
    )
    return out.withColumn("span_days", F.datediff("last", "first")).withColumn("enough", F.col("bins") >= wanted)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def weak_pairs(df: DataFrame, max_pairs: int | None = None, seed: int = 42) -> DataFrame:
    """Title/text training pairs: both present, title over 10 and text over 40 characters. `max_pairs` asks for a seeded sample."""
    good = df.filter((F.length("title") > 10) & (F.length("text") > 40)).select("doc_id", "title", "text")
    return (good if max_pairs is None else sample_rows(good, max_pairs, "doc_id", seed)).withColumn("label", F.lit(1.0))


def category_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Integer codes 0.. of the distinct values in alphabetical order, joined back. The window sees distinct values only."""
    codes = df.select(col).filter(F.col(col).isNotNull()).distinct()
    codes = codes.withColumn(out, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(col)) - 1).cast("int"))
    return df.join(lookup(codes), col, "left")
