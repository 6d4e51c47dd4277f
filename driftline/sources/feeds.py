"""Archived RSS and Atom feeds as corpus records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from driftline.operators.corpus import NTZ, between_dates, cap_per_source

ITEM = StructType([StructField(c, StringType()) for c in ("title", "description", "link", "pubDate", "updated", "created")])
LINK = StructType([StructField("_href", StringType()), StructField("_rel", StringType())])
ENTRY = StructType([
    StructField("title", StringType()), StructField("summary", StringType()),
    StructField("link", ArrayType(LINK)), StructField("published", StringType()),
])

# Date spellings found in feeds; the first that parses wins.
RFC_DATES = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")
ISO_DATES = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parse_date(col: Column | str) -> Column:
    """A feed date as UTC time without zone; null when no known spelling fits."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    # The weekday is only checked for shape, as feed readers do; a wrong one does not void the date.
    bare = F.regexp_replace(c, r"^[A-Za-z]{3,9},\s*", "")
    tries = [F.try_to_timestamp(bare, F.lit(f.split(", ", 1)[-1])) for f in RFC_DATES[:2]]
    tries += [F.try_to_timestamp(c, F.lit(f)) for f in ISO_DATES]
    return F.to_utc_timestamp(F.coalesce(*tries), F.current_timezone()).cast(NTZ)


def _record(df: DataFrame, source: str, title: str, summary: str, published: Column, url: Column) -> DataFrame:
    t, s = F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))
    out = df.select(
        F.lit(source).alias("source"), t.alias("title"), s.alias("summary"), F.concat(t, F.lit("\n"), s).alias("text"),
        published.alias("published"), url.alias("url"),
    )
    return out.filter(F.col("published").isNotNull())


def rss_records(items: DataFrame) -> DataFrame:
    """Parsed RSS items to records; the date is the first of published, updated, created that parses."""
    date = F.coalesce(parse_date("pubDate"), parse_date("updated"), parse_date("created"))
    return _record(items, "rss", "title", "description", date, F.col("link"))


def atom_records(entries: DataFrame) -> DataFrame:
    """Parsed Atom entries to records; only the published date counts."""
    link = F.coalesce(
        F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")[0]["_href"], F.col("link")[0]["_href"])
    return _record(entries, "arxiv", "title", "summary", parse_date("published"), link)


def _read(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One element per row. The closing tag is the record separator, so a large file is split at any place."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path)
    element = F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)$", 1)
    return rows.select(F.when(element != "", F.concat(element, F.lit(f"</{tag}>"))).alias("xml")).where("xml IS NOT NULL")


def read_rss(spark: SparkSession, path: str, start=None, end=None, max_docs: int | None = None) -> DataFrame:
    """Feed files under `path`: records in the date range, the newest `max_docs` of the source. Files split by item."""
    return _ranged(parse_items(_read(spark, path, "item"), "xml"), start, end, max_docs)


def read_atom(spark: SparkSession, path: str, start=None, end=None, max_docs: int | None = None) -> DataFrame:
    return _ranged(parse_items(_read(spark, path, "entry"), "xml", "atom"), start, end, max_docs)


def parse_items(xml: DataFrame, col: str, kind: str = "rss") -> DataFrame:
    """Records from a column holding one item (or entry) element per row."""
    schema = ITEM if kind == "rss" else ENTRY
    opts = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
    rows = xml.select(F.from_xml(col, schema, opts).alias("x")).select("x.*")
    return rss_records(rows) if kind == "rss" else atom_records(rows)


def _ranged(df: DataFrame, start, end, max_docs: int | None) -> DataFrame:
    df = between_dates(df, start, end)
    return cap_per_source(df, max_docs, id_col="url") if max_docs else df
