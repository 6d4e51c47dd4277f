"""Labelled news files (class, title, description) and other table inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftline.functions.text import class_name, join_title
from driftline.sources.csvfiles import read_csv

RAW = StructType([StructField(c, StringType()) for c in ("class", "title", "description")])


def label_rows(raw: DataFrame) -> DataFrame:
    """Typed labelled rows: a row whose class is not a number (a header) is dropped; category and text are added."""
    rows = raw.withColumn("class", F.col("class").try_cast("int")).filter(F.col("class").isNotNull())
    return rows.withColumn("category", class_name("class")).withColumn("text", join_title("title", "description"))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered and headerless files alike, without schema inference; files are split, line breaks in quotes or not."""
    return label_rows(read_csv(spark, path, RAW))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def attach_vectors(docs: DataFrame, vectors: DataFrame, doc_key: str, vec_key: str) -> DataFrame:
    """Reuse stored vectors: every document, with its embedding on the id or null where none is stored."""
    return docs.join(vectors.withColumnRenamed(vec_key, "__v"), F.col(doc_key) == F.col("__v"), "left").drop("__v")
