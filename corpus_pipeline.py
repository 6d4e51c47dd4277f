"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, source mix.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents; the last one adds the
mix. Null texts, null ids, repeated rows and empty tables pass as the operators define them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, jaccard, langid, mixing, privacy
from driftline.llm.bits import parted
from driftline.session import settle, shared_dir

LEAST_SCORE = 0.5  # posterior below which a language counts as not identified


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without a letter and undecided ones go."""
    fitted = langid.fit(docs.select("text", "lang"))
    judged = langid.predict(docs, fitted, out="_lang", score="_score")
    return judged.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, once. Rows without an id stay."""
    heads = jaccard.near_duplicates(docs).select("id", "component")
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    judged = settle(heads.join(twice, "id").where("id <> component or n > 1"))
    single, named = parted(docs, "doc_id", judged)
    kept = named.join(judged.where("id <> component").select(F.col("id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_anti")
    return single.unionByName(kept.dropDuplicates(["doc_id"]))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts sanitised and n_chars counted anew."""
    return privacy.sanitised(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, target of the source and words taken."""
    sized = docs.withColumns({"size": mixing.words("text"), "hash": mixing.document_hash("doc_id")})
    plan = mixing.plan(settle(sized.select("source", "size", "hash")))
    return mixing.taken(sized, plan).drop("hash").where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

ORACLE_SQL = None  # language, leaks and sanitising have no SQL form; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
