"""Streaming ingest and trajectories: landing folder -> clean -> dedup -> windowed centroid sums -> trajectory."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.functions.text import normalize_text
from driftline.functions.vectors import cosine, doubles, unit


def read_landing(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def utc_instant(col: str):
    """A zone-less time as the instant with that UTC clock, whatever the session's zone; windows count in UTC."""
    return F.from_utc_timestamp(F.col(col).cast("timestamp"), F.current_timezone())


def clean_stream(stream: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Normalised text, usable dates, one row per url within the lateness bound."""
    rows = stream.withColumn("text", normalize_text("text")).withColumn("published", utc_instant("published"))
    rows = rows.filter(F.col("published").isNotNull()).withWatermark("published", lateness)
    return rows.dropDuplicatesWithinWatermark(["url"])


def window_sums(rows: DataFrame, width: str = "7 days", offset: str = "4 days", vec: str = "embedding") -> DataFrame:
    """Vector sum and count per window. Windows count from the epoch, a Thursday; a 4-day offset starts weeks on Monday."""
    return rows.filter(F.col(vec).isNotNull()).groupBy(F.window("published", width, width, offset).alias("w")).agg(
        vector_to_array(Summarizer.sum(array_to_vector(doubles(vec)))).alias("total"), F.count(F.lit(1)).alias("docs")
    ).select(F.to_utc_timestamp("w.start", F.current_timezone()).cast("timestamp_ntz").alias("time_bin"), "total", "docs")


def live_trajectory(centroids: DataFrame, concept_vec: list[float]) -> DataFrame:
    """Similarity of each window's centroid to a known concept vector."""
    c = F.array(*[F.lit(float(v)) for v in concept_vec])
    return centroids.select("time_bin", "docs", cosine(unit("centroid"), unit(c)).alias("value"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has landed so far into a Parquet sink, exactly once per checkpoint."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def run_merged(rows: DataFrame, path: str, checkpoint: str, width: str = "7 days", offset: str = "4 days", vec: str = "embedding") -> None:
    """Merge the window sums of everything that has landed into the versioned table at `path` (time_bin, total, docs).

    Sums add up, so rows may come late by any time and files in any order: a micro-batch is summed on its own, added to the newest version, and
    written as the next one. The stream itself keeps no state, the table one row per window. A version is complete or not there for
    readers; a batch that runs again after a failure starts from the version before it and replaces its own. Of the old versions the last one stays
    for readers that still hold it.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = [v for v in versions(spark, path) if v < number]
        table = window_sums(batch, width, offset, vec)
        if done:
            both = spark.read.parquet(_version(path, done[-1])).unionByName(table)
            table = both.groupBy("time_bin").agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("docs").alias("docs"))
        table.write.mode("overwrite").parquet(_version(path, number))
        for old in done[:-1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(_version(path, old))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def _version(path: str, number: int) -> str:
    return f"{path}/version={number:010d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, oldest first."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def merged_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(time_bin, centroid, docs) of the newest version."""
    table = spark.read.parquet(_version(path, versions(spark, path)[-1]))
    return table.select("time_bin", F.transform("total", lambda x: x / F.col("docs")).alias("centroid"), "docs")
