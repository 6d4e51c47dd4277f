"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def build_session(app: str = "driftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; `conf` entries win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Centroids per (bin, source) keep many small buffers per task; do not fall back to sorting documents by key.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
        # Whole documents are wide rows; small batches keep worker memory flat.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


BATCH_ROWS = 2_000  # rows of an Arrow batch that holds whole documents


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to `BATCH_ROWS` rows, unless they are smaller: a batch of whole documents is kept by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    A local session without that setting (tests) gets a temporary folder; a cluster without it is an error, since
    a machine-local folder would lose data with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
    return context.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """Give a small plain scan one partition per core before work that is heavy per row.

    A scan that already has a partition for every core, which any large table has, is left alone. Only for scans:
    counting the partitions of a shuffled result would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Prepare a small result as the inner side of a join with something large.

    It is written out; while its files hold up to `max_bytes` it is broadcast, so the large side is not shuffled. A
    larger one joins like any table.
    """
    small = settle(df)
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return broadcast(small) if size <= max_bytes else small


def packed(df: DataFrame, rows_per_partition: int = 20_000) -> DataFrame:
    """Join the partitions of a settled table into fewer when they hold few rows each (a narrow step).

    Iterative fits start a job per step, so many near-empty partitions cost more than they help; one per core stays.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_partition))
    return df.coalesce(wanted) if wanted < df.rdd.getNumPartitions() else df


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files behind.

    Otherwise these stay on the executors' disks until the driver's JVM collects its garbage, which may be hundreds of jobs later. For
    queries that run once: a second action on the same data frame would have to shuffle anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Write `df` as a table into the shared folder and continue from there.

    Used where several later passes read the same costly result. The table survives the loss of any executor, cuts the
    lineage, and later passes read only the columns they need. The shuffle files of the write are freed with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/driftline-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
