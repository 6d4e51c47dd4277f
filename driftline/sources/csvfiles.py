"""CSV files whose quoted fields may hold line breaks, read split by split.

A line break ends a record where an even number of quotes stands before it in the file. One pass counts the quotes of every split; adding them
up in the order of the splits tells with which parity each split begins. A second pass then cuts each split at its true record ends. A record
that goes on over the end of a split leaves a piece in every split it touches; the pieces, and only they, are brought together by the split in
which the record began. So a file of any size is read by many tasks, and none reads from a split but its own.

Files follow RFC 4180: quotes inside a quoted field are doubled, fields without quotes hold none. Lines end with LF or CRLF; empty records are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.session import settle


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(split, value): lines in file order; `split` is a hash of the file and the place where the split begins."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("split"), "value")


def _runs(split: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(split)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(split)])


def _odd(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2


def quote_parities(spark: SparkSession, path: str) -> DataFrame:
    """(split, at, open, owner) of every split: where it begins, whether a record is open there, and the split that record began in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, turned = None, 0, False

        def told():
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bool(odd)]), pa.array([turned])], ["split", "odd", "turned"])

        for batch in batches:
            split = batch.column(0).to_numpy()
            odds = _odd(batch.column(1))
            for a, b in _runs(split):
                if split[a] != now:
                    if now is not None:
                        yield told()
                    now, odd, turned = int(split[a]), 0, False
                before = (odd + np.cumsum(odds[a:b]) - odds[a:b]) % 2
                turned = turned or bool(before.any())  # a line of the split begins after an odd number of its quotes
                odd = int((odd + odds[a:b].sum()) % 2)
        if now is not None:
            yield told()

    rows = spark.read.option("lineSep", "\n").text(path)
    places = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).distinct()
    places = places.withColumn("split", F.xxhash64("file", "at"))
    told = _lines(spark, path).mapInArrow(count, "split long, odd boolean, turned boolean")
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # over splits, not lines
    splits = places.join(told, "split").withColumn("open", F.coalesce(F.sum(F.col("odd").cast("int")).over(order) % 2 == 1, F.lit(False)))
    begins = ~F.col("open") | F.col("turned")
    return settle(splits.select("split", "at", "open", F.last(F.when(begins, F.col("split")), ignorenulls=True).over(order).alias("owner")))


def _cut(spark: SparkSession, path: str, known, whole: bool) -> DataFrame:
    """(owner, at, record): the records that lie inside a split, or else the pieces of those that do not."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, owner, held, head, out = None, False, None, [], False, []

        def made():
            columns = zip(*out) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["owner", "at", "record"])

        def end(text, inside):
            if inside == whole:
                out.append((owner if head else now, known.value[now][0], text))

        for batch in batches:
            split, odds, texts = batch.column(0).to_numpy(), _odd(batch.column(1)), batch.column(1).to_pylist()
            for a, b in _runs(split):
                if split[a] != now:
                    if held:
                        end("\n".join(held), False)
                    now, held = int(split[a]), []
                    _, opened, owner = known.value[now]
                    head = opened
                for k in range(a, b):
                    held.append(texts[k])
                    opened = opened != bool(odds[k])
                    if not opened:
                        end("\n".join(held), not head)
                        held, head = [], False
            yield made()
            out.clear()
        if held:
            end("\n".join(held), False)
            yield made()

    return _lines(spark, path).mapInArrow(cut, "owner long, at long, record string")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): every record of the files as text, line breaks inside quotes included, in no particular order."""
    told = quote_parities(spark, path).collect()  # a few numbers per split
    known = spark.sparkContext.broadcast({r["split"]: (r["at"], r["open"], r["owner"]) for r in told})
    pieces = _cut(spark, path, known, False).groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("at", "record"))).alias("p"))
    joined = pieces.select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return _cut(spark, path, known, True).select("record").unionByName(joined)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of headerless CSV files; a record with too few fields has nulls, one with too many loses the rest."""
    record = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = csv_records(spark, path).select(record.alias("record")).where("record <> ''")
    return rows.select(F.from_csv("record", ddl, {"quote": '"', "escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
