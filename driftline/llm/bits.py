"""A set of hashes as a bitmap of fixed size, made in Spark: what it keeps out is certainly not in the set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import freed_shuffles


def bitmap(values: DataFrame, column: str, log2: int = 23) -> np.ndarray:
    """Bits of the long `column` modulo 2^log2. At most 2^log2 / 64 rows reach the driver, whatever the table's size."""
    slot = F.pmod(F.col(column), F.lit(1 << log2))
    out = np.zeros(1 << (log2 - 6), np.uint64)
    with freed_shuffles(values.sparkSession):
        rows = values.where(F.col(column).isNotNull()).groupBy(F.shiftright(slot, 6).alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).collect()
    for r in rows:
        out[r.w] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    return out


def wide_bitmap(values: DataFrame, column: str, log2: int = 27, page: int = 15) -> np.ndarray:
    """As `bitmap`, larger: brought together in pages of 2^page bits, so the driver gets 2^(log2 - page) rows at most."""

    def pack(batches):
        for batch in batches:
            pages = []
            for bits in batch.column(1):
                own = np.zeros(1 << page, np.uint8)
                own[np.asarray(bits.values)] = 1
                pages.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.binary())], ["page", "bits"])

    slot = F.pmod(F.col(column), F.lit(1 << log2))
    slots = values.where(F.col(column).isNotNull()).select(slot.cast("int").alias("slot")).distinct()
    pages = slots.groupBy(F.shiftright("slot", page).alias("page")).agg(F.collect_list(F.col("slot").bitwiseAND((1 << page) - 1)).alias("slots"))
    out = np.zeros(1 << (log2 - 3), np.uint8)
    with freed_shuffles(values.sparkSession):
        rows = pages.mapInArrow(pack, "page int, bits binary").collect()
    for r in rows:
        out[r.page << (page - 3) : (r.page + 1) << (page - 3)] = np.frombuffer(r.bits, np.uint8)
    return out.view(np.uint64)


def held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the uint64 or int64 values may be in the set."""
    slot = values.astype(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def parted(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(others, named): rows that certainly have none of the long `ids` (column id), and the few that have to be joined with them.

    Both keep all columns; rows with a null id are others. Only the named ones need a shuffle.
    """
    known = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "id"))
    at = docs.columns.index(id_col)

    def pick(batches, inside):
        for batch in batches:
            column = batch.column(at)
            values = np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            rows = batch.filter(pa.array((held(known.value, values) & np.asarray(column.is_valid())) == inside))
            if rows.num_rows:
                yield rows

    return docs.mapInArrow(lambda b: pick(b, False), docs.schema), docs.mapInArrow(lambda b: pick(b, True), docs.schema)
