"""Arrow strings as NumPy bytes: words, word hashes and shingles of many documents at once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        for name, base in (("up", ODD), ("down", inverse)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[name] = np.multiply.accumulate(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def tidy(run: Callable) -> Callable:
    """`run` for mapInArrow; at its end the task gives freed memory back, since Spark keeps its workers for the stages to come."""

    def work(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return work


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each row starts (one more entry than rows). Null: empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = column.type == pa.large_string()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows with about `most` bytes of text, so that work arrays stay small."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (one more entry than rows). No word crosses rows."""
    inside = np.concatenate([~breaks[data], [False]])
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    start[edge] = inside[edge]
    stop = inside[:-1] & ~inside[1:]
    last = edge[edge > 0] - 1
    stop[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash per word, after each byte went through the table `fold`; equal words have equal hashes everywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[fold[data]] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, by its first word (the last size - 1 entries have no full run and are left out)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _STEP[0]
    for k in range(1, size):
        total = total + words[k : k + n] * _STEP[k % 64]
    return mix(total + np.uint64(size))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of one document in ascending order; fewer words than `size` form one shingle; no words: none."""
    if not len(words):
        return words
    return np.unique(runs_of(words, min(size, len(words))))
