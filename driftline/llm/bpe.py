"""Byte-level BPE over a given rank file: encode every distinct word of the corpus once, decode by the token-byte table.

Texts are cut into words by the pattern of the tokenizer. A block of documents (bounded in text and in distinct words) numbers its words; a
document becomes the numbers of its words, in the order of their positions, and the block lists its distinct words, dealt to shelves by a hash
of the word. The lists are shuffled by shelf, so that each distinct word of the corpus meets in one place and is encoded once; the ids go
back to the block, and every document is put together by position. What is shuffled is one entry per block and distinct word: a word that
fills a third of the corpus still gives one entry per block. The documents' numbers lie in a table bucketed by block and never travel again.

Every row of the input gives one row of the result; rows that repeat an id stay apart, null ids stay null, null texts count as empty and give no
ids. A text is encoded whole, however long; a block holds at least one text. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import shared_dir

BLOCK_BYTES = 16 << 20  # text of a block
BLOCK_WORDS = 1 << 18  # distinct words of a block
SHELF_WORDS = 1 << 18  # words whose ids a task remembers
SLICE = 1 << 20  # tokens decoded at a time
END = b"\xff"  # between words: no UTF-8 text holds this byte
# Letters and numbers of newer Unicode versions that the `regex` package knows and the tokenizer's own engine (Unicode 16) does not.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    r"\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks (which are their ids) of a file with one `base64 rank` a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: neighbours are merged by lowest rank, leftmost first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    ends = list(range(1, len(word) + 1))  # by start of a part: its end; -1 when the part is gone
    before = list(range(-1, len(word) - 1))
    waiting = [(rank, i, i + 2) for i in range(len(word) - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, k = heapq.heappop(waiting)
        j = ends[i]
        if j < 0 or j >= len(word) or ends[j] != k:
            continue
        ends[i], ends[j] = k, -1
        if k < len(word):
            before[k] = i
            if (rank := ranks.get(word[i : ends[k]])) is not None:
                heapq.heappush(waiting, (rank, i, ends[k]))
        if before[i] >= 0 and (rank := ranks.get(word[before[i] : k])) is not None:
            heapq.heappush(waiting, (rank, before[i], k))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


def _latin(pattern: str) -> str:
    """The pattern for texts of characters below U+0240 alone, with its classes spelled out, for the faster standard engine."""
    import regex

    listed = {k: "".join(f"\\u{c:04x}" for c in range(0x240) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in re.split(r"(\\p\{L\}|\\p\{N\}|\\[sS]|\\.|[\[\]])", pattern):
        inside = part == "[" or (inside and part != "]")
        out.append(listed[part] if inside and part in listed else f"[{listed[part]}]" if part in listed else f"[^{listed[chr(92) + 's']}]" if part == r"\S" else part)
    return "".join(out)


def word_finder(pattern: str):
    """A function that lists the words of a text (as UTF-8) as the tokenizer's engine would."""
    import regex

    latin, plain, newer = re.compile(_latin(pattern)), regex.compile(pattern), regex.compile(f"[{NEWER}]")
    older = regex.compile("(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEWER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEWER}]]"))
    low, common = bytes(range(0xC9)), bytes(range(0xD5))  # all bytes below U+0240; below all of NEWER

    def find(raw: bytes) -> list[str]:
        text = raw.decode("utf-8", "replace")
        if not raw.translate(None, low):
            return latin.findall(text)
        return (older if raw.translate(None, common) and newer.search(text) else plain).findall(text)

    return find


class _Numbers(dict):
    """Words by the order in which they were first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def numbered_words(docs: DataFrame, pattern: str, shelves: int, most_bytes: int = BLOCK_BYTES, most_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, id, codes, shelf, words) of rows (id, text).

    A row per document holds its words' numbers; a row per block and shelf the numbers and the text of the block's words on that shelf.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    names = ["block", "id", "codes", "shelf", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find = word_finder(pattern)
        block, size, numbers = TaskContext.get().partitionId() << 32, 0, _Numbers()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            start, codes = 0, []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or b""
                codes.append(np.fromiter(map(numbers.__getitem__, find(text)), np.int32))
                size += len(text)
                full = size >= most_bytes or len(numbers) >= most_words
                if full or k + 1 == batch.num_rows:
                    n = len(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), ids.slice(start, n), _lists(codes), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
                    start, codes = k + 1, []
                if full:
                    yield shelved(block, numbers, ids.type)
                    block, size, numbers = block + 1, 0, _Numbers()
        if numbers:
            yield shelved(block, numbers, ids.type)

    def shelved(block, numbers, id_type):
        words = sorted(numbers)
        shelf = np.fromiter((zlib.crc32(w.encode()) % shelves for w in words), np.int32)
        order = np.argsort(shelf, kind="stable")  # within a shelf in order of the text, which packs well
        number = np.fromiter(map(numbers.__getitem__, words), np.int32)[order]
        used, first = np.unique(shelf[order], return_index=True)
        parts = np.split(order, first[1:]) if len(used) else []
        packs = [zlib.compress(END.join([words[i].encode() for i in part]), 1) for part in parts]
        n = len(used)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.nulls(n, id_type), _lists(np.split(number, first[1:]) if n else []), pa.array(used), pa.array(packs, pa.binary())], names)

    return docs.select("id", "text").mapInArrow(cut, f"block long, id {id_type}, codes array<int>, shelf int, words binary")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Integer arrays as a column of lists."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` written as a table in the shared folder, bucketed by `key`: joins on the key read it where it lies."""
    spark = df.sparkSession
    name = f"driftline_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", **block) -> DataFrame:
    """(id, ids) for every row: the token ids of the whole text."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    shelves = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(numbered_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), pattern, shelves, **block), "block")
    known = spark.sparkContext.broadcast(ranks)  # bounded by the rank file

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, {}
        for batch in batches:
            packs = []
            for shelf, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if shelf != now or len(seen) > SHELF_WORDS:  # rows are sorted by shelf
                    now, seen = shelf, {}
                flat, n = [], []
                for word in zlib.decompress(words).split(END):
                    found = seen.get(word)
                    if found is None:
                        found = seen[word] = merged(word, known.value)
                    flat += found
                    n.append(len(found))
                packs.append(zlib.compress(np.array(n + flat, np.int32).tobytes(), 1))  # as many numbers of ids as words, then the ids
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packs, pa.binary())], ["block", "shelf", "pack"])

    words = blocks.where("shelf is not null").select("block", "shelf", "words")
    encoded = words.repartition(shelves, "shelf").sortWithinPartitions("shelf").mapInArrow(once, "block long, shelf int, pack binary")

    def by_position(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        shelf = texts.column("shelf").to_pylist()
        at = {s: k for k, s in enumerate(shelf) if s is not None}
        codes, starts = _flat(texts.column("codes"))
        size = sum(int(starts[k + 1] - starts[k]) for k in at.values())
        first, n, ids, total = np.zeros(size, np.int32), np.zeros(size, np.int32), [], 0  # by number of the word
        for s, pack in zip(found.column("shelf").to_pylist(), found.column("pack").to_pylist()):
            number = codes[starts[at[s]] : starts[at[s] + 1]]
            both = np.frombuffer(zlib.decompress(pack), np.int32)
            n[number] = both[: len(number)]
            first[number] = total + np.cumsum(n[number]) - n[number]
            ids.append(both[len(number) :])
            total += len(ids[-1])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        out, documents = [], [k for k, s in enumerate(shelf) if s is None]
        for k in documents:
            own = codes[starts[k] : starts[k + 1]]
            length = n[own]  # tokens of each word of the text, in order of position
            ends = np.cumsum(length)
            out.append(ids[np.repeat(first[own] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)])
        return pa.table([texts.column("id").take(pa.array(documents, pa.int64())), _lists(out)], ["id", "ids"])

    texts = blocks.select("block", "id", "codes", "shelf")
    return texts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(by_position, f"id {id_type}, ids array<int>")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and where each row's begin (one more entry than rows)."""
    parts = [c for c in column.chunks if len(c)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in parts])
    return values, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c.offsets.to_numpy()) for c in parts]))])


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of `encoded` and the bytes of its ids in column `out`, by a join with the token-byte table inside the tasks.

    The table has as many rows as the rank file. A null list, or one with a null or unknown id, gives null; `out` replaces a column of that name.
    """
    size = max(ranks.values(), default=-1) + 1
    tokens: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    table = encoded.sparkSession.sparkContext.broadcast(tokens)
    kept = [c for c in encoded.columns if c != out]
    at = kept.index(ids_col)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(table.value, pa.large_binary())
        for whole in batches:
            ends = np.cumsum(np.diff(whole.column(at).offsets.to_numpy()))
            row = 0
            while row < whole.num_rows:  # some rows at a time, so that work arrays stay small
                stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE, "right")))
                batch = whole.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*batch.columns, _joined(batch.column(at), known)], [*kept, out])
                row = stop

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out)
    return encoded.select(*kept).mapInArrow(join, f"{schema}, `{out}` binary")


def _joined(lists: pa.ListArray, known: pa.Array) -> pa.Array:
    """The bytes of each list of token ids, end to end."""
    ids = lists.flatten().fill_null(-1).to_numpy().astype(np.int64)
    sound = (ids >= 0) & (ids < len(known))
    parts = known.take(pa.array(np.where(sound, ids, 0), mask=~sound))
    valid = np.asarray(lists.is_valid())
    ends = np.concatenate([[0], np.cumsum(np.where(valid, np.diff(lists.offsets.to_numpy()), 0))])  # of the rows, in tokens
    lost = np.concatenate([[0], np.cumsum(~np.asarray(parts.is_valid()))])
    good = valid & (lost[ends[1:]] == lost[ends[:-1]])
    if not len(parts):
        return pa.array([b"" if g else None for g in good], pa.binary())
    at_byte = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset :][ends]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [pa.array(good).buffers()[1], pa.py_buffer(at_byte), parts.buffers()[2]]).cast(pa.binary())
