"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit check.

A random walk over a word sequence copies a word per step and moves on or stays by a random bit of that word and step
(CGK). Sequences within a small edit distance fall into step again, so most steps agree: edit distance becomes Hamming distance. Keys
sample a few steps each, and `repeats` walks with new bits give each near pair several chances. The longer the item, the rarer a whole walk
survives, so every item is also keyed by its pieces: cut into one piece more than it may have edits, it leaves one piece
untouched in each near window. Candidates therefore miss no pair, at any item length; the walks alone would.

A window that comes near an item must hold many of the benchmark's word triples (each edit breaks three at most). The triples
lie in a bitmap of fixed size, so windows that cannot match are left out before the keys, without loss. Neighbouring windows travel as one
stretch, and stretch and item get the exact edit distance in words, free in where the item begins and ends, up to `tolerance` edits per item word.

Words are lower-cased runs of ASCII letters and digits and of any other characters; case and ASCII punctuation do not
matter. In scripts written without spaces (Han, kana, Thai, Lao, Khmer, Myanmar, Tibetan) every character is a word, and their punctuation does not
matter either. Items of fewer than `least` words are searched for word by word, without edits; those of one or two words, which
half a language may hold, only as a whole document. Null and empty texts, null ids and an empty benchmark match nothing; repeated rows are one
document; extra columns are not read. Very long texts are worked on whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrays import blocks, mix, runs_of, text_bytes, word_hashes, word_spans
from driftline.llm.bits import bitmap, held, parted
from driftline.session import settle

BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SAME = np.arange(256, dtype=np.uint8)
# Scripts written without spaces, their punctuation, and the UTF-8 lead bytes that these characters can have.
UNSPACED = (r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\x{30FC}\x{FF70}])"
            r"|[\x{3000}-\x{3003}\x{3008}-\x{3020}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]")
LEADS = np.zeros(256, bool)
LEADS[[0xE0, 0xE1, 0xE2, *range(0xE3, 0xEB), 0xEF, 0xF0]] = True
END = np.uint64(0x5BD1E995)  # the word after the last one


def _words(batch: pa.RecordBatch):
    """(id, word hashes) of every row."""
    text = pc.utf8_lower(pc.fill_null(batch.column(1), ""))
    if LEADS[text_bytes(text)[0]].any():
        text = pc.replace_substring_regex(text, UNSPACED, r" \1 ")
    lower = pa.RecordBatch.from_arrays([batch.column(0), text], ["id", "text"])
    for rows, data, offsets in blocks(lower, "text"):
        starts, ends, first = word_spans(data, offsets, BREAKS)
        yield rows.column(0), word_hashes(data, starts, ends, SAME), first


def length_class(n: np.ndarray) -> np.ndarray:
    """Classes of item lengths, four to a doubling."""
    return np.floor(np.log2(np.maximum(n, 1)) * 4).astype(np.int64)


def class_lengths(c: int) -> np.ndarray:
    n = np.arange(int(2 ** (c / 4)), int(2 ** ((c + 1) / 4)) + 2)
    return n[length_class(n) == c]


def allowed(n: np.ndarray, tolerance: float, least: int) -> np.ndarray:
    """Edits that items of n words may have."""
    return np.where(np.asarray(n) < least, 0, np.floor(np.asarray(n) * tolerance)).astype(np.int64)


def needed(c: int, tolerance: float, least: int) -> int:
    """Least number of word triples that a near window shares with an item of this class."""
    n = class_lengths(c)
    return max(0, int((n - 2 - 3 * allowed(n, tolerance, least)).min()))


def piece_lengths(c: int, tolerance: float, least: int) -> list[int]:
    """Lengths of the pieces of this class's items."""
    n = class_lengths(c)
    pieces = allowed(n, tolerance, least) + 1
    return sorted({*(n // pieces).tolist(), *(-(-n // pieces)).tolist()})


def piece_keys(runs: np.ndarray, c: int) -> np.ndarray:
    return mix(runs ^ mix(np.array([c + 1], np.uint64)))


def item_keys(own: np.ndarray, c: int, tolerance: float, least: int, repeats: int, samples: int) -> np.ndarray:
    """LSH keys of the item's walks, and a key per piece."""
    walks = walk_keys(own, np.zeros(1, np.int64), np.array([len(own)]), c, repeats, samples)[0]
    pieces = int(allowed(len(own), tolerance, least)) + 1
    cuts = np.arange(pieces + 1) * len(own) // pieces
    runs = [runs_of(own, size)[cuts[:-1][np.diff(cuts) == size]] for size in np.unique(np.diff(cuts)).tolist()]
    return np.unique(np.concatenate([walks, piece_keys(np.concatenate(runs), c)]))


def walk_keys(words: np.ndarray, at: np.ndarray, stop: np.ndarray, c: int, repeats: int, samples: int, seed: int = 1) -> np.ndarray:
    """(start, repeat): LSH keys of the walks that begin at the places `at`; from the place `stop` on there is only END."""
    steps = max(2, int(1.7 * class_lengths(c)[0]))
    samples = min(samples, steps)
    picks = np.zeros((steps, repeats), bool)
    for r in range(repeats):
        picks[np.random.default_rng([seed, c, r]).choice(steps, samples, replace=False), r] = True
    salts = mix(((np.arange(repeats)[None, :] * 4096 + np.arange(steps)[:, None]) * 2 + seed).astype(np.uint64))
    key = np.tile(mix((c * 1000 + np.arange(repeats)).astype(np.uint64)), (len(at), 1))
    place, stop = np.repeat(at[:, None], repeats, 1), stop[:, None]
    for step in range(int(np.flatnonzero(picks.any(1))[-1]) + 1):  # all starts and all repeats take a step at once
        word = words[np.minimum(place, len(words) - 1)]
        word[place >= stop] = END
        on = np.flatnonzero(picks[step])
        if len(on):
            key[:, on] = mix(key[:, on] * np.uint64(0x9E3779B97F4A7C15) + word[:, on])
        place += (mix(word ^ salts[step]) & np.uint64(1)).astype(np.int64)
    return key


def edit_distances(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Per pair, (least edits from the item to a beginning of the window, that beginning's length), all pairs in step."""
    n = np.array([len(x) for x in items])
    wide, deep = max(len(x) for x in windows), int(n.max())
    w = np.zeros((len(windows), wide), np.uint64)
    for k, x in enumerate(windows):
        w[k, : len(x)] = x
    t = np.zeros((len(items), deep), np.uint64)
    for k, x in enumerate(items):
        t[k, : len(x)] = x
    places = np.arange(wide + 1)
    past = places[None, :] > np.array([len(x) for x in windows])[:, None]
    row = np.broadcast_to(places, (len(items), wide + 1)).astype(np.int64)
    best, length = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(1, deep + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (w != t[:, i - 1 : i]))
        row = np.minimum.accumulate(new - places, axis=1) + places
        done = np.flatnonzero(n == i)
        if len(done):
            last = np.where(past[done], 1 << 30, row[done])
            length[done] = last.argmin(1)
            best[done] = last.min(1)
    return np.stack([best, length])


def nearest_places(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Per pair, (least edits from the item to any part of the window, that part's start, its length), all pairs in step."""
    n = np.array([len(x) for x in items])
    wide, deep = max(len(x) for x in windows), int(n.max())
    w = np.zeros((len(windows), wide), np.uint64)
    for k, x in enumerate(windows):
        w[k, : len(x)] = x
    t = np.zeros((len(items), deep), np.uint64)
    for k, x in enumerate(items):
        t[k, : len(x)] = x
    places = np.arange(wide + 1)
    past = places[None, :] > np.array([len(x) for x in windows])[:, None]
    edit = 1 << 32  # a cell holds edits and start as one number, so that the least cell has the first start too
    row = np.broadcast_to(places, (len(items), wide + 1)).astype(np.int64)
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(1, deep + 1):
        new = np.empty_like(row)
        new[:, 0] = i * edit
        new[:, 1:] = np.minimum(row[:, 1:] + edit, row[:, :-1] + (w != t[:, i - 1 : i]) * edit)
        row = np.minimum.accumulate(new - places * edit, axis=1) + places * edit
        done = np.flatnonzero(n == i)
        if len(done):
            last = np.where(past[done], 1 << 62, row[done])
            end[done] = last.argmin(1)
            best[done] = last.min(1)
    return np.stack([best // edit, best % edit, end - best % edit])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 tolerance: float = 0.2, repeats: int = 16, samples: int = 3, least: int = 8) -> DataFrame:
    """(id, item, item_words, distance, start, words): each document with each item it holds, at the nearest place found."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null")
    spark = docs.sparkSession

    def index(batches):
        for batch in batches:
            for ids, words, first in _words(batch):
                for k in range(len(ids)):
                    own = words[first[k] : first[k + 1]]
                    if not len(own):
                        continue
                    c = int(length_class(np.array([len(own)]))[0])
                    keys = item_keys(own, c, tolerance, least, repeats, samples)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k].as_py()]), pa.array([c], pa.int32()), pa.array([runs_of(own, 3).view(np.int64).tolist()], pa.list_(pa.int64())),
                                                      pa.array([keys.view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([own.tobytes()], pa.binary())],
                                                     ["item", "c", "triples", "keys", "words"])

    table = settle(items.mapInArrow(index, "item long, c int, triples array<long>, keys array<long>, words binary").withColumn("no", F.xxhash64("item", "words")))
    classes = sorted(r.c for r in table.select("c").distinct().collect())  # a few dozen: lengths in steps of a quarter doubling
    triples = bitmap(table.select(F.explode("triples").alias("h")), "h")
    keys = bitmap(table.select(F.explode("keys").alias("h")), "h")
    known = spark.sparkContext.broadcast((triples, keys))
    plan = [(c, needed(c, tolerance, least), int(class_lengths(c)[-1] * (1 + tolerance)) + 1, piece_lengths(c, tolerance, least)) for c in classes]

    def look(batches):
        in_triples, in_keys = known.value
        for batch in batches:
            for ids, words, first in _words(batch):
                if not len(words):
                    continue
                hit = np.zeros(len(words) + 1, np.int64)
                grams = held(in_triples, runs_of(words, 3))
                inner = first[(first > 0) & (first < len(words))]
                for back in (1, 2):
                    cross = inner - back
                    grams[cross[(cross >= 0) & (cross < len(grams))]] = False  # no triple goes on into the next row
                np.cumsum(grams, out=hit[1 : len(grams) + 1])
                hit[len(grams) + 1 :] = hit[len(grams)]
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                start, stop = first[:-1][row], first[1:][row]
                begin = np.arange(len(words))
                runs: dict[int, np.ndarray] = {}
                out: list[tuple] = []
                for c, least_hits, span, sizes in plan:
                    if sizes[-1] < 3:
                        passed = first[:-1][np.diff(first) == sizes[-1]]
                    else:
                        passed = np.flatnonzero(hit[np.minimum(begin + span, stop)] - hit[begin] >= least_hits)
                    if not len(passed):
                        continue
                    stretch = row * (1 << 32) + (begin - start) // span  # the windows that begin in the same `span` words of a document
                    open_, codes, keys_ = np.unique(stretch[passed]), [], []
                    for at in np.array_split(passed, len(passed) // 4096 + 1):
                        found = walk_keys(words, at, stop[at], c, repeats, samples)
                        j, r = np.nonzero(held(in_keys, found.ravel()).reshape(found.shape))
                        codes.append(stretch[at[j]])
                        keys_.append(found[j, r])
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, passed, 1)
                    np.add.at(edge, np.minimum(passed + span, stop[passed]), -1)
                    covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    for size in sizes:
                        if size not in runs:
                            runs[size] = runs_of(words, size)
                        at = covered[covered + size <= stop[covered]]
                        found = piece_keys(runs[size][at], c)
                        near = held(in_keys, found)
                        at, found = at[near], found[near]
                        for back in (0, 1):  # a piece lies in windows of its own stretch and of the one before
                            own = at >= start[at] + back * span
                            code = stretch[at[own]] - back
                            some = open_[np.minimum(np.searchsorted(open_, code), len(open_) - 1)] == code
                            codes.append(code[some])
                            keys_.append(found[own][some])
                    code, key = np.concatenate(codes), np.concatenate(keys_)
                    order = np.lexsort((key, code))
                    code, key = code[order], key[order]
                    new = np.ones(len(code), bool)
                    new[1:] = (code[1:] != code[:-1]) | (key[1:] != key[:-1])
                    code, key = code[new], key[new]
                    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else []
                    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                        k, at = int(code[lo] >> 32), int(code[lo] & 0xFFFFFFFF) * span
                        p = int(first[k]) + at
                        out.append((ids[k].as_py(), c, at, key[lo:hi].view(np.int64).tolist(), words[p : min(p + 2 * span, int(first[k + 1]))].tobytes()))
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "c", "start", "keys", "window"])

    windows = settle(docs.mapInArrow(look, "id long, c int, start int, keys array<long>, window binary").withColumn("w", F.xxhash64("id", "c", "start", "window")))
    hits = windows.select("w", F.explode("keys").alias("key")).join(table.select("no", F.explode("keys").alias("key")), "key").select("w", "no").distinct()
    pairs = hits.join(windows.select("w", "id", "start", "window"), "w").join(table.select("no", "item", F.col("words").alias("item_text")), "no")
    pairs = pairs.select("id", "start", "item", "window", "item_text")

    def check(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(3).to_pylist()]) // 8
            batch = batch.take(pa.array(np.argsort(sizes, kind="stable")))
            sizes.sort()
            lo = 0
            while lo < batch.num_rows:  # pairs of like length are worked on together, in bounded arrays
                n = max(1, min(512, (1 << 21) // int(sizes[min(lo + 511, batch.num_rows - 1)])))
                part = batch.slice(lo, n)
                lo += n
                windows_, items_ = ([np.frombuffer(x.as_py(), np.uint64) for x in part.column(k)] for k in (3, 4))
                distance, at, length = nearest_places(items_, windows_)
                n = np.array([len(x) for x in items_])
                start = part.column(1).to_numpy() + at
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(distance), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))],
                                                 ["id", "item", "item_words", "distance", "start", "words"])
                yield out.filter(pa.array(distance <= allowed(n, tolerance, least)))

    found = pairs.mapInArrow(check, "id long, item long, item_words long, distance long, start int, words int")
    return found.groupBy("id", "item", "item_words").agg(F.min(F.struct("distance", "start", "words")).alias("best")).select("id", "item", "item_words", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` without the documents that hold an item; rows with null id stay."""
    leaks = settle(contaminated(docs, benchmark, id_col, **options).select("id").distinct())
    clean, named = parted(docs, id_col, leaks)
    return clean.unionByName(named.join(leaks.withColumnRenamed("id", "_leak"), F.col(id_col) == F.col("_leak"), "left_anti"))
