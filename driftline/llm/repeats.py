"""Repeated passages by an enhanced suffix array over sampled suffixes, scanned as a tree of common-prefix intervals.

Sampling: every string of `length` bytes holds a least hash among its grams of `gram` bytes, and equal strings hold it at
the same place. Only suffixes that start at such anchors are kept, about one in forty, with the bytes around them that a
string of `length` through the anchor can reach (its context).

1. Occurrences with one context: all but the first (smallest id, then start) repeat it. Tasks do this for their own
   rows first, so an anchor that a third of all documents share reaches the shuffle once per task.
2. Different contexts of one gram are sorted by what follows the anchor: a suffix array with the longest common prefixes
   of neighbours. A stack scan gives its intervals; inside an interval the left contexts are sorted too, and where they
   differ (left diversity) each member gets its longest match to the left with an earlier member. An interval with
   common prefix R and a member with left match L make a maximal repeat of L + R bytes; from `length` on it counts.
3. Grams with more than `most` different contexts (short frequent lines) get longer anchors until they fit: a string of `length` through the
   anchor that begins a bytes before it agrees in a bytes to the left and the rest to the right, so the range of all such a is halved, and
   contexts are grouped by the bytes that all strings of a half have in common. Groups that fit are scanned like any gram; where one string
   is left, its group repeats the first member. The result is the same.

Matches do not cross documents. Null text is empty, text shorter than `length` has no match; rows with null id are kept
whole; rows that repeat an id are the same document, and get the spans of all of them. Very long texts are worked on
whole. Extra columns are not read. Hashes have 64 bits per step (gram and context together 128).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrays import _BYTES, blocks, mix, powers, text_bytes
from driftline.llm.bits import bitmap, held
from driftline.session import lookup, settle, small_batches

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK = 1 << 19  # anchors a task gathers before it looks for repeats among them
CLASSES = 1 << 15  # contexts of frequent grams a task gathers for the same end
ANCHOR = "kind byte, g long, c long, id long, pos int, start int, stop int"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width]; entries without a full window use what there is."""
    out, have = x.copy(), 1
    while have * 2 <= width:
        out[: len(out) - have] = pick(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    if rest:
        out[: len(out) - rest] = pick(out[: len(out) - rest], out[rest:])
    return out


def _span_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchors of a block: (row, position in row, gram hash, context hash, context start, context end)."""
    n, width = len(data), length - gram + 1
    if n < length:
        return None
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    hashes = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    ends, starts = offsets[1:], offsets[:-1]
    cross = _span_mask(n, np.maximum(ends - gram + 1, starts), ends)[: len(hashes)]
    hashes[cross] = TOP
    least = _slide(hashes, width, np.minimum)
    least[_span_mask(n, np.maximum(ends - length + 1, starts), ends)[: len(hashes)]] = 0
    most = _slide(least[::-1], width, np.maximum)[::-1]
    at = np.flatnonzero((most == hashes) & ~cross)
    row = np.searchsorted(offsets, at, "right") - 1
    begin, stop = np.maximum(at - width + 1, offsets[row]), np.minimum(at + length, offsets[row + 1])
    shape = mix(((at - begin) * 4096 + (stop - at)).astype(np.uint64))
    context = mix((total[stop] - total[begin]) * down[begin] ^ shape)
    own = offsets[row]
    return row, at - own, hashes[at], context, begin - own, stop - own


def _sampled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors that are the first of their context in the task (kind 0), and spans that repeat one there (kind 1)."""

    def run(batches):
        held_back, n = [], 0

        def flush():
            g, c, i, p, s, e = (np.concatenate(x) for x in zip(*held_back, strict=True))
            order = np.lexsort((p, i, c, g))
            g, c, i, p, s, e = (x[order] for x in (g, c, i, p, s, e))
            once = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1])]  # a row given twice is no repeat
            g, c, i, p, s, e = (x[once] for x in (g, c, i, p, s, e))
            again = np.zeros(len(g), bool)
            again[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
            full = again & (e - s >= length)
            i1, s1, e1 = _merged(i[full], s[full], e[full])
            first = ~again
            kind = np.concatenate([np.zeros(first.sum(), np.int8), np.ones(len(i1), np.int8)])
            none = np.zeros(len(i1), np.int64)
            columns = [kind, np.concatenate([g[first].view(np.int64), mix(i1.view(np.uint64)).view(np.int64)]), np.concatenate([c[first].view(np.int64), none]),
                       np.concatenate([i[first], i1]), np.concatenate([p[first], s1]).astype(np.int32),
                       np.concatenate([s[first], s1]).astype(np.int32), np.concatenate([e[first], e1]).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "g", "c", "id", "pos", "start", "stop"])

        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                if (found := anchors(data, offsets, length, gram)) is None:
                    continue
                row, p, g, c, s, e = found
                ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                held_back.append((g, c, ids[row], p, s, e))
                n += len(g)
                if n >= CHUNK:
                    yield flush()
                    held_back, n = [], 0
        if n:
            yield flush()

    return docs.where("id is not null").mapInArrow(run, ANCHOR)


def _merged(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join spans of one id that overlap or touch."""
    if not len(ids):
        return ids, starts, stops
    order = np.lexsort((starts, ids))
    ids, starts, stops = ids[order], starts[order], stops[order]
    far = np.maximum.accumulate(stops + (np.cumsum(np.r_[True, ids[1:] != ids[:-1]]) << 40))
    new = np.r_[True, (ids[1:] != ids[:-1]) | (starts[1:] > (far[:-1] & ((1 << 40) - 1)))]
    at = np.flatnonzero(new)
    return ids[at], starts[at], np.maximum.reduceat(stops, at)


def _first_contexts(sampled: DataFrame, length: int, most: int) -> DataFrame:
    """Spans that repeat an earlier context (kind 1); first contexts of grams that have several (2; 3 if over `most`)."""
    names = ["kind", "g", "id", "pos", "start", "stop"]

    def run(batches):
        left: list[pa.Table] = []
        hot = None  # the gram whose rows are passed on as frequent

        def work(rows: pa.Table, frequent: bool):
            kind, g, c, i, p, s, e = (rows.column(k).to_numpy().copy() for k in range(7))
            spans = kind == 1
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | spans[1:] | spans[:-1]
            twin = np.r_[False, (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (i[1:] == i[:-1]) & (p[1:] == p[:-1])] & ~spans
            if frequent and last[0] is not None and last[0][:2] == (g[0], c[0]):
                new[0], twin[0] = False, last[0] == (g[0], c[0], i[0], p[0])
            last[0] = (g[-1], c[-1], i[-1], p[-1])
            group = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
            several = frequent | (np.bincount(group, new & ~spans) > 1)[group]
            repeat = ~spans & ~new & ~twin & (e - s >= length)
            kind[~spans & new & several] = 3 if frequent else 2
            kind[repeat] = 1
            keep = kind > 0
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (kind, g, i, p, s, e)], names)

        last: list = [None]
        for batch in batches:
            if not batch.num_rows:
                continue
            left.append(pa.Table.from_batches([batch]))
            rows = pa.concat_tables(left).combine_chunks()
            g = rows.column(1).to_numpy()
            if hot is not None:  # go on with the frequent gram
                stop = int(np.searchsorted(g != hot, True)) if g[-1] != hot else len(g)
                if stop:
                    yield work(rows.slice(0, stop), True)
                rows, g = rows.slice(stop), g[stop:]
                if not len(g):
                    left = []
                    continue
                hot = None
            cut = int(np.searchsorted(g, g[-1], "left"))  # the last gram may go on in the next batch
            if cut:
                yield work(rows.slice(0, cut), False)
            left = [rows.slice(cut)]
            if len(g) - cut > most and _several(left[0]) > most:
                hot, last[0] = g[-1], None
                yield work(left[0], True)
                left = []
        if left and left[0].num_rows:
            yield work(pa.concat_tables(left).combine_chunks(), False)

    def _several(rows: pa.Table) -> int:
        return len(np.unique(rows.column(2).to_numpy()))

    parts = sampled.repartition("g").sortWithinPartitions("g", "kind", "c", "id", "pos")
    return parts.mapInArrow(run, "kind byte, g long, id long, pos int, start int, stop int")


def _with_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text, grams, places): the documents named in `found`, with their anchors."""
    lists = found.groupBy("id").agg(F.collect_list("g").alias("grams"), F.collect_list(F.struct("kind", "pos", "start", "stop")).alias("places"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(lists, "id"))
    some = docs.where("id is not null").mapInArrow(lambda batches: _only(batches, bits.value), "id long, text string")
    return some.join(lists, "id")


def _only(batches, bits: np.ndarray, inside: bool = True):
    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        kept = batch.filter(pa.array((held(bits, ids) & np.asarray(batch.column(0).is_valid())) == inside))
        if kept.num_rows:
            yield kept


def _contexts(found: DataFrame, docs: DataFrame, kind: int = 2) -> DataFrame:
    """(g, id, pos, before, bytes) of anchors of a kind."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, text, grams, places in zip(*(batch.column(k) for k in range(4)), strict=True):
                raw = text.as_py().encode() if text.is_valid else b""
                for g, place in zip(grams.as_py(), places.as_py(), strict=True):
                    if place["stop"] <= len(raw):
                        out.append((g, i.as_py(), place["pos"], place["pos"] - place["start"], raw[place["start"] : place["stop"]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                                 ["g", "id", "pos", "before", "bytes"])

    return _with_text(found.where(F.col("kind") == kind), docs).mapInArrow(run, "g long, id long, pos int, before int, bytes binary")


def _words_of(cells: list[bytes], size: int) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit words, padded with zeros."""
    wide = -(-size // 8) * 8
    return np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in cells), np.uint8).reshape(len(cells), wide)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows of a and b, at most `most`."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def lcp_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, common prefix) of every interval of a suffix array; lcp[k] is that of entries k and k + 1."""
    out, stack = [], []
    for k, value in enumerate([*lcp.tolist(), -1]):
        first = k
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            out.append((first, k, depth))
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return out


def _left_matches(lefts: np.ndarray, sizes: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Per member, the longest common left context with any earlier member (-1 if there is none)."""
    words = lefts.view(">u8")
    order = np.lexsort([sizes, *words.T[::-1]])
    near = _common(lefts[order[1:]], lefts[order[:-1]], np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    best = np.full(len(age), -1, np.int64)
    for seq, gaps in ((order, near), (order[::-1], near[::-1])):
        stack: list[list[int]] = []  # (age, least common length up to the present member), ages rising
        for k, member in enumerate(seq.tolist()):
            run = int(gaps[k - 1]) if k else 0
            for entry in reversed(stack):
                if entry[1] <= run:
                    break
                entry[1] = run
            while stack and stack[-1][0] > age[member]:  # later ones are no use to those that follow: this one is nearer
                stack.pop()
            if stack:
                best[member] = max(best[member], stack[-1][1])
            stack.append([int(age[member]), 1 << 30])
    return best


def scan_group(rights: np.ndarray, right_sizes: np.ndarray, lefts: np.ndarray, left_sizes: np.ndarray, age: np.ndarray, length: int):
    """Maximal repeats through one anchor: (common right part R, members, their left match with an earlier member).

    rights and lefts are sorted by the right part; lefts run away from the anchor.
    """
    lcp = _common(rights[1:], rights[:-1], np.minimum(right_sizes[1:], right_sizes[:-1]))
    rank = np.empty(len(age), np.int64)
    rank[np.lexsort([left_sizes, *lefts.view(">u8").T[::-1]])] = np.arange(len(age))
    for first, last, depth in lcp_intervals(lcp):
        need = length - depth
        own = left_sizes[first : last + 1]
        if np.count_nonzero(own >= need) < 2:
            continue
        members = first + np.flatnonzero(own >= need)
        members = members[np.argsort(rank[members])]
        near = _common(lefts[members[1:]], lefts[members[:-1]], np.minimum(left_sizes[members[1:]], left_sizes[members[:-1]]))
        close = near >= need
        if not close.any():
            continue
        members = members[np.r_[False, close] | np.r_[close, False]]  # the others agree with nobody in enough bytes
        if len(members) == 2:
            yield depth, members[[age[members].argmax()]], near[close]
            continue
        sizes = left_sizes[members]
        if (lefts[members] == lefts[members[0]]).all() and (sizes == sizes[0]).all():  # no left diversity: all reach the whole context
            matches = np.where(age[members] == age[members].min(), -1, sizes)
        else:
            matches = _left_matches(np.ascontiguousarray(lefts[members]), sizes, age[members])
        yield depth, members, matches


def _tree(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans that repeat an earlier string, from the interval trees of all grams."""
    reach = length - gram

    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            g = rows.column(0).to_numpy()
            cut = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0
            rest = rows.slice(cut)
            if cut:
                yield work(rows.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield work(rest)

    def work(rows: pa.Table):
        ids, starts, stops = [], [], []
        g, i, p, before = (rows.column(k).to_numpy() for k in range(4))
        cells = rows.column(4).to_pylist()
        for lo, hi in _ranges(g, 1 << 15):
            block(g[lo:hi], i[lo:hi], p[lo:hi].astype(np.int64), before[lo:hi].astype(np.int64), cells[lo:hi], ids, starts, stops)
        one = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, starts, stops)]
        i1, s1, e1 = _merged(*(x.astype(np.int64) for x in one))
        return pa.RecordBatch.from_arrays([pa.array(i1), pa.array(s1.astype(np.int32)), pa.array(e1.astype(np.int32))], ["id", "start", "stop"])

    def block(g, i, p, before, cells, ids, starts, stops):
        rights = _words_of([c[b:] for c, b in zip(cells, before, strict=True)], length)
        lefts = _words_of([c[:b][::-1] for c, b in zip(cells, before, strict=True)], reach)
        after = np.fromiter((len(c) for c in cells), np.int64, len(cells)) - before
        order = np.lexsort([after, *rights.view(">u8").T[::-1], g])
        g, i, p, before, after, rights, lefts = (x[order] for x in (g, i, p, before, after, rights, lefts))
        age = np.empty(len(g), np.int64)
        age[np.lexsort((p, i))] = np.arange(len(g))
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        # Two members make one interval: all such grams at once.
        a = first[size == 2]
        b = a + 1
        right = _common(rights[a], rights[b], np.minimum(after[a], after[b]))
        left = _common(lefts[a], lefts[b], np.minimum(before[a], before[b]))
        good = right + left >= length
        later = np.where(age[a] > age[b], a, b)[good]
        ids.append(i[later])
        starts.append(p[later] - left[good])
        stops.append(p[later] + right[good])
        for lo, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = slice(lo, lo + n)
            for depth, members, matches in scan_group(rights[own], after[own], lefts[own], before[own], age[own], length):
                good = matches + depth >= length
                good &= matches >= 0
                if good.any():
                    m = members[good] + lo
                    ids.append(i[m])
                    starts.append(p[m] - matches[good])
                    stops.append(p[m] + depth)

    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(run, "id long, start int, stop int")


def _ranges(g: np.ndarray, most: int):
    """Cuts between groups, about `most` rows each."""
    lo = 0
    while lo < len(g):
        hi = min(len(g), lo + most)
        hi = len(g) if hi == len(g) else max(int(np.searchsorted(g, g[hi], "left")), int(np.searchsorted(g, g[lo], "right")))
        yield lo, hi
        lo = hi


def _longer_anchors(contexts: DataFrame, length: int, gram: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(groups, spans): the contexts of frequent grams in groups of at most `most`, as (g, id, pos, before, bytes), and spans found on the way.

    Members of a group share `r` bytes from the anchor on and `l` before it; it is for strings that begin l to length - r bytes before the anchor.
    Where a task's rows agree in all that those strings reach, the first goes on and the others repeat it, as far as they reach: a passage that
    many documents share is halved once a task, not once a document and string.
    """

    def split(batches):
        firsts: dict[tuple, tuple] = {}
        again: list[tuple[int, int, int]] = []

        def flush():
            i1, s1, e1 = (x.tolist() for x in _merged(*(np.array(x, np.int64) for x in zip(*again, strict=True)))) if again else ((), (), ())
            out = [(0, *row, 0, 0) for row in firsts.values()] + [(1, 0, 0, i, 0, 0, None, 0, 0, s, e) for i, s, e in zip(i1, s1, e1, strict=True)]
            firsts.clear()
            again.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for g, i, p, before, cell, r, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                half, after = (length - r - left + 1) // 2, len(cell) - before
                for right, more in ((r + half, left), (r, length - r - half + 1)):
                    back, on = min(before, length - right), min(after, length - more)  # as far as strings of this half reach
                    if right > after or more > before or back + on < length:
                        continue
                    part = (g, right, more, back, cell[before - back : before + on])
                    old = firsts.get(part)
                    if old is None or (i, p) < old[2:4]:
                        shared = cell[before - more : before + right]
                        key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=more.to_bytes(2, "big")).digest(), "big", signed=True)
                        firsts[part] = (g, key, i, p, before, cell, right, more)
                    late = max((i, p), old[2:4]) if old else None
                    if late and (i, p) != old[2:4]:
                        again.append((late[0], late[1] - back, late[1] + on))
            if len(firsts) + len(again) >= CLASSES:
                yield flush()
        if firsts:
            yield flush()

    kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    names = ["kind", "g", "key", "id", "pos", "before", "bytes", "r", "l", "start", "stop"]
    rows = settle(contexts.select("g", F.col("g").alias("key"), "id", "pos", "before", "bytes", F.lit(gram).alias("r"), F.lit(0).alias("l")))
    groups = spans = None
    while True:
        sizes = lookup(rows.groupBy("g", "key").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first")).where("n > 1"))
        several = settle(rows.join(sizes, ["g", "key"]))
        fits = several.where(F.col("n") <= most).select(F.col("key").alias("g"), "id", "pos", "before", "bytes")
        groups = fits if groups is None else groups.unionByName(fits)
        large = several.where(F.col("n") > most)
        if large.isEmpty():
            return groups, spans
        last = large.where((F.col("r") + F.col("l") >= length) & (F.struct("id", "pos") > F.col("first")))
        told = last.select("id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop"))
        spans = told if spans is None else spans.unionByName(told)
        parts = large.where(F.col("r") + F.col("l") < length).select("g", "id", "pos", "before", "bytes", "r", "l")
        halves = settle(parts.mapInArrow(split, "kind byte, g long, key long, id long, pos int, before int, bytes binary, r int, l int, start int, stop int"))
        spans = spans.unionByName(halves.where("kind = 1").select("id", "start", "stop"))
        rows = halves.where("kind = 0").drop("kind", "start", "stop")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 24, most: int = 2048) -> DataFrame:
    """(id, start, stop): byte spans whose every byte lies in a string of `length` bytes that also starts earlier."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = settle(_first_contexts(_sampled(docs, length, gram), length, most))
    spans = found.where("kind = 1").select("id", "start", "stop")
    spans = spans.unionByName(_tree(_contexts(found, docs), length, gram))
    if found.where("kind = 3").limit(1).count():
        groups, told = _longer_anchors(_contexts(found, docs, 3), length, gram, most)
        spans = spans.unionByName(_tree(groups, length, gram))
        spans = spans if told is None else spans.unionByName(told)
    return spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row: what is left without the repeated bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = settle(repeated_spans(docs, id_col, text_col, **options).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(spans, "id"))

    def cut(batches):
        for batch in batches:
            out = []
            spans_at = batch.schema.get_field_index("spans")
            for k in range(batch.num_rows):
                raw = (batch.column(1)[k].as_py() or "").encode()
                own = batch.column(spans_at)[k].as_py() if spans_at >= 0 else None
                kept, at, gone, n = [], 0, 0, 0
                if own:
                    s, e = (np.array([x[f] for x in own], np.int64) for f in ("start", "stop"))
                    _, s, e = _merged(np.zeros(len(s), np.int64), s, np.minimum(e, len(raw)))
                    for lo, hi in zip(s.tolist(), e.tolist(), strict=True):
                        if hi > lo:
                            kept.append(raw[at:lo])
                            at, gone, n = hi, gone + hi - lo, n + 1
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((batch.column(0)[k].as_py(), len(raw), gone, n, hashlib.sha256(rest).hexdigest()) + ((rest,) if keep_text else ()))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    # Documents without a span are finished where they are read; only the others travel to meet their spans.
    clean = rows.mapInArrow(lambda b: _only(b, bits.value, False), "id long, text string").mapInArrow(cut, schema)
    rest = rows.mapInArrow(lambda b: _only(b, bits.value), "id long, text string").join(spans, "id", "left").mapInArrow(cut, schema)
    return clean.unionByName(rest)
