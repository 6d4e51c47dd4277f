"""Language identification with unigram pieces, summed over all segmentations.

The pieces are a public vocabulary (parameter `model`), never trained here. For every language the piece probabilities are
learned from text and language by expectation maximisation: the forward-backward sums over all ways to cut a word into pieces give
expected counts. A text's likelihood is the product over its words; a forward pass sums all segmentations of a word.
Words are runs of letters, lower-cased; longer runs than 40 characters are cut there, so that sums stay in range. A
character that is no piece is one unknown piece.

A text that is null or has no letter gets `und` and score 0. The score is the posterior of the chosen language, all
languages being equally likely before; ties go to the first language by name. Training reads at most about `per_language` rows of each language (chosen
by hash) and all languages; without any, every text is `und`. Rows are judged one by one,
so repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.arrays import blocks, mix, powers, tidy, word_hashes, word_spans
from driftline.session import settle, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BREAKS = np.ones(256, bool)
BREAKS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LONGEST = 40
REMEMBERED = 200_000  # words whose scores a task keeps
SAME = np.arange(256, dtype=np.uint8)


def vocabulary(model: str) -> list[str]:
    """Lower-case pieces of letters, with the mark of a word's start."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    every = (pieces.id_to_piece(k) for k in range(pieces.get_piece_size()))
    return sorted({p for p in every if (q := p.removeprefix("▁")) == q.lower() and (q.isalpha() or not q and p)})


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def _sub_hash(total: np.ndarray, down: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return mix((total[at + size] - total[at]) * down[at] + np.uint64(size))


def _totals(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=total[1:])
    return total, down


class Lattice:
    """Finds pieces at all places of many words at once, by substring hash."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        flat, offsets = _points(pieces)
        total, down = _totals(flat)
        lengths = np.diff(offsets)
        self.longest = int(lengths.max(initial=1))
        hashes = np.zeros(len(pieces), np.uint64)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            hashes[own] = _sub_hash(total, down, offsets[own], n)
        left, self.tables, shift = np.arange(len(pieces)), [], 0
        while len(left):  # pieces that share a slot go to another table
            slot = (hashes[left] >> np.uint64(shift)) & np.uint64((1 << 18) - 1)
            table = np.full(1 << 18, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append((shift, table))
            left, shift = left[table[slot] != left], shift + 9
        self.hashes = np.append(hashes, np.uint64(0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        for shift, table in self.tables:
            hit = table[(hashes >> np.uint64(shift)) & np.uint64((1 << 18) - 1)]
            out = np.where((hit >= 0) & (self.hashes[hit] == hashes), hit, out)
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(lengths, per piece length the piece at each place of each word, -1 if none); unknown characters are piece `size`."""
        flat, offsets = _points(["▁" + w for w in words])
        total, down = _totals(flat)
        lengths = np.diff(offsets)
        wide = int(lengths.max(initial=0))
        places = np.arange(wide)
        found = []
        for n in range(1, min(self.longest, wide) + 1):
            ids = np.full((len(words), wide), -1, np.int32)
            row, place = np.nonzero(places[None, :] + n <= lengths[:, None])
            ids[row, place] = self.find(_sub_hash(total, down, offsets[row] + place, n))
            if n == 1:
                ids[row, place] = np.where(ids[row, place] < 0, self.size, ids[row, place])
            found.append(ids)
        return lengths, found, places

    def forward(self, words: list[str], probs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sum over segmentations of every prefix; probs has a row per piece (unknown last) and a column per language."""
        lengths, found, _ = self.edges(words)
        wide = found[0].shape[1] if found else 0
        sums = np.zeros((wide + 1, len(words), probs.shape[1]))
        sums[0] = 1
        for end in range(1, wide + 1):
            for n in range(1, min(end, len(found)) + 1):
                ids = found[n - 1][:, end - n]
                on = np.flatnonzero(ids >= 0)
                if len(on):
                    sums[end, on] += sums[end - n, on] * probs[ids[on]]
        return lengths, sums, found

    def log_likelihood(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """(word, language): log of the sum over all segmentations; words of like length are worked on together."""
        out = np.zeros((len(words), probs.shape[1]))
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for lo in range(0, len(order), 4096):
            own = order[lo : lo + 4096]
            lengths, sums, _ = self.forward([words[k] for k in own], probs)
            with np.errstate(divide="ignore"):
                out[own] = np.log(sums[lengths, np.arange(len(own))])
        return out

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts of words of one language (probs has one column)."""
        out = np.zeros(self.size + 1)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for lo in range(0, len(order), 4096):
            own = order[lo : lo + 4096]
            lengths, sums, found = self.forward([words[k] for k in own], probs)
            wide = sums.shape[0] - 1
            back = np.zeros((wide + 1, len(own)))
            back[lengths, np.arange(len(own))] = counts[own] / np.maximum(sums[lengths, np.arange(len(own)), 0], 1e-300)
            for start in range(wide - 1, -1, -1):
                for n in range(1, min(wide - start, len(found)) + 1):
                    ids = found[n - 1][:, start]
                    on = np.flatnonzero(ids >= 0)
                    if len(on):
                        flow = probs[ids[on], 0] * back[start + n, on]
                        back[start, on] += flow
                        np.add.at(out, ids[on], flow * sums[start, on, 0])
        return out


def _pieces_of(word: str) -> list[str]:
    return [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]


def _lowered(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    column = pc.utf8_lower(pc.fill_null(batch.column(at), ""))
    return pa.RecordBatch.from_arrays([column if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 4000,
        rounds: int = 2, model: str = MODEL) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities): piece probabilities per language; the sample is bounded by `per_language`."""
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    langs = sorted(r.lang for r in sizes)
    pieces = vocabulary(model)
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, float(per_language / r["count"]))])
    dice = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(dice < part[F.col("lang")])
    number = {x: k for k, x in enumerate(langs)}

    def count(batches):
        for batch in batches:
            batch = _lowered(batch, 1)
            for own, data, offsets in blocks(batch, "text"):
                starts, ends, first = word_spans(data, offsets, BREAKS)
                hashes = word_hashes(data, starts, ends, SAME)
                lang = np.repeat([number[x] for x in own.column(0).to_pylist()], np.diff(first))
                keys = np.stack([lang.astype(np.uint64), hashes], 1)
                _, at, n = np.unique(keys, axis=0, return_index=True, return_counts=True)
                words = [bytes(data[starts[k] : ends[k]]).decode() for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(lang[at].astype(np.int32)), pa.array(words), pa.array(n)], ["lang", "word", "n"])

    counted = settle(chosen.mapInArrow(tidy(count), "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    probs = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    known = rows.sparkSession.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        now = rows.sparkSession.sparkContext.broadcast(probs)

        def expect(batches, now=now):
            lattice, total = Lattice(known.value), np.zeros_like(now.value)
            for batch in batches:
                lang, n = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(float)
                words = batch.column(1).to_pylist()
                for k in np.unique(lang).tolist():
                    own = np.flatnonzero(lang == k)
                    cut = [(p, n[j]) for j in own.tolist() for p in _pieces_of(words[j])]
                    total[:, k] += lattice.expected([p for p, _ in cut], np.array([x for _, x in cut]), now.value[:, k : k + 1])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], ["piece", "lang", "n"])

        sums = counted.mapInArrow(tidy(expect), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        table = np.full_like(probs, 0.1)  # every piece may come up
        table[sums["piece"], sums["lang"]] += sums["n"]
        probs = table / table.sum(0)
    return langs, np.round(probs, 12)


def predict(docs: DataFrame, fitted: tuple[list[str], np.ndarray], text_col: str = "text", model: str = MODEL, out: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """`docs` with two more columns: the most likely language and its posterior."""
    langs, probs = fitted
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    tool = spark.sparkContext.broadcast((vocabulary(model), probs))
    at = docs.columns.index(text_col)

    def run(batches):
        pieces, table = tool.value
        lattice = Lattice(pieces)
        known: dict[int, int] = {}
        scores = np.zeros((REMEMBERED, len(langs)))
        for batch in batches:
            lower = _lowered(batch, at)
            letters = pc.match_substring_regex(lower.column(at), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            total = []
            for _, data, offsets in blocks(lower, text_col):
                starts, ends, first = word_spans(data, offsets, BREAKS)
                hashes = word_hashes(data, starts, ends, SAME)
                unique, place, back = np.unique(hashes, return_index=True, return_inverse=True)
                if len(known) + len(unique) > len(scores):  # start anew, with room for the block at hand
                    known = {}
                    scores = scores if len(unique) <= len(scores) else np.zeros((len(unique), len(langs)))
                new = [k for k, h in enumerate(unique.tolist()) if h not in known]
                if new:
                    cut = [_pieces_of(bytes(data[starts[place[k]] : ends[place[k]]]).decode()) for k in new]
                    flat = lattice.log_likelihood([p for c in cut for p in c], table)
                    begin = np.cumsum([0] + [len(c) for c in cut])[:-1]
                    scores[len(known) : len(known) + len(new)] = np.add.reduceat(flat, begin, axis=0)
                    for k in new:
                        known[int(unique[k])] = len(known)
                rows = np.fromiter((known[h] for h in unique.tolist()), np.int64, len(unique))
                run_sum = np.concatenate([np.zeros((1, len(langs))), np.cumsum(scores[rows][back], axis=0)])
                total.append(run_sum[first[1:]] - run_sum[first[:-1]])
            sums = np.concatenate(total) if total else np.zeros((0, len(langs)))
            if langs:
                best = sums.argmax(1) if len(sums) else np.zeros(0, int)
                sure = 1 / np.exp(np.minimum(sums - sums.max(1, keepdims=True), 0)).sum(1) if len(sums) else np.zeros(0)
                names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters, strict=True)]
                sure = np.where(letters, sure, 0.0)
            else:
                names, sure = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure)], [*batch.schema.names, out, score])

    schema = docs.select(docs.columns).schema.add(out, "string").add(score, "double")
    return docs.mapInArrow(tidy(run), schema)
