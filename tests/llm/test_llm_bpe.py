"""Encoding against the tiktoken library on the same ranks and pattern; decoding as an exact round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from driftline.llm import bpe
from driftline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(texts, ranks):
    find = bpe.word_finder(public_tokenizers.PATTERN)
    return [[i for word in find(t.encode()) for i in bpe.merged(word.encode(), ranks)] for t in texts]


def test_every_character(ranks, library):
    """Letters, numbers and white space are the engine's, also where its Unicode version is older."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(x for c in every[k : k + 4000] for x in ("a", c, "1", c, "!", c, " ", c)) for k in range(0, len(every), 4000)]
    assert plain(texts, ranks) == [library.encode_ordinary(t) for t in texts]


def test_random_strings(ranks, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aábc 'stlé\n\t12!?字한😀") for _ in range(rng.randint(0, 200))) for _ in range(2000)] + ["ab" * 50_000, " " * 3000 + "x"]
    assert plain(texts, ranks) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("block", [{}, {"most_bytes": 500}, {"most_words": 7}])
def test_rows(spark, ranks, library, block):
    rng = random.Random(9)
    words = ["the", "narrative", "trajectório", "x1y2", "don't", "第一", "\n\n", "antidisestablishmentarianism"]
    rows = [(k, " ".join(rng.choices(words, [60, 9, 5, 5, 5, 5, 5, 5], k=rng.randint(1, 80)))) for k in range(300)]
    rows += [(5, None), (5, ""), (None, "the end"), (None, "the end"), (900, "word " * 30_000), (901, "<|endoftext|>"), (902, "z" * 5000)]
    df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], "doc_id long, text string, ids int, code int, block string").repartition(5)
    got = sorted(((r.id, list(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN, **block), ranks).collect()), key=repr)
    assert got == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)


def test_empty_and_unknown(spark, ranks):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0
    lists = spark.createDataFrame([(1, [0, 1], "x"), (2, [], "x"), (3, None, "x"), (4, [0, None], "x"), (5, [60_000], "x"), (6, [-1], "x")], "id long, ids array<int>, decoded string")
    token = {rank: t for t, rank in ranks.items()}
    assert {r.id: r.decoded for r in bpe.decode(lists, ranks).collect()} == {1: token[0] + token[1], 2: b"", 3: None, 4: None, 5: None, 6: None}


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        want[doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_bpe"](spark, folder).collect()} == want
