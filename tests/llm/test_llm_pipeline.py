"""The pipeline against plain versions of its stages, on a small corpus with planted cases."""

import re

import numpy as np
import pytest
from test_llm_jaccard import brute as near_groups
from test_llm_mixing import plain as plain_mix

import corpus_pipeline

WORDS = {"en": "the house with a window and garden near some river was old but very beautiful in summer light".split(),
         "de": "das haus mit einem fenster und garten nahe am fluss war alt aber sehr schön im sommer licht".split()}
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    items = [(k, " ".join(f"bench{int(x)}" for x in rng.integers(0, 10**6, 20))) for k in range(8)]
    rows = []
    for k in range(240):
        lang = "de" if k % 3 == 0 else "en"
        text = " ".join(f"{w}" if rng.random() < 0.7 else f"{w}{rng.choice(WORDS[lang])}" for w in rng.choice(WORDS[lang], rng.integers(20, 90)))
        if k % 10 == 1:
            text = f"{text} mail k{k}@mail.example.com now"
        if k % 12 == 5:
            text = f"{text} {items[k % 8][1]} {text}"
        rows.append((k, text, lang, f"src{k % 5}" if k % 7 else None))
    rows += [(300 + k, rows[2][1] if k % 2 else rows[2][1] + " more", "en", "src0") for k in range(40)]
    rows += [(400, None, "en", "src1"), (401, "", "en", "src1"), (402, "123 456 !!", "en", "src2"), (3, rows[3][1], rows[3][2], rows[3][3]), (None, "the house with a garden", "en", "src0")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_run_equals_plain_stages(spark, corpus):
    folder, rows, items = corpus
    kept = [r for r in rows if r[1] and re.search("[^\\W\\d_]", r[1])]
    with_id = list({r[0]: r for r in kept if r[0] is not None}.values())
    heads = {c for _, c in near_groups([(r[0], r[1]) for r in with_id])[1].values()}
    kept = [r for r in with_id if r[0] in heads] + [r for r in kept if r[0] is None]
    kept = [r for r in kept if not any(t in r[1] for _, t in items)]
    kept = [(i, MAIL.sub("[EMAIL]", t), lang, s) for i, t, lang, s in kept]
    want = {i: (size, whole, target, taken) for i, size, whole, target, taken in plain_mix([(i, t, s) for i, t, _, s in kept]) if taken}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in got} == want
    text = {i: t for i, t, *_ in kept}
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in got)


def test_stages_keep_the_columns_and_take_empty_tables(spark, corpus):
    folder = corpus[0]
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, folder)
        assert out.count() == 0
        assert out.columns[: len(empty.columns)] == empty.columns and (len(out.columns) == len(empty.columns) or k == 4)
