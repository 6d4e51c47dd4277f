import numpy as np

from driftline.llm.decontaminate import contaminated, edit_distances, nearest_places, without_leaks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distances():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(60)]
    windows = [rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64) for _ in range(60)]
    assert edit_distances(items, windows)[0].tolist() == [distance(a, b) for a, b in zip(items, windows, strict=True)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k, how = int(rng.integers(len(words))), rng.integers(3)
        if how == 0:
            words[k] = f"new{rng.integers(99999)}"
        elif how == 1:
            words.insert(k, f"new{rng.integers(99999)}")
        else:
            del words[k]
    return words


def test_recall_and_precision(spark):
    """Items put into documents with up to 15% of their words edited are found; other documents are not."""
    rng = np.random.default_rng(8)
    pool = [f"w{k}" for k in range(3000)] + ["the", "of", "and", "in"] * 300
    items = [list(rng.choice(pool, rng.integers(12, 60))) for _ in range(60)]
    docs, planted = [], set()
    for k in range(400):
        text = list(rng.choice(pool, rng.integers(0, 300)))
        if k % 2:
            item = int(rng.integers(len(items)))
            put = edited(rng, items[item], int(len(items[item]) * 0.15 * rng.random()))
            at = int(rng.integers(len(text) + 1))
            text[at:at] = put
            planted.add((k, item))
        docs.append((k, " ".join(text).upper() if k % 3 == 0 else ", ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item) for r in contaminated(d, b).collect()}
    assert got <= planted
    assert len(got) >= 0.97 * len(planted)
    assert {r.doc_id for r in without_leaks(d, b).collect()} == set(range(400)) - {i for i, _ in got}


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "one two three"), (5, "x " * 5000 + item + " y" * 5000)]
    d = spark.createDataFrame([(*r, "a", 0) for r in rows], "doc_id long, text string, item string, words int")
    b = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "one two"), (None, item)], "item_id long, text string")
    assert sorted((r.id, r.item, r.distance, r.start) for r in contaminated(d, b).collect()) == [(1, 7, 0, 0), (5, 7, 0, 5000)]
    assert contaminated(d.limit(0), b).count() == contaminated(d, b.limit(0)).count() == 0
    assert without_leaks(d, b).count() == 4


def test_nearest_places():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(60)]
    windows = [rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    want = []
    for a, b in zip(items, windows, strict=True):
        each = [(*edit_distances([a], [b[s:]])[:, 0].tolist(), s) for s in range(len(b))] + [(len(a), 0, len(b))]
        want.append(min((d, s, n) for d, n, s in each))
    assert [tuple(x) for x in nearest_places(items, windows).T.tolist()] == want


def test_recall_at_the_limit(spark):
    """Items of 8 to 500 words with floor(0.2 n) edits spread over them are all found."""
    rng = np.random.default_rng(9)
    pool = [f"w{k}" for k in range(3000)] + ["the", "of", "and", "in"] * 300
    lengths = [n for n in (8, 9, 10, 14, 15, 20, 40, 60, 100, 200, 500) for _ in range(8)]
    items = [list(rng.choice(pool, n)) for n in lengths]
    docs = []
    for k, item in enumerate(items):
        text = list(rng.choice(pool, 200))
        text[100:100] = edited(rng, item, len(item) // 5)
        docs.append((k, " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item): r.distance for r in contaminated(d, b).collect()}
    missed = [lengths[k] for k in range(len(items)) if (k, k) not in got]
    assert missed == []
    assert all(n <= lengths[item] // 5 for (_, item), n in got.items())


def test_short_items_and_unspaced_scripts(spark):
    """Short items are found word by word, items in scripts without spaces by their characters."""
    chinese = "请计算下面这个三角形的面积并写出完整的推导过程"
    items = [(1, "Define the term osmosis"), (2, "yes"), (3, chinese), (4, "光合作用是什么"), (5, "ประเทศไทยมีกี่จังหวัด"), (6, "seven words are under the limit here")]
    docs = [(1, "Please define the term, osmosis! Now."), (2, "define the term diffusion"), (3, "yes and no"), (4, "Yes."), (5, "老师说，" + chinese.replace("完整", "全部") + "。谢谢"),
            (6, "问：光合作用，是什么？"), (7, "光合作用是"), (8, "ถาม ประเทศไทยมีกี่จังหวัดครับ"), (9, "so seven words are under the limit here too"), (10, "seven words are under a limit here"), (11, "完整的过程")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.id, r.item, r.distance) for r in contaminated(d, b).collect()) == [(1, 1, 0), (4, 2, 0), (5, 3, 2), (6, 4, 0), (8, 5, 0), (9, 6, 0)]
