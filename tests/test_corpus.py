from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.operators import corpus as ops
from driftline.operators import ranking
from driftline.sources import csvfiles, feeds, labelled, sinks


def days(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, published timestamp_ntz")


def test_date_bounds_inclusive(spark):
    df = days(spark, dt(2024, 1, 1), dt(2024, 1, 2), dt(2024, 1, 3), None)
    assert ops.between_dates(df, dt(2024, 1, 1), dt(2024, 1, 2)).count() == 2
    assert ops.between_dates(df, None, dt(2024, 1, 2)).count() == 2
    assert ops.between_dates(df, dt(2024, 1, 2)).count() == 2


def test_bins_at_borders(spark):
    df = days(spark, dt(2022, 1, 1), dt(2022, 1, 2), dt(2022, 1, 3), dt(2022, 3, 31, 23, 59))
    got = df.select(*[ops.bin_start("published", f).alias(f) for f in "DWMQ"]).collect()
    assert [r["W"] for r in got] == [dt(2021, 12, 27), dt(2021, 12, 27), dt(2022, 1, 3), dt(2022, 3, 28)]
    assert got[3]["M"] == dt(2022, 3, 1) and got[3]["Q"] == dt(2022, 1, 1) and got[3]["D"] == dt(2022, 3, 31)


def test_default_window_counts_back_from_newest(spark):
    df = days(spark, dt(2023, 12, 31), dt(2024, 1, 1), dt(2024, 6, 29))
    assert {r["doc_id"] for r in ops.default_window(df, 180).collect()} == {1, 2}


def test_clean_corpus(spark):
    a = spark.createDataFrame([("Té", None, dt(2024, 1, 1)), ("x", "y", None)], "title string, text string, published timestamp_ntz")
    b = spark.createDataFrame([(" hi  there ", dt(2024, 1, 2))], "text string, published timestamp_ntz")
    out = ops.clean_corpus([a, b])
    rows = sorted(out.collect(), key=lambda r: r["published"])
    assert [(r["title"], r["text"]) for r in rows] == [("T", ""), ("", "hi there")]
    assert sorted(r["doc_id"] for r in rows) == [0, 1]


def test_number_rows_dense(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 <> 0").withColumn("v", F.col("id") * 2)
    ids = [r["n"] for r in ops.number_rows(df, "n").orderBy("id").collect()]
    assert sorted(ids) == list(range(666))


def test_hash_rank_equals_window_with_hot_and_null_groups(spark):
    from pyspark.sql import Window

    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 17).cast("string"))))
    w = Window.partitionBy("g")
    want = df.select("id", F.row_number().over(w.orderBy(ranking.seeded_hash("id"), "id")).alias("rank"), F.count(F.lit(1)).over(w).alias("rank_size"))
    got = ranking.hash_rank(df, ["g"], "id", digits=1).select("id", "rank", "rank_size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ranking.hash_rank(df, [], "id").agg(F.max("rank")).first()[0] == 3000


def test_split_shares_and_folds(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "a").otherwise("b"))
    got = {(r["g"], r["split"]): r["count"] for r in ranking.stratified_split(df, "g", "id").groupBy("g", "split").count().collect()}
    assert got == {("a", "test"): 140, ("a", "train"): 560, ("b", "test"): 60, ("b", "train"): 240}
    folds = ranking.stratified_folds(df, "g", "id", 4).groupBy("g", "fold").count().collect()
    assert {r["count"] for r in folds if r["g"] == "a"} == {175} and {r["count"] for r in folds if r["g"] == "b"} == {75}


def test_tiny_class_has_no_test_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id long, g string")
    assert {r["split"] for r in ranking.stratified_split(df, "g", "id").collect()} == {"train"}


def test_top_per_key(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    got = ranking.top_per_key(df, ["k"], [F.col("id").desc()], 5, "id", salts=8)
    by = {}
    for r in df.collect():
        by.setdefault(r["k"], []).append(r["id"])
    want = {(k, i) for k, ids in by.items() for i in sorted(ids, reverse=True)[:5]}
    assert {(r["k"], r["id"]) for r in got.collect()} == want


def test_running_totals(spark):
    rows = [(k, float((i * 37) % 101) / 7, i % 5) for k in ("a", "b") for i in range(101)]
    df = spark.createDataFrame(rows, "k string, s double, v long")
    got = {(r["k"], r["s"]): r["v_before"] for r in ranking.running_totals(df, ["k"], "s", ["v"], buckets=8).collect()}
    for k in ("a", "b"):
        total = 0
        for _, s, v in sorted(r for r in rows if r[0] == k):
            assert got[(k, s)] == total
            total += v


def test_seeded_sample(spark):
    df = spark.range(500)
    a = {r["id"] for r in ranking.sample_rows(df, 50, "id").collect()}
    b = {r["id"] for r in ranking.sample_rows(df.repartition(5), 50, "id").collect()}
    assert a == b and len(a) == 50 and ranking.sample_rows(df, 9999, "id").count() == 500


def test_labelled_csv_both_header_modes(spark, tmp_path):
    body = '3,"Oil, up","He said ""more""\nlines"\n1,World title,\n'
    (tmp_path / "with.csv").write_text("Class Index,Title,Description\n" + body)
    (tmp_path / "without.csv").write_text(body)
    for name in ("with.csv", "without.csv"):
        rows = labelled.read_labelled_csv(spark, str(tmp_path / name)).orderBy("class").collect()
        assert [(r["class"], r["category"], r["text"]) for r in rows] == [
            (1, "World", "World title. "), (3, "Business", 'Oil, up. He said "more"\nlines')]


@pytest.mark.parametrize("split", [64, 200, 5000, 1 << 20])
def test_csv_with_line_breaks_in_many_splits(spark, tmp_path, split):
    """Row for row what the csv module reads, whatever the size of a split; some records are longer than several splits."""
    import csv
    import random

    rng = random.Random(split)
    parts = ["a b", '"', "\n", "\r\n", ",", "é😀", "", " ", "x" * 30, '""', "\n\n"]
    rows = [(str(k), "".join(rng.choices(parts, k=rng.randint(0, 8))), "".join(rng.choices(parts, k=rng.choice([1, 3, 200])))) for k in range(120)]
    folder = tmp_path / "csv"
    folder.mkdir()
    for f, end in ((0, "\n"), (1, "\r\n")):
        with open(folder / f"{f}.csv", "w", newline="", encoding="utf-8") as file:
            csv.writer(file, quoting=csv.QUOTE_ALL, lineterminator=end).writerows(rows[f::2])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        if split < 1000:
            assert csvfiles.quote_parities(spark, str(folder)).count() > 20
        got = csvfiles.read_csv(spark, str(folder), labelled.RAW).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    plain = lambda v: v or ""
    assert sorted((plain(r[0]), plain(r[1]), plain(r[2])) for r in got) == sorted(rows)


RSS = """<?xml version="1.0"?><rss><channel><title>feed</title>
<item><title>One</title><description>Body &amp; more</description><link>u1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0200</pubDate></item>
<item><title>Two</title><link>u2</link><pubDate>not a date</pubDate><updated>2024-02-03T04:05:06Z</updated></item>
<item><title>Three</title><description>no date</description><link>u3</link></item>
<item><title>Four</title><description>d</description><link>u4</link><created>2024-03-01</created></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom">
<entry><title>A</title><summary>S</summary><published>2024-01-05T00:00:00Z</published><link href="pdf" rel="related"/><link href="abs" rel="alternate"/></entry>
<entry><title>B</title><summary>S</summary><updated>2024-01-05T00:00:00Z</updated><link href="x"/></entry>
</feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "rss.xml").write_text(RSS)
    (tmp_path / "atom.xml").write_text(ATOM)
    got = {r["url"]: r for r in feeds.read_rss(spark, str(tmp_path / "rss.xml")).collect()}
    assert set(got) == {"u1", "u2", "u4"}
    assert got["u1"]["published"] == dt(2024, 1, 1, 8) and got["u1"]["text"] == "One\nBody & more"
    assert got["u2"]["published"] == dt(2024, 2, 3, 4, 5, 6) and got["u2"]["text"] == "Two\n"
    assert feeds.read_rss(spark, str(tmp_path / "rss.xml"), dt(2024, 2, 1), max_docs=1).first()["url"] == "u4"
    atom = feeds.read_atom(spark, str(tmp_path / "atom.xml")).collect()
    assert [(r["title"], r["url"], r["published"]) for r in atom] == [("A", "abs", dt(2024, 1, 5))]


def test_series_sink(spark, tmp_path):
    df = days(spark, dt(2023, 1, 1), dt(2024, 1, 1)).withColumnRenamed("published", "time_bin")
    sinks.write_series(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("year = 2024").count() == 1


def test_stats_and_pairs(spark):
    df = days(spark, dt(2024, 1, 1), dt(2024, 1, 31)).withColumn("source", F.lit("s"))
    assert {r["source"]: r["span_days"] for r in ops.ingest_stats(df).collect()} == {"s": 30, "*": 30}
    pairs = spark.createDataFrame([(1, "long enough title", "x" * 41), (2, "short", "x" * 50), (3, None, "x" * 50), (4, "long enough title", "x" * 40)],
                                  "doc_id long, title string, text string")
    assert [r["doc_id"] for r in ops.weak_pairs(pairs).collect()] == [1]


def test_slots(spark):
    out = ops.spread_over_bins(spark.createDataFrame([(0,), (95,), (96,)], "doc_id long"), "doc_id", "W", 24).orderBy("doc_id").collect()
    assert [r["published"] for r in out] == [dt(2022, 1, 1), dt(2023, 10, 28), dt(2022, 1, 1)]
