from pyspark.sql import functions as F

from driftline.functions import text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("o")).first()["o"]


def test_normalize_edges(spark):
    cases = {
        None: "", "": "", "  a  b ": "a b", "a b": "a b", "see http://x.y/z?q=1 now": "see now", "end https://x.y": "end",
        "a\x0bb\x1cc\td": "a b c d", "éè": "", "cafés": "caf s", "url http://x.y after": "url after",
    }
    for raw, want in cases.items():
        assert one(spark, raw, text.normalize_text("t")) == want, raw


def test_mentions_modes(spark):
    assert one(spark, "New SOFTWARE", text.mentions("t", "war"))
    assert not one(spark, "New SOFTWARE", text.mentions("t", "war", "word"))
    assert one(spark, "at war, again", text.mentions("t", "War", "word"))
    assert one(spark, "c++ now", text.mentions("t", "c++", "literal"))
    assert one(spark, "abc", text.mentions("t", "a.c"))
    assert not one(spark, "abc", text.mentions("t", "a.c", "literal"))


def test_tokens_and_bigrams(spark):
    toks = text.tokens("t", ["the"])
    assert one(spark, "The a Café x_1 42!", toks) == ["café", "x_1", "42"]
    assert one(spark, "The a Café x_1 42!", text.with_bigrams(toks)) == ["café", "x_1", "42", "café x_1", "x_1 42"]
    assert one(spark, "", text.with_bigrams(toks)) == [] and one(spark, None, text.with_bigrams(toks)) == []
    assert one(spark, "single", text.with_bigrams(toks)) == ["single"]


def test_labels(spark):
    df = spark.createDataFrame([("Sci/Tech",)], "c string")
    row = df.select(text.source_label("c").alias("a"), text.source_label("c", "news_").alias("b"),
                    text.class_name(F.lit(4)).alias("n"), text.class_name(F.lit(9)).alias("z")).first()
    assert tuple(row) == ("sci_tech", "news_sci/tech", "Sci/Tech", None)
