import math
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm.privacy import KINDS, annotate, entity_spans, sanitised

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def found(spark, texts):
    rows = entity_spans(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text").orderBy("k").collect()
    return [[(k, x.s, x.e) for k in KINDS for x in r[k]] for r in rows]


ODD = ["a@b.c.%x@y.z", "a@b.cd-e@f.g.h@i.j", "é 😀 x.y+z@mail-3.example.com, 1.2.3.4.5.6.7.8 300.1.1.1 007.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "x4111 1111 1111 1111 1",
       "+1 (017) 555-7713 ", "+1 2", "++12345678901234567", "0000000000000 00", "", None, "1.2.3", "@a.b", "a@b", "1234567890123456789012345", "a" * 3000 + "@", "1" * 5000 + ".", "x@" + "a." * 4000 + "b"]


def test_patterns_against_plain_ones(spark):
    assert found(spark, ODD) == [brute(t) for t in ODD]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="01234567891144 -.+@aé()%", max_size=60), min_size=40, max_size=60))
def test_patterns_against_plain_ones_on_random_text(spark, texts):
    assert found(spark, texts) == [brute(t) for t in texts]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{k}@é{k}.example.com u{k}@x{k}.org" for k in range(1500))
    assert found(spark, [text]) == [brute(text)]


def test_terms_by_counts(spark):
    """Terms flagged are those whose disclosure, counted by hand, reaches the limit."""
    rows = []
    for k in range(60):
        who = k % 3
        text = f"plain words here zelkova{who} common person{who}@mail.example.com tail brown" if k % 2 else "plain words and common talk of brown zelkova0 things"
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: sorted((x.s, x.e) for x in r.spans if x.kind == "term") for r in annotate(df).collect()}
    n, docs = len(rows), [set(re.findall(r"[^\W\d_]{3,}", t.lower())) for _, t in rows]
    near, has = defaultdict(set), defaultdict(set)
    for (k, text), words in zip(rows, docs, strict=True):
        for m in re.finditer(PLAIN["email"], text):
            has[m[0]].add(k)
            for w in words - set(re.findall(r"[^\W\d_]{3,}", m[0])):
                near[m[0], w].add(k)
    for k, text in rows:
        want = set()
        for m in re.finditer(PLAIN["email"], text):
            for w in re.finditer(r"[^\W\d_]{3,}", text.lower()):
                if not (w.end() <= m.start() or w.start() >= m.end()):
                    continue
                n_ct, n_c, n_t = len(near[m[0], w[0]]), len(has[m[0]]), sum(w[0] in d for d in docs)
                if n_ct >= 3 and math.log(n_ct * n / (n_c * n_t)) / math.log(n / n_c) >= 0.7:
                    want.add((w.start(), w.end()))
        assert got[k] == sorted(want)


def test_sanitised_text_and_odd_rows(spark):
    rows = [(1, "mail a@b.cc and +1 234 567 890 here"), (1, "mail a@b.cc and +1 234 567 890 here"), (None, "x 1.2.3.4"), (2, None), (3, ""), (4, "clean text")]
    df = spark.createDataFrame([(*r, "s", 5) for r in rows], "doc_id long, text string, spans string, s int")
    got = sorted((r.doc_id or 0, r.text or "") for r in sanitised(df).collect())
    assert got == [(0, "x [IP]"), (1, "mail [EMAIL] and [PHONE] here"), (1, "mail [EMAIL] and [PHONE] here"), (2, ""), (3, ""), (4, "clean text")]
    assert sanitised(df).columns == df.columns
    assert sanitised(df.limit(0)).count() == 0
    assert sanitised(df).where(F.col("doc_id") == 2).first().text is None


def test_rare_strings_and_far_terms(spark):
    """A name is flagged wherever it stands, for a string of two documents and for a class of strings seen once; chance company is not."""
    far = " and so on it goes for a while" * 10
    rows = [(k, f"Quillon wrote{far} to q@two.example{far} and quillon signed") for k in range(2)]
    rows += [(10 + k, f"the Vexley office{far} mail u{k}@vexley.example now") for k in range(6)]
    rows += [(100 + k, f"nothing to see here{far} number{chr(97 + k % 26)} office") for k in range(200)]
    rows += [(400, "once z@one.example hapax")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: {text[r.doc_id][x.s : x.e].lower() for x in r.spans if x.kind == "term"} for r in annotate(df).collect()}
    counts = {r.doc_id: sum(x.kind == "term" and text[r.doc_id][x.s : x.e].lower() == "quillon" for x in r.spans) for r in annotate(df).collect()}
    assert counts[0] == counts[1] == 2
    assert all("vexley" in got[10 + k] and "office" not in got[10 + k] for k in range(6))
    assert got[400] == set() and all(got[100 + k] == set() for k in range(200))
    assert not any({"and", "goes", "while"} & terms for terms in got.values())
