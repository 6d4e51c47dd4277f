from driftline.llm.urls import host_of, judge, matched, mine, path_of, tokens_of
from pyspark.sql import functions as F

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def plain(url):
    """Host, path, rule and verdict by the definition."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, key=len, default=None)
    return host, path, best, RULES.get(best)


URLS = ["http://a.ORG/x", "http://org/", "http://org", "https://www.example.org/es/1?x=1", "x://example.org/en/12/3#t", "http://example.org/en/2", "HTTP://b.com/de/", "http://b.com/de",
        "http://b.com/fr/?q", "http://notorg/", "http://x.net/com/de/", "nothing", "", None, "://", "a://b://c.org/", "http://É.com/de/ü?", "http://a.com?u=http://b.org/", "http://user@h.com:80/de/"]


def test_fixed_rules(spark):
    rows = [(k, u, "old", 1) for k, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    none = spark.createDataFrame([], "tokens array<string>, support double, confidence double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, RULES, none).collect()}
    for k, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert got[k] == (host, path, rule, verdict or "allow"), u
    assert judge(df.limit(0), RULES, none).count() == 0


def test_mined_rules_against_counts(spark):
    """Every kept rule has the support and confidence that counting gives, and the planted combination is found."""
    rows = []
    for k in range(400):
        host = ["news", "shop", "blog"][k % 3]
        section = ["deals", "sport", "win"][k // 3 % 3]
        url = f"http://{host}.site{k % 7}.net/{section}/{k}?ref=a{k % 5}"
        rows.append((url, host == "shop" and section == "win" or k % 41 == 0))
    df = spark.createDataFrame([*rows, ("http://x/", None)], "url string, block boolean")
    rules = mine(df, min_support=0.01, min_count=5, min_confidence=0.8).collect()
    sets = [(set(r.t), b) for r, (_, b) in zip(spark.createDataFrame(rows, "url string, block boolean").select(tokens_of(F.col("url")).alias("t")).collect(), rows, strict=True)]
    assert ["h:shop", "p:win"] in [sorted(r.tokens) for r in rules]
    for r in rules:
        hit = [b for t, b in sets if set(r.tokens) <= t]
        assert abs(r.confidence - sum(hit) / len(hit)) < 1e-9 and abs(r.support - sum(hit) / len(sets)) < 1e-9
        assert not any(set(o.tokens) < set(r.tokens) and len(o.tokens) == len(r.tokens) - 1 and o.confidence >= r.confidence for o in rules)
    found = {r.url for r in matched(df, spark.createDataFrame(rules), "url").collect()}
    best = [set(r.tokens) for r in rules]
    assert found == {u for (u, _), (t, _) in zip(rows, sets, strict=True) if any(b <= t for b in best)}
    verdicts = {r.url: r.verdict for r in judge(df, {}, spark.createDataFrame(rules)).collect()}
    assert all((verdicts[u] == "block") == (u in found) for u in verdicts)


def test_without_labels(spark):
    df = spark.createDataFrame([("http://a.b/", None)], "url string, block boolean")
    assert mine(df).count() == 0
    assert [r.verdict for r in judge(df, {}, mine(df)).collect()] == ["allow"]


def test_parts(spark):
    df = spark.createDataFrame([("http://A.b/C?d#e",)], "u string")
    assert tuple(df.select(host_of(F.col("u")), path_of(F.col("u"))).first()) == ("a.b", "/C")


def test_long_urls_are_counted_whole(spark):
    """Rules found among few tokens have the counts of all tokens; columns named like helpers pass."""
    import random

    rng = random.Random(2)
    rows = []
    for k in range(300):
        words = [f"w{rng.randint(0, 9)}x" for _ in range(25)] + (["spam", "offer"] if k % 3 == 0 else ["offer"] if k % 3 == 1 else ["spam"])
        rng.shuffle(words)
        rows.append(("http://host.net/" + "/".join(words), k % 3 == 0))
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "url string, block boolean, _url string, known int")
    rules = mine(df, min_count=20, search_tokens=4).collect()
    sets = [(set(u.split("/")[3:]), b) for u, b in rows]
    assert {"p:spam", "p:offer"} in [set(r.tokens) for r in rules]
    for r in rules:
        hit = [b for t, b in sets if {x[2:] for x in r.tokens if x.startswith("p:")} <= t]
        assert abs(r.confidence - sum(hit) / len(hit)) < 1e-9 and abs(r.support - sum(hit) / 300) < 1e-9
    out = judge(df, {}, spark.createDataFrame(rules))
    assert {"_url", "known", "block"} <= set(out.columns) and out.count() == 300


def test_query_against_the_definition(spark):
    """Every page of the small table: host, path and rule by the definition; where no rule fits, blocked exactly if a mined rule's tokens are all there."""
    from driftline.llm.queries import QUERIES, labelled_urls

    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    rules = [set(r.tokens) for r in mine(labelled_urls(pages)).collect()]
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", tokens_of(F.col("url")).alias("t")).collect()}
    for r in QUERIES["op1_urls"](spark, folder).join(pages, "page_id").collect():
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if any(t <= tokens[r.page_id] for t in rules) else "allow"))
