"""URL filter: association rules over URL tokens, mined with FP-growth and matched by an inverted index.

Fixed rules `host/path` come first: a rule fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
Other urls are judged by mined rules. Tokens of labelled urls (host labels, path and query pieces, lower-cased, numbers as #) and the
label make transactions; FP-growth finds frequent sets, and class rules `tokens -> block` are kept by support and
confidence, unless a rule with one token less is at least as sure. Each rule is filed under its rarest token; a url looks up its tokens there
and takes the surest rule all of whose tokens it has. Without one the verdict is allow.

Mining reads about `most_rows` labelled urls at most (by hash). Tokens that stand in the same urls are one; of each url FP-growth sees the
`search_tokens` whose label shares differ most from the average, so that long urls do not blow up the sets. That bounds the search for rules
only: support and confidence of what it finds are counted again over all tokens of all those urls, and matching covers all tokens of all urls. Null urls and urls
without `://` have empty host and path, fit no fixed rule and are allowed unless mined rules say otherwise. Without labels no
rule is mined. Repeated rows get equal verdicts; an empty table gives no rows; extra columns are carried through.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import lookup, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "=block"
RULES = "tokens array<string>, support double, confidence double"
FEW = 100_000  # mined rules that are sent to all tasks; more are joined by token


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def fixed_rule(rules: dict[str, str], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits; a list of some dozens at most."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: (len(x), x)):
        own, _, rest = r.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, rules[r]).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h: for labels and label pieces of the host, p: for path pieces, q: for query pieces."""
    text = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    query = F.regexp_extract(text, r"[?]([^#]*)", 1)

    def pieces(part, kind):
        return F.transform(F.filter(F.split(F.regexp_replace(part, "[0-9]+", "#"), "[^a-z0-9#\\x{80}-\\x{10FFFF}]+"), lambda t: t != ""), lambda t: F.concat(F.lit(kind), t))

    labels = F.transform(F.filter(F.split(host_of(url), "[.]"), lambda t: t != ""), lambda t: F.concat(F.lit("h:"), F.regexp_replace(t, "[0-9]+", "#")))
    return F.array_distinct(F.concat(labels, pieces(host_of(url), "h:"), pieces(path_of(url), "p:"), pieces(query, "q:")))


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "block", min_support: float = 0.002, min_count: int = 10, min_confidence: float = 0.8,
         most_rows: int = 100_000, search_tokens: int = 12) -> DataFrame:
    """(tokens, support, confidence) of the rules `tokens -> block`; labelled has urls and a boolean label (null: not used)."""
    spark: SparkSession = labelled.sparkSession
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("boolean").alias("block"))
    n = rows.count()
    dice = F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), F.col("block")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = settle(rows.where(dice < min(1.0, most_rows / max(n, 1))).select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col("url")).alias("tokens"), "block"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("block").cast("int")).alias("blocked")).first()
    if not total.blocked:
        return spark.createDataFrame([], RULES)
    support = max(min_support, min_count / total.n)
    base = total.blocked / total.n
    each = rows.select("row", "block", F.explode("tokens").alias("token"))
    known = each.groupBy("token").agg(F.count("*").alias("n"), F.avg(F.col("block").cast("int")).alias("share")).where(F.col("n") >= support * total.n)
    # Tokens of the same urls are one: the least of them by name.
    places = each.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(5))).alias("y"))
    known = settle(known.join(places, "token").groupBy("n", "share", "m", "x", "y").agg(F.min("token").alias("token")).select("token", "n", "share"))
    told = F.struct((-F.abs(F.col("share") - base) * F.sqrt("n")).alias("order"), "token")
    chosen = each.join(known, "token").groupBy("row", "block").agg(F.slice(F.array_sort(F.collect_list(told)), 1, search_tokens).alias("told"))
    baskets = settle(chosen.select(F.concat(F.transform("told", lambda x: x["token"]), F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")))
    if baskets.isEmpty():
        return spark.createDataFrame([], RULES)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * total.n / max(baskets.count(), 1)), minConfidence=0.0).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("tokens"))
    found = settle(counted(settle(found), rows, known, total.n).where((F.col("support") >= support) & (F.col("confidence") >= min_confidence)))
    # A rule says nothing new if one with a token less is at least as sure.
    shorter = found.where(F.size("tokens") > 1).select("tokens", "confidence", F.explode("tokens").alias("t")).select("tokens", "confidence", F.array_remove("tokens", F.col("t")).alias("less"))
    beaten = shorter.alias("a").join(found.alias("b"), F.col("a.less") == F.col("b.tokens")).where(F.col("b.confidence") >= F.col("a.confidence")).select(F.col("a.tokens")).distinct()
    return settle(found.join(beaten, "tokens", "left_anti"))


def counted(rules: DataFrame, rows: DataFrame, frequency: DataFrame, total: int) -> DataFrame:
    """`rules` (tokens) with support and confidence over all `rows` (tokens, block); a rule meets the rows that hold its rarest token."""
    each = rules.withColumn("rule", F.monotonically_increasing_id()).select("rule", "tokens", F.explode("tokens").alias("token")).join(frequency.select("token", "n"), "token")
    filed = lookup(each.groupBy("rule", "tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token")))
    held = rows.select("block", F.col("tokens").alias("all"), F.explode("tokens").alias("token")).join(filed, "token").where(F.size(F.array_except("tokens", "all")) == 0)
    per = held.groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("block").cast("int")).alias("b"))
    return per.select("tokens", (F.col("b") / F.lit(float(total))).alias("support"), (F.col("b") / F.col("n")).alias("confidence"))


def matched(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, tokens, confidence): the surest mined rule of each different url that has one."""
    each = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().withColumn("all", tokens_of(F.col("url")))
    frequency = rules.select(F.explode("tokens").alias("token"), "support", "confidence").groupBy("token").agg(F.max(F.col("support") / F.col("confidence")).alias("f"))
    filed = rules.withColumn("rule", F.monotonically_increasing_id()).select("rule", "tokens", "support", "confidence", F.explode("tokens").alias("token")).join(frequency, "token")
    filed = filed.groupBy("rule", "tokens", "support", "confidence").agg(F.min_by("token", F.struct("f", "token")).alias("token")).drop("rule")
    filed = settle(filed)
    index = F.broadcast(filed) if filed.count() <= FEW else filed
    hits = each.select("url", "all", F.explode("all").alias("token")).join(index, "token").where(F.size(F.array_except("tokens", "all")) == 0)
    best = F.max_by(F.struct("tokens", "confidence"), F.struct("confidence", "support", F.array_join("tokens", " ")))
    return hits.groupBy("url").agg(best.alias("r")).select("url", "r.*")


def judge(urls: DataFrame, rules: dict[str, str], mined: DataFrame, url_col: str = "url") -> DataFrame:
    """`urls` with host, path, rule (the fixed one), verdict and tokens (of the mined rule that decided, else null); these replace columns of such names."""
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "tokens")]
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, fixed = fixed_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "fixed": fixed})
    found = matched(rows.where("fixed is null").select("url"), mined).select(F.col("url").alias("known"), "tokens")
    out = rows.hint("merge").join(found, (F.col("url") == F.col("known")) & F.col("fixed").isNull(), "left")
    method = F.when(F.col("tokens").isNotNull(), "block").otherwise("allow")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"), "tokens")
