"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the addresses, numbers and phones that fixed patterns find. A term of an entity's documents discloses it as far
as the corpus says so: with document counts over all documents, its disclosure is PMI(entity; term) / IC(entity), which is 1
where the term never comes without the entity, times x / (x + 1/2), where x is the number of sightings less those that chance
gives (the expected number and twice its root). Copies of a text are one sighting: a term is seen as often with an entity as it has different
words before it and different words after it there. The sightings must also be more than chance over all pairs tried: the Poisson bound of
their number, times the number of pairs of an entity and a term with two common documents, has to stay below `error`. An entity of one document
is disclosed by nothing. Of a mail domain only its own name (the label before the last) is judged, by documents: other words that its mails share
name none of its members. Terms that reach `generalise_at` are replaced by a general word, from `remove_at` on they are removed, wherever they
stand in a document that holds the entity. The entities themselves are always replaced by their kind.

Null text is empty and has no span. Rows are judged one by one and counted one by one: repeated rows get the same spans, a
null id is an id like others, an empty table stays empty, extra columns are carried through. Very long texts are worked
on whole; offsets are code points, end exclusive. Spans of different kinds may overlap; in the sanitised text they are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import lookup, settle

CHUNK = 512  # matches that are laid end to end at once, so that very many matches of a text cost linear time

# The patterns of the four kinds, written so that a run of characters is entered at its beginning only (or where the
# last match ended), which finds the same matches without quadratic retries. Cards are matched by length at once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
WORD = r"\p{L}{3,}"


def _laid_out(matches: Column, pieces: Column, begin: Column) -> Column:
    """[(s, e, m)] of matches, given the texts between them."""
    lengths = F.transform(pieces, F.length)
    n = F.size(matches)
    kind = "array<struct<s:int,e:int,m:string>>"

    def add(acc, x):
        s = acc["pos"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def chunk(acc, k):
        part = F.arrays_zip(F.slice(matches, k * CHUNK + 1, CHUNK).alias("m"), F.slice(F.slice(lengths, F.lit(1), F.greatest(n, F.lit(1))), k * CHUNK + 1, CHUNK).alias("gap"))
        inner = F.aggregate(part, F.struct(acc["pos"].alias("pos"), F.array().cast(kind).alias("out")), add)
        return F.struct(inner["pos"].alias("pos"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    laid = F.aggregate(chunks, F.struct(begin.cast("int").alias("pos"), F.array().cast(f"array<{kind}>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, laid).otherwise(F.array().cast(kind))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    back = F.reverse(digits(match))

    def add(total, k):
        d = F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def entity_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with an array of (s, e, m) per kind: the entities that pass their checks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    signs = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")), "card": F.lit(True), "phone": F.contains(text, F.lit("+"))}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    none = F.array().cast("array<string>")
    found = docs.withColumns({f"_{k}": F.when(signs[k], F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))).otherwise(none) for k in KINDS})
    found = found.withColumns({f"_{k}_gaps": F.when(F.size(f"_{k}") > 0, F.split(text, patterns[k], -1)).otherwise(none) for k in KINDS})
    fits = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["m"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
        "card": lambda x: luhn(x["m"]),
        "phone": lambda x: F.length(digits(x["m"])).between(9, 15),
    }
    out = found.withColumns({k: F.filter(_laid_out(F.col(f"_{k}"), F.col(f"_{k}_gaps"), F.lit(0)), fits[k]) for k in KINDS})
    return out.drop(*[f"_{k}" for k in KINDS], *[f"_{k}_gaps" for k in KINDS])


def listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def _with_words(rows: DataFrame) -> DataFrame:
    """`rows` with the column `at`: [(s, e, m)] of the words outside addresses (the other kinds hold no letters), m in lower case."""
    pattern = f"{EMAIL}|{WORD}"
    # Matches and gaps as columns of their own, so that the pattern runs once over a text.
    cut = rows.withColumns({"_m": F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "_gaps": F.split("text", pattern, -1)})
    words = F.filter(_laid_out(F.col("_m"), F.col("_gaps"), F.lit(0)), lambda w: ~F.contains(w["m"], F.lit("@")))
    return cut.withColumn("at", F.transform(words, lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), F.lower(w["m"]).alias("m")))).drop("_m", "_gaps")


def _groups(base: DataFrame) -> DataFrame:
    """(rid, rhash, grp, name, n_c): the entities and mail domains of each document that stand in more than one, with document counts.

    `name` is the one term that can disclose a domain; null for an entity.
    """

    def named(kind):
        return F.transform(kind, lambda x: F.concat(F.lit(kind + ":"), F.lower(x["m"])))

    entities = F.concat(*[named(k) for k in KINDS])
    domain = F.substring_index("entity", "@", -1)
    group = lambda grp, name: F.struct(grp.alias("grp"), name.alias("name"))
    own = F.when(F.startswith("entity", F.lit("email:")), group(F.concat(F.lit("email:@"), domain), F.substring_index(F.substring_index(domain, ".", -2), ".", 1)))
    rows = base.where("any").select("rid", "rhash", F.explode(entities).alias("entity"))
    rows = rows.select("rid", "rhash", F.explode(F.filter(F.array(group(F.col("entity"), F.lit(None).cast("string")), own), lambda x: x.isNotNull())).alias("x"))
    each = settle(rows.select("rid", "rhash", "x.*").distinct())
    return each.join(lookup(each.groupBy("grp").agg(F.count("*").alias("n_c")).where("n_c > 1")), "grp")


def _slots(terms: DataFrame, log2: int = 23) -> tuple[DataFrame, Column]:
    """(slot, bits) of a bitmap of the column `term`, at most 2^log2 / 64 rows, and the test whether a term may be in it."""
    slot = F.pmod(F.xxhash64("term"), F.lit(1 << log2))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    rows = terms.groupBy(F.shiftright(slot, 6).alias("slot")).agg(F.bit_or(bit).alias("bits"))
    return rows, (F.shiftright(slot, 6) == F.col("slot")) & (F.col("bits").bitwiseAND(bit) != 0)


def disclosures(rows: DataFrame, pairs: DataFrame, seen: DataFrame, least: float, error: float) -> DataFrame:
    """(grp, term, disclosure) of at least `least`, from document counts over the whole corpus.

    `pairs` has (grp, name, n_c, term) per document, `seen` (grp, term, before, after) per place where a term stands.
    """
    n_ct = settle(pairs.groupBy("grp", "term").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c"), F.first("name").alias("name")).where("n_ct > 1"))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)), F.lower))
    slots, held = _slots(n_ct.select("term"))
    # Only terms of `n_ct` are counted; the bitmap keeps the others out before the shuffle and has a fixed size.
    n_t = rows.select(F.explode(words).alias("term")).join(F.broadcast(slots), held).groupBy("term").agg(F.count("*").alias("n_t"))
    n = F.lit(float(rows.count()))
    tried = F.lit(float(n_ct.count()))
    pmi = F.ln(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
    told = F.when(F.col("n_c") < n, pmi / F.ln(n / F.col("n_c")))
    likely = lookup(n_ct.join(n_t, "term").withColumn("told", told).where(F.col("told") >= least))
    before, after = (seen.join(likely.select("grp", "term"), ["grp", "term"]).groupBy("grp", "term", c).agg(F.lit(1)).groupBy("grp", "term").agg(F.count("*").alias(f"n_{c}")) for c in ("before", "after"))
    counted = likely.join(before, ["grp", "term"]).join(after, ["grp", "term"])
    sighted = F.when(F.col("name").isNotNull(), F.col("n_ct")).otherwise(F.least("n_before", "n_after"))
    chance = F.col("n_c") * F.col("n_t") / n
    more = F.greatest(F.col("sighted") - chance - 2 * F.sqrt(chance), F.lit(0.0))
    bound = F.col("sighted") - chance + F.col("sighted") * F.ln(chance / F.col("sighted"))  # of the logarithm of the chance of as many
    sure = (F.col("sighted") > chance) & (bound + F.ln(tried) <= math.log(error))
    out = counted.withColumn("sighted", sighted).select("grp", "term", F.when(sure, F.col("told") * more / (more + 0.5)).alias("disclosure"))
    return out.where(F.col("disclosure") >= least)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: float = 0.01, generalise_at: float = 0.7, remove_at: float = 0.9, out: str = "spans") -> DataFrame:
    """`docs` with the column `out` (replaced if there is one): spans (kind, s, e, action): entities and the terms that disclose them, by kind as listed, then start."""
    key = [F.col(id_col).cast("string"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    rows = docs.select(key[0].alias("rid"), key[1].alias("rhash"), F.col(text_col).alias("text"))
    base = settle(entity_spans(rows, "text").withColumn("any", F.expr(" + ".join(f"size({k})" for k in KINDS)) > 0)
                  .withColumn("text", F.when(F.col("any"), F.col("text"))))
    docs_of = _groups(base)
    same = lambda a, b: F.col(f"{a}.rid").eqNullSafe(F.col(f"{b}.rid")) & (F.col(f"{a}.rhash") == F.col(f"{b}.rhash"))
    some = _with_words(base.where("any").dropDuplicates(["rid", "rhash"]).select("rid", "rhash", "text")).drop("text")
    own = docs_of.groupBy("rid", "rhash").agg(F.collect_list(F.struct("grp", "name", "n_c")).alias("groups"))
    located_ = settle(some.alias("w").join(own.alias("g"), same("w", "g")).select("w.rid", "w.rhash", "at", "groups"))
    with_group = located_.select("rid", "rhash", "at", F.explode("groups").alias("x")).select("rid", "rhash", "at", "x.*")
    judged = lambda terms: F.filter(terms, lambda t: F.col("name").isNull() | (t == F.col("name")))
    each = with_group.select("rid", "rhash", "grp", "name", "n_c", F.explode(judged(F.array_distinct(F.transform("at", lambda w: w["m"])))).alias("term"))
    place = F.transform("at", lambda w, i: F.struct(w["m"].alias("term"), F.when(i > 0, F.col("at")[i - 1]["m"]).otherwise("").alias("before"), F.coalesce(F.get("at", i + 1)["m"], F.lit("")).alias("after")))
    seen = with_group.select("grp", F.inline(place))
    strong = lookup(disclosures(rows, each, seen, generalise_at, error))
    marks = each.join(strong, ["grp", "term"]).groupBy("rid", "rhash", "term").agg(F.max("disclosure").alias("d"))
    marks = marks.groupBy("rid", "rhash").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("told"))
    action = lambda w: F.when(F.col("told")[w["m"]] >= remove_at, F.lit("remove")).otherwise(F.lit("generalise"))
    held = F.filter("at", lambda w: F.col("told")[w["m"]].isNotNull())
    per_row = located_.alias("w").join(marks.alias("g"), same("w", "g")).select(
        "w.rid", "w.rhash", F.transform(held, lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), action(w).alias("action"))).alias("terms"))

    def replaced(kind):
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit("replace").alias("action")))

    entities = F.concat(*[replaced(k) for k in KINDS])
    term_spans = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["action"].alias("action")))
    kind = "array<struct<kind:string,s:int,e:int,action:string>>"
    one = base.where("any").select("rid", "rhash", entities.alias("entities")).dropDuplicates(["rid", "rhash"]).alias("b")
    joined = one.join(per_row.alias("t"), F.col("b.rid").eqNullSafe(F.col("t.rid")) & (F.col("b.rhash") == F.col("t.rhash")), "left")
    spans = joined.select(F.col("b.rid").alias("rid"), F.col("b.rhash").alias("rhash"), F.concat("entities", F.coalesce(term_spans, F.array().cast(kind))).cast(kind).alias("spans"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key[0].alias("rid"), key[1].alias("rhash")).alias("d")
    joined = keyed.join(spans.alias("s"), same("d", "s"), "left")
    return joined.select(*[F.col("d.row")[c].alias(c) for c in docs.columns if c != out], F.coalesce("s.spans", F.array().cast(kind)).alias(out))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with its text sanitised: entities become [KIND], disclosing terms [TERM] or nothing. Null stays null."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = annotate(whole, "id", "text", **options)
    word = lambda x: F.when(x["action"] == "remove", F.lit("")).when(x["action"] == "generalise", F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    kind = "array<struct<s:int,e:int,word:string>>"

    def join(acc, x):  # overlapping spans become one, with the first span's word
        last = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["word"].alias("word"))))
        return F.when((F.size(acc) > 0) & (x["s"] < last["e"]), wider).otherwise(F.concat(acc, F.array(x)))

    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), word(x).alias("word"))))
    rows = rows.withColumn("joined", F.when(F.size("spans") > 0, F.aggregate(ordered, F.array().cast(kind), join)))

    def piece(x, k):
        before = F.when(k > 0, F.col("joined")[k - 1]["e"]).otherwise(0)
        return F.concat(F.substring("text", before + 1, x["s"] - before), x["word"])

    last = F.element_at("joined", -1)["e"]
    text = F.concat(F.array_join(F.transform("joined", piece), ""), F.substring("text", last + 1, F.length("text")))
    return rows.select(*[F.coalesce(text, F.col("text")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
