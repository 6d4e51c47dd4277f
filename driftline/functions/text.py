"""Text expressions: cleaning, matching, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII characters that count as white space, and the non-ASCII ones that end a URL.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f "
WIDE_SPACE = r"\x85\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Fixed value: a token is two or more word characters of any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Class numbers of the labelled news files.
CLASS_NAMES = {1: "World", 2: "Sports", 3: "Business", 4: "Sci/Tech"}

# Default English function words; pass another list where a different one is wanted.
STOP_WORDS = (
    "about above after again against all also am an and any are as at be because been before being below between "
    "both but by can cannot could did do does doing down during each either else every few for from further get "
    "had has have having he her here hers herself him himself his how however if in into is it its itself just "
    "least less many may me might more most much must my myself neither no nor not now of off often on once only "
    "or other others our ours ourselves out over own perhaps quite rather same she should since so some still such "
    "than that the their theirs them themselves then there these they this those though through thus to together "
    "too under until up upon us very was we were what when where whether which while who whom whose why will with "
    "within without would yet you your yours yourself yourselves"
).split()


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_text(col: Column | str) -> Column:
    """Null to empty, no-break spaces to spaces, URLs dropped, non-ASCII runs to one space, white space collapsed."""
    s = F.coalesce(_c(col), F.lit(""))
    s = F.regexp_replace(s, r"\x{00A0}", " ")
    s = F.regexp_replace(s, f"http[s]?://[^{SPACE}{WIDE_SPACE}]+", "")
    s = F.regexp_replace(s, r"[^\x00-\x7F]+", " ")
    return F.trim(F.regexp_replace(s, f"[{SPACE}]+", " "))


def squeeze_whitespace(col: Column | str) -> Column:
    """Only collapse and trim white space."""
    return F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), f"[{SPACE}]+", " "))


def mentions(text: Column | str, concept: Column | str, mode: str = "regex") -> Column:
    """Does the lower-cased text contain the concept?

    `regex` treats the concept as an unanchored pattern (so "war" matches "software"), `literal` as plain text,
    `word` as a whole word. `concept` is a plain string or a Column holding one per row.
    """
    low = F.lower(_c(text))
    wanted = F.lower(F.lit(concept)) if isinstance(concept, str) else F.lower(concept)
    if mode == "literal":
        return F.contains(low, wanted)
    if mode == "word":
        wanted = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), wanted, F.lit(r"($|[^\p{L}\p{N}_])"))
    elif mode != "regex":
        raise ValueError(f"unknown match mode {mode!r}")
    return F.regexp_like(low, wanted)


def source_label(category: Column | str, prefix: str = "") -> Column:
    """Feed-style source name of a category: lower case, `/` to `_`; with a prefix, lower case only."""
    low = F.lower(_c(category))
    return F.concat(F.lit(prefix), low) if prefix else F.regexp_replace(low, "/", "_")


def join_title(title: Column | str, body: Column | str, sep: str = ". ") -> Column:
    """Title and body as one text; nulls count as empty."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(sep), F.coalesce(_c(body), F.lit("")))


def class_name(number: Column | str) -> Column:
    """Category name of a class number; null outside the known range."""
    table = F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])
    return F.try_element_at(table, _c(number).cast("int"))


def tokens(text: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-cased tokens in order, minus `stop_words`."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    if stop_words:
        found = F.filter(found, lambda t: ~t.isin(list(stop_words)))
    return found


def with_bigrams(toks: Column | str) -> Column:
    """Single tokens followed by adjacent pairs."""
    toks = _c(toks)
    left = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0)))
    right = F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0)))
    return F.concat(toks, F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b)))
