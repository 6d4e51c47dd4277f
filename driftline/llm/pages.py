"""Main text of web pages: site templates are found by counting, and removed.

Every element's subtree is hashed (names and text, without attributes). Spark counts on how many different pages of a host each
subtree stands; one that stands on at least `least_pages` and on `share` of them is that site's template and is deleted wherever it
stands on the host. Outside articles, blocks of some words need no share: a menu of one section stands on `least_pages` pages of a large
host, not on half of them. Words within a sentence, headings and table cells are never judged by that count. Pages with equal html count once, so copies of an article do not make it a template. Elements whose
name or class says that they are no article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of
readers) go too. A class or id counts token by token, as a whole or by a listed beginning, and never on article, main or what holds one;
only an article that is itself a reader's comment goes. If an article or main element is left, only what lies in one is text.

Blocks are runs of text between block elements; white space becomes one space, empty blocks vanish, blocks are joined by a
newline. Null, empty or broken html gives what text there is, at least the empty string. Null urls are one host (empty). Repeated rows
get equal texts; very long pages are parsed whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.bits import bitmap, held
from driftline.session import settle

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
NO_ARTICLE = frozenset("""nav header footer aside form script style noscript template iframe object embed applet svg canvas select button textarea input
dialog menu head title audio video map datalist noembed noframes search""".split())
# Blocks that a count of pages makes a template, from so many words on: groups of elements from the fewer.
GROUPS = frozenset("center details dir div dl figure hgroup ol section table ul".split())
COUNTED = GROUPS | frozenset("address blockquote dd figcaption li p pre".split())
FEW_WORDS, SENTENCE = 3, 8
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
COMMENT = r"comments?|comment-(?!s?-?(?:open|closed)).*|comments-(?!open|closed).*|(?:article|post|entry|user|reader)-comments?|disqus(?:-.*)?|replies|respond"
WHOLE = r"ads?|aside|header|masthead|topbar|notices?|overlay|signup|login|hidden|copyright|legal|disclaimers?|tags?|pager|paging|sharing|sr-only|skip-?link|side-bar"
BEGUN = (r"ad|ads|advert\w*|adsense|adslot|banners?|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|widgets?|footer|toolbar|cookies?|consent|gdpr|popups?|modals?|"
         r"newsletters?|subscri\w*|login|signup|share|sharing|social|related|recommend\w*|pagination|notice|search")
ENDED = (r"(?:site|main|page|top|bottom|primary|secondary|global|mobile)-(?:nav|navbar|navigation|menu|footer|breadcrumbs?|banner|ads?)|(?:site|global|main|top)-header|"
         r"(?:top|side|bottom|inline|byline)-ad")
# One class or id token; states of a page (menu-open) and layouts (with-sidebar, no-sidebar, has-comments, tag-x) are none.
NOT_TEXT = re.compile(rf"(?:{WHOLE}|(?:{BEGUN})(?:-(?!(?:.*-)?(?:open|closed|enabled|disabled|active|on|off)$).*)?|{ENDED})", re.I)
IS_COMMENT = re.compile(COMMENT, re.I)
SOFT, HARD = 1, 2  # a soft drop is taken back if the element holds an article
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("name", "kids", "drop", "hash", "parent", "holds")

    def __init__(self, name: str, parent: Node | None, drop: int = 0):
        self.name, self.parent, self.drop, self.kids, self.hash, self.holds = name, parent, drop, [], b"", False


def _in_article(node: Node | None) -> bool:
    while node is not None:
        if node.name in ("article", "main"):
            return True
        node = node.parent
    return False


def _dropped(name: str, attributes: str, parent: Node | None) -> int:
    if name in NO_ARTICLE:
        if name == "header" and _in_article(parent):  # an article's own header holds its heading
            return 0
        return SOFT if name == "form" else HARD
    if not attributes or name in ("html", "body"):
        return 0
    drop = 0
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            for token in value.replace("_", "-").split():
                if IS_COMMENT.fullmatch(token):
                    if name != "main":
                        return HARD
                elif name not in ("article", "main") and NOT_TEXT.fullmatch(token) and not (token.lower() == "header" and _in_article(parent)):
                    drop = SOFT
        if key == "role" and value.strip().lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return HARD
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
    return drop


def parse(source: str) -> Node:
    """The element tree; kids are nodes and strings (decoded text)."""
    root = top = Node("#root", None)
    at = 0
    for_raw = None
    while True:
        if for_raw:
            end = re.compile(rf"</{re.escape(for_raw)}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else len(source)
            top.kids.append(entities.unescape(source[at:stop]) if for_raw in ("title", "textarea") else source[at:stop])
            at, for_raw = stop, None
        found = TOKEN.search(source, at)
        if (text := source[at : found.start() if found else len(source)]):
            top.kids.append(entities.unescape(text))
        if not found:
            return root
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            walk = top
            while walk is not root and walk.name != name:
                walk = walk.parent
            if walk is not root:
                top = walk.parent
            continue
        if name in BLOCK and name not in ("body", "html"):  # a block ends an open paragraph, and what is open inside it
            walk = top
            while walk is not root and (walk.name not in BLOCK or walk.name == "p"):
                if walk.name == "p":
                    top = walk.parent
                    break
                walk = walk.parent
        if name in CLOSED_BY:
            walk = top
            while walk is not root and walk.name not in ("ul", "ol", "dl", "table", "select", "menu", "div", "article", "section"):
                if walk.name in CLOSED_BY[name]:
                    top = walk.parent
                    break
                walk = walk.parent
        attributes = found[3] or found[6] or ""
        node = Node(name, top, _dropped(name, attributes, top))
        top.kids.append(node)
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCK and name not in RAW):
            top = node
            for_raw = name if name in RAW else None


def digest(root: Node) -> set[int]:
    """Hash every subtree that has text, and take back drops of elements that hold an article; returns the hashes, as signed 64-bit numbers."""
    out: set[int] = set()
    order, todo = [], [root]
    while todo:  # children after their parents, so that no depth of nesting matters
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in node.kids if not isinstance(k, str))
    for node in reversed(order):
        h = hashlib.blake2b(node.name.encode(), digest_size=8)
        some = False
        for k in node.kids:
            if isinstance(k, str):
                words = " ".join(k.split())
                if words:
                    h.update(b"\0" + words.encode("utf-8", "surrogatepass"))
                    some = True
            elif k.hash:
                h.update(b"\1" + k.hash)
                some = True
        node.hash = h.digest() if some else b""
        node.holds = node.drop != HARD and (node.name in ("article", "main") or any(not isinstance(k, str) and k.holds for k in node.kids))
        if node.holds:
            node.drop = 0
        if some and node.name not in ("#root", "html", "body", "head", "script", "style"):
            out.add(int.from_bytes(node.hash, "big", signed=True))
    return out


def loose(root: Node) -> set[int]:
    """Hashes (after `digest`) of the blocks with some words that stand outside article and main only."""
    outside: set[int] = set()
    inside: set[int] = set()
    order, todo = [], [(root, False)]
    while todo:
        node, within = todo.pop()
        order.append((node, within))
        within = within or node.name in ("article", "main")
        todo.extend((k, within) for k in node.kids if not isinstance(k, str))
    words: dict[int, int] = {}
    for node, within in reversed(order):
        if not node.hash:
            continue
        n = words[id(node)] = min(SENTENCE, sum(len(k.split()) if isinstance(k, str) else words.get(id(k), 0) for k in node.kids))
        if within or node.holds:
            inside.add(int.from_bytes(node.hash, "big", signed=True))
        elif n >= (FEW_WORDS if node.name in GROUPS else SENTENCE) and node.name in COUNTED:
            outside.add(int.from_bytes(node.hash, "big", signed=True))
    return outside - inside


def _blocks(root: Node, templates: frozenset[int] | set[int], only_article: bool) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush():
        words = " ".join("".join(run).split())
        if words:
            out.append(words)
        run.clear()

    todo: list[tuple] = [(root, not only_article, False)]
    while todo:
        item, inside, closing = todo.pop()
        if isinstance(item, str):
            if inside:
                run.append(item)
            continue
        if closing:
            flush()
            continue
        if item.drop or templates and item.hash and int.from_bytes(item.hash, "big", signed=True) in templates:
            if item.name in BLOCK:
                flush()
            continue
        inside = inside or item.name in ("article", "main")
        if item.name in BLOCK:
            flush()
            todo.append((item, inside, True))
        elif item.name == "br":
            run.append(" ")
        todo.extend((k, inside, False) for k in reversed(item.kids))
    flush()
    return out


def main_text(source: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    root = parse(source or "")
    digest(root)
    return "\n".join(_blocks(root, templates, True) or _blocks(root, templates, False))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def _keyed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """`pages` with hashes of the host and of the whole page: a shared hash could only delete what is a template elsewhere."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.withColumns({"_html": html, "_host": F.xxhash64(host_of(F.col(url_col)))}).withColumn("_sig", F.xxhash64("_host", "_html"))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = 8, share: float = 0.5) -> DataFrame:
    """(host, sig, hash): the template subtrees on each different page; host and sig are the hashes of host and page."""

    def run(batches):
        for batch in batches:
            hosts, sigs, found, counted = [], [], [], []
            for host, sig, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                root = parse(source)
                own = list(digest(root))
                free = loose(root)
                hosts.extend([host] * len(own))
                sigs.extend([sig] * len(own))
                found.extend(own)
                open_ = not _blocks(root, frozenset(), True)  # text outside articles counts only if none lies in one
                counted.extend((2 if open_ else 1) if h in free else 0 for h in own)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(sigs, pa.int64()), pa.array(found, pa.int64()), pa.array(counted, pa.int8())], ["host", "sig", "hash", "loose"])

    keyed = _keyed(pages, url_col, html_col)
    on = settle(keyed.select("_host", "_sig", "_html").mapInArrow(run, "host long, sig long, hash long, loose byte"))
    count = on.distinct().groupBy("host", "hash").agg(F.count("*").alias("n"), F.count_if(F.col("loose") > 0).alias("m")).where(F.col("n") >= least_pages)
    sizes = keyed.select("_host", "_sig").distinct().groupBy(F.col("_host").alias("host")).agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    strict = F.col("n") >= F.col("pages") * share
    often = settle(count.join(sizes, "host").where(strict | (F.col("m") >= least_pages)).select("host", "hash", strict.alias("strict")))
    return on.join(often, ["host", "hash"]).where(F.col("strict") | (F.col("loose") == 2)).select("host", "sig", "hash")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "main_text", least_pages: int = 8, share: float = 0.5) -> DataFrame:
    """`pages` with the column `out`: the main text."""
    per_page = settle(templates(pages, url_col, html_col, least_pages, share).groupBy("sig").agg(F.collect_set("hash").alias("hashes")))
    keep = [c for c in pages.columns if c not in (out, html_col)]
    rows = _keyed(pages, url_col, html_col).select(*keep, "_html", "_sig")
    bits = pages.sparkSession.sparkContext.broadcast(bitmap(per_page, "sig"))
    schema = rows.select(*keep).schema.add(out, "string")

    def chosen(batches, inside):
        for batch in batches:
            kept = batch.filter(pa.array(held(bits.value, batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)) == inside))
            if kept.num_rows:
                yield kept

    def run(batches):
        for batch in batches:
            found = batch.column(len(keep) + 1).to_pylist() if batch.schema.names[-1] == "hashes" else [()] * batch.num_rows
            texts = [main_text(source, set(h or ())) for source, h in zip(batch.column(len(keep)).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, out])

    # Pages without a template are parsed where they are read; only the others travel to meet their template hashes.
    plain = rows.mapInArrow(lambda b: run(chosen(b, False)), schema)
    rest = rows.mapInArrow(lambda b: chosen(b, True), rows.schema).join(per_page, F.col("_sig") == F.col("sig"), "left").select(*keep, "_html", "hashes")
    return plain.unionByName(rest.mapInArrow(run, schema))
