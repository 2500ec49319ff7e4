"""HTML extraction with a site style tree.

Every page is parsed once, to its text blocks and the containers (body, div,
section, list, table, ...) they stand in; the parsed pages are written, and all
that follows reads them.  The trees of one host are merged by the chains of tags
and classes of their containers.  In the merged tree

* a content node, a text under a chain, that stands on k of the m pages with the
  chain has the importance 1 - log k / log m: its entropy over the pages, turned
  round, so that new text counts fully and text on every page not at all;
* a presentation node, a container, has the entropy of its shapes over the m
  pages with it, divided by log m: a template's slot looks alike on all pages,
  an article on each page another way.  A shape is the sequence of the chains
  and size classes of all blocks in the branch, so what varies far below counts
  in all containers above;
* a branch has the composite importance (1 - g^l) * presentation + g^l * content
  * volume: l is its number of shapes, g is ``DECAY``, content the mean of its
  texts' importance weighed by words, and volume its share of its pages' words
  in units of ``FULL_SHARE``, at most 1.  The fewer shapes, the more its texts
  decide, and the more of the pages' text they have to be.

From each page, branches that are common on its host (1 - log m / log n below
``IMPORTANCE``, of n pages) and of a composite importance below ``IMPORTANCE``
go whole, and so do texts of a lower importance than that.  A container, or
text, on one page only has importance 1.  Pages that are nearly copies of each
other (equal weighted minimum hashes of their texts) count as one page, so a
page that is copied often is not boilerplate.

Tags and classes that declare menus, notices, forms and the like are left out
before the tree is built, and a page with an article (or main) element is read
inside it, where only texts and no branches go; ``declared=False`` leaves all to
the tree.

A host has at most about n^0.3 times as many rows of what goes as a page has
blocks; they are joined by host, and broadcast only if those of all hosts are
small.

Defined results: null or empty html gives an empty text; truncated pages are
read as far as they go (a cut tag is dropped, a cut reference stays as it is);
a null or odd url is a host of its own name ''; repeated rows each get a row;
other columns stay as they are.
"""

from __future__ import annotations

import html as entities
import math
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

IMPORTANCE, DECAY, FULL_SHARE = 0.3, 0.9, 0.1
BROADCAST_BYTES = 32 << 20
#: Rows of a table of containers (some 100 bytes each) up to which it is broadcast; a hot host's texts then stay where they are.
BROADCAST_NODES = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold no article text.
NOISE = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "head", "nav", "footer", "aside", "form", "noscript", "template", "iframe", "object", "svg", "canvas", "button", "select", "option", "dialog", "menu", "audio", "video", "math", "fieldset", "label"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | NOISE
#: Elements that are branches of the tree; other blocks belong to the container they stand in.
CONTAINERS = {"article", "aside", "body", "center", "details", "dialog", "div", "dl", "fieldset", "footer", "form", "header", "main", "menu", "nav", "ol", "section", "table", "ul"}
#: Elements whose text is never shown as such, whatever else is declared.
UNSEEN = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "head", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video"}
#: An open <p> ends where one of these begins.
ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "head", "title", "script", "style", "template", "noscript", "button", "select", "option", "label", "iframe", "object", "svg", "canvas", "audio", "video", "math", "textarea"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Words in a class, id or role that declare a branch as no part of the article.
DECLARED = set("ad ads advert adverts advertisement advertising advertorial adsense adbox adslot sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall comment comments disqus respond replies reply discussion sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar share sharing social related recommended recommendations teaser teasers footer foot masthead topbar header search login tags tagcloud copyright hidden complementary contentinfo dialog form".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")


def _declared(tag: str, attrs: str) -> tuple[str, bool]:
    """The class for the style path, and whether the attributes declare noise."""
    style, noise = "", False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            style = " ".join(sorted(value.lower().split()))
        if name in ("class", "id", "role"):
            for part in value.lower().split():
                words = _WORDS.findall(part)
                if words and (part in DECLARED or words[0] in DECLARED or words[-1] in DECLARED):
                    noise = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            noise = True
    return style, noise and tag not in ("html", "body", "main", "article")


def blocks_of(page: str, declared: bool = True) -> tuple[list[tuple[tuple, str]], bool]:
    """(chain of containers, text) of every block that isn't declared noise, in page order; whether they stand in an article."""
    stack: list[tuple[str, tuple, bool, bool]] = []  # tag, chain, noise, in an article
    parts: list[str] = []
    found: list[tuple[tuple, str, bool]] = []
    top = ("", (), False, False)

    def flush():
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            here = stack[-1] if stack else top
            if text and not here[2]:
                found.append((here[1], text, here[3]))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        here = stack[-1] if stack else top
        if m is None:
            if not here[2]:
                parts.append(page[at:])
            break
        if m.start() > at and not here[2]:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag:
            continue
        closed = m[4] if m[2] else m[7]
        if closed != ">":
            break  # cut off inside a tag
        attrs, closing = m[3] or "", (m[1] or m[5]) == "/"
        if closing:
            if any(x[0] == tag for x in stack):
                if tag in BLOCKS:
                    flush()
                while stack:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    if stack.pop()[0] == tag:
                        break
            elif tag == "p" or tag == "br":
                flush() if tag == "p" else parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag in _SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SAME[tag]:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k][0] in _SCOPE[tag]:
                    break
        if tag in VOID:
            continue
        here = stack[-1] if stack else top
        style, noise = _declared(tag, attrs) if attrs else ("", False)
        inside = declared and (here[3] or tag in ("article", "main"))
        noise = noise or tag in NOISE or tag == "header" and not inside if declared else tag in UNSEEN
        if tag in RAW:
            m = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if m is None:
                break
            at = page.find(">", m.start()) + 1 or end
            continue
        if attrs.rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        chain = (*here[1], f"{tag}.{style}" if style else tag) if tag in CONTAINERS else here[1]
        stack.append((tag, chain, here[2] or noise, inside))
    flush()
    if any(x[2] for x in found):
        return [(p, t) for p, t, inside in found if inside], True
    return [(p, t) for p, t, _ in found], False


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Chains(dict):
    """Chain of labels -> hashes of the chain from its root to each of its containers."""

    def __missing__(self, chain):
        if len(self) > 50_000:
            self.clear()
        got = [_hash("/".join(chain[: i + 1])) for i in range(len(chain))]
        self[chain] = got
        return got


def page_key(texts: list[tuple[int, int]]) -> int:
    """Of (hash, words) of a page's texts two that are least, weighed by words: near copies mostly agree in them."""

    def least(salt: int) -> int:
        return min(((-math.log((hash((salt, h)) % (1 << 52) + 1) / ((1 << 52) + 1)) / n, h) for h, n in texts), default=(0.0, 0))[1]

    return hash((least(1), least(2)))


_BLOCK = T.StructType([T.StructField("chain", T.ArrayType(T.LongType())), T.StructField("id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("text", T.StringType())])
_NODE = T.StructType([T.StructField("node", T.LongType()), T.StructField("shape", T.LongType()), T.StructField("words", T.LongType())])
_PARSED = T.StructType([T.StructField("key", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("article", T.BooleanType()), T.StructField("words", T.LongType()), T.StructField("blocks", T.ArrayType(_BLOCK)), T.StructField("nodes", T.ArrayType(_NODE))])


def parsed(page: str | None, chains: dict, declared: bool) -> dict:
    """One page's blocks, and shape and words of each of its containers."""
    found, article = blocks_of(page or "", declared)
    blocks, nodes = [], {}
    for chain, text in found:
        n, ids = text.count(" ") + 1, chains[chain] or [0]
        here = ids[-1]
        blocks.append({"chain": ids, "id": _hash(f"{here} {text}"), "words": n, "text": text})
        size = (n.bit_length() + 1) // 2
        for node in dict.fromkeys(ids):
            shape, words = nodes.get(node, (0, 0))
            nodes[node] = hash((shape, here, size)), words + n
    texts = dict.fromkeys((b["id"], b["words"]) for b in blocks)
    return {"key": page_key(list(texts)), "digest": _hash(repr([b["id"] for b in blocks])), "article": article, "words": sum(b["words"] for b in blocks), "blocks": blocks, "nodes": [{"node": c, "shape": s, "words": w} for c, (s, w) in nodes.items()]}


def _parser(declared: bool):
    @F.arrow_udf(_PARSED)
    def parse(page: pa.Array) -> pa.Array:
        chains = _Chains()
        kind = pa.struct([("key", pa.int64()), ("digest", pa.int64()), ("article", pa.bool_()), ("words", pa.int64()), ("blocks", pa.list_(pa.struct([("chain", pa.list_(pa.int64())), ("id", pa.int64()), ("words", pa.int32()), ("text", pa.string())]))), ("nodes", pa.list_(pa.struct([("node", pa.int64()), ("shape", pa.int64()), ("words", pa.int64())])))])
        return pa.array((parsed(p.as_py(), chains, declared) for p in page), kind)

    return parse


def _entropy_left(k: str, m: str) -> Column:
    return F.when(F.col(m) > 1, 1 - F.log(k) / F.log(m)).otherwise(1.0)


def style_tree(pages: DataFrame) -> DataFrame:
    """host, article, branches, texts: the containers and blocks (ids) of low importance of each host's merged tree.

    ``pages``: host and the parsed columns.
    """
    site = ["host", "article"]
    slim = F.struct("digest", "words", F.transform("blocks", lambda b: F.struct(b["chain"].alias("chain"), b["id"].alias("id"), b["words"].alias("words"))).alias("blocks"), "nodes")
    each = materialise(pages.where(F.size("blocks") > 0).groupBy(*site, "key").agg(F.min(slim).alias("x")).select(*site, "x.*"), "tree")
    n_pages = each.groupBy(*site).agg(F.count(F.lit(1)).alias("n"))

    nodes = each.select(*site, F.col("words").alias("whole"), F.explode("nodes").alias("x")).select(*site, "whole", "x.*")
    shapes = nodes.groupBy(*site, "node", "shape").agg(F.count(F.lit(1)).alias("c"), F.sum("words").alias("words"), F.sum("whole").alias("whole"))
    shapes = shapes.groupBy(*site, "node").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("c") * F.log("c")).alias("clogc"), (F.sum("words") / F.sum("whole")).alias("share"))
    shapes = materialise(shapes.withColumn("presentation", F.when(F.col("m") > 1, 1 - F.col("clogc") / F.col("m") / F.log("m")).otherwise(1.0)), "shapes")
    shapes = F.broadcast(shapes) if shapes.count() <= BROADCAST_NODES else shapes

    texts = each.select(*site, F.explode(F.array_distinct("blocks")).alias("x")).groupBy(*site, "x.chain", "x.id", "x.words").agg(F.count(F.lit(1)).alias("k"))
    texts = texts.withColumn("node", F.element_at("chain", -1)).join(shapes.select(*site, "node", "m"), [*site, "node"])
    texts = materialise(texts.withColumn("left", _entropy_left("k", "m")), "texts")
    weight = F.col("k") * F.col("words")
    content = texts.select(*site, (weight * F.col("left")).alias("kept"), weight.alias("of"), F.explode(F.array_distinct("chain")).alias("node"))
    content = content.groupBy(*site, "node").agg((F.sum("kept") / F.sum("of")).alias("content"))

    steady = F.pow(F.lit(DECAY), F.col("l"))
    composite = (1 - steady) * F.col("presentation") + steady * F.col("content") * F.least(F.lit(1.0), F.col("share") / FULL_SHARE)
    common = shapes.join(content, [*site, "node"]).join(n_pages, site).where(F.col("m") > 1).where(_entropy_left("m", "n") < IMPORTANCE)
    branches = common.where(~F.col("article") & (composite < IMPORTANCE)).groupBy(*site).agg(F.collect_set("node").alias("branches"))
    repeated = texts.where((F.col("k") > 1) & (F.col("left") < IMPORTANCE)).join(n_pages, site).where(_entropy_left("k", "n") < IMPORTANCE)
    repeated = repeated.groupBy(*site).agg(F.collect_set("id").alias("texts"))
    none = F.array().cast("array<long>")
    return branches.join(repeated, site, "full").select(*site, F.coalesce("branches", none).alias("branches"), F.coalesce("texts", none).alias("texts"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", declared: bool = True, keep_html: bool = True) -> DataFrame:
    """``pages`` with ``main_text``; ``keep_html=False`` leaves the html out."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    carried = [c for c in pages.columns if c != "main_text" and (keep_html or c != html_col)]
    read = pages.select(F.struct(*carried).alias("row"), host.alias("host"), _parser(declared)(F.col(html_col)).alias("p"))
    read = materialise(read.select("row", "host", "p.*"), "parsed")
    tree = materialise(style_tree(read.drop("row")), "style").withColumnsRenamed({"host": "_host", "article": "_article"})
    size = tree.agg(F.coalesce(F.sum(8 * (F.size("branches") + F.size("texts")) + 64), F.lit(0)).alias("b")).first().b
    on = (F.col("host") == F.col("_host")) & (F.col("article") == F.col("_article"))
    joined = read.join(F.broadcast(tree) if size <= BROADCAST_BYTES else tree, on, "left")
    stays = lambda b: ~F.coalesce(F.arrays_overlap(b["chain"], F.col("branches")), F.lit(False)) & ~F.coalesce(F.array_contains("texts", b["id"]), F.lit(False))
    text = F.array_join(F.transform(F.filter("blocks", stays), lambda b: b["text"]), "\n")
    return joined.select("row", text.alias("main_text")).select(*[F.col("row")[c].alias(c) for c in carried], "main_text")


def digest(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"), keep_html=False)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
