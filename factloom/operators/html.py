"""Article extraction from HTML by patterns: meta tags, JSON-LD, paragraphs, candidates.

All column expressions, so pages are read and written once and nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.functions import text as X

#: Names of the meta tags of a publication date, in order of trust (fixed values).
DATE_METAS = ["article:published_time", "article:modified_time", "pubdate", "publish-date", "date", "dc.date", "parsely-pub-date"]
#: Types of a JSON-LD node that make it an article (fixed values).
ARTICLE_TYPES = ["NewsArticle", "Article", "ReportageNewsArticle"]
#: How deep arrays and graphs of JSON-LD nodes are followed.
LD_DEPTH = 4
PRIORITIES = {"json_ld": 3000, "article": 2500, "page": 1800, "description": 1200, "loose": 700}


let = X.let


def meta_content(html: Column, name: str) -> Column:
    """Content of the first meta tag of that name or property, '' if there is none."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta[^>]+>)"), F.lit(1)), lambda t: t.rlike(rf"(?i)(?:property|name)=[\"']{name}[\"']"))
    return F.coalesce(X.collapse(X.decode_entities(F.regexp_extract(F.get(tags, F.lit(0)), r"(?i)content=[\"']([^\"']+)[\"']", 1))), F.lit(""))


def published_at(html: Column) -> Column:
    return F.coalesce(*[F.nullif(meta_content(html, n), F.lit("")) for n in DATE_METAS], F.lit(""))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _ld_nodes(value: Column, depth: int = LD_DEPTH) -> Column:
    """The objects of a JSON value in order: arrays are gone through, and an object is followed by those of its @graph."""
    none = F.array().cast("array<variant>")
    if not depth:
        return none

    def nodes(v: Column) -> Column:
        graph = F.try_variant_get(v, "$['@graph']", "variant")
        return (
            F.when(F.startswith(_kind(v), F.lit("ARRAY")), F.flatten(F.transform(_items(v), lambda x: _ld_nodes(x, depth - 1))))
            .when(F.startswith(_kind(v), F.lit("OBJECT")), F.concat(F.array(v), F.coalesce(_ld_nodes(graph, depth - 1), none)))
            .otherwise(none)
        )

    return let(value, nodes)


def _ld_text(node: Column, *names: str) -> Column:
    """The first of the fields that isn't empty, as plain text."""
    found = [F.nullif(F.try_variant_get(node, f"$.{n}", "string"), F.lit("")) for n in names]
    return X.collapse(X.decode_entities(F.coalesce(*found, F.lit(""))))


def author_name(author: Column, depth: int = 3) -> Column:
    """Of a JSON value: a string, an object's name, or up to three names of an array."""

    def name(a: Column) -> Column:
        out = F.when(a.isNull() | (_kind(a) == "VOID"), "").when(F.startswith(_kind(a), F.lit("OBJECT")), _ld_text(a, "name", "alternateName", "author"))
        if depth:
            names = F.filter(F.transform(_items(a), lambda x: author_name(x, depth - 1)), lambda n: n != "")
            out = out.when(F.startswith(_kind(a), F.lit("ARRAY")), F.array_join(F.slice(names, 1, 3), ", "))
        return out.otherwise(X.collapse(X.decode_entities(F.coalesce(F.try_variant_get(a, "$", "string"), F.lit("")))))

    return let(author, name)


def json_ld(html: Column) -> Column:
    """title, text, author, published of the first article node of the first block that has one; blocks that aren't JSON are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    nodes = F.flatten(F.transform(blocks, lambda b: F.coalesce(_ld_nodes(F.try_parse_json(X.collapse(b))), F.array().cast("array<variant>"))))

    def is_article(node: Column) -> Column:
        kinds = F.coalesce(F.try_variant_get(node, "$['@type']", "array<string>"), F.array(F.try_variant_get(node, "$['@type']", "string")))
        return F.exists(kinds, lambda k: F.coalesce(k.isin(ARTICLE_TYPES), F.lit(False)))

    def read(node: Column) -> Column:
        return F.struct(
            _ld_text(node, "headline", "name").alias("title"),
            _ld_text(node, "articleBody", "description").alias("text"),
            author_name(F.try_variant_get(node, "$.author", "variant")).alias("author"),
            _ld_text(node, "datePublished", "dateCreated", "dateModified").alias("published"),
        )

    none = F.struct(*[F.lit("").alias(c) for c in ("title", "text", "author", "published")])
    return F.coalesce(F.get(F.transform(F.slice(F.filter(nodes, is_article), 1, 1), read), F.lit(0)), none)


def strip_blocks(html: Column) -> Column:
    for tag in L.NON_ARTICLE_BLOCKS:
        html = F.regexp_replace(html, f"(?is)<{tag}.*?</{tag}>", " ")
    return html


def article_text(x: Column) -> Column:
    plain = F.regexp_replace(X.decode_entities(x), rf"(?i){X.LEFT}(?:advertisement|sponsored content|sign up for our newsletter){X.RIGHT}", " ")
    return X.collapse(F.regexp_replace(plain, rf"(?i){X.LEFT}(?:function|return|var|let|const)\s*\(", " "))


def is_boilerplate(text: Column) -> Column:
    """Expects normal text."""
    low = F.lower(text)
    shaped = text.rlike("[.!?][\"')\\]]?$") | (F.size(F.split(text, r"\s+")) >= 18)
    starts = low.rlike(f"^(?:{'|'.join(L.BOILERPLATE_STARTS)}){X.RIGHT}")
    inside = low.rlike(X.bounded("|".join(L.BOILERPLATE_ANYWHERE)))
    return (F.length(text) < 55) | (F.length(text) > 1800) | ~shaped | starts | inside | X.looks_like_script(text)


def paragraphs(html: Column) -> Column:
    """Distinct paragraphs that aren't boilerplate, joined by spaces."""
    found = F.regexp_extract_all(strip_blocks(html), F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    texts = F.transform(found, lambda p: article_text(X.strip_html(p)))
    lower = lambda ps: F.transform(ps, F.lower)
    return let(texts, lambda ps: let(lower(ps), lambda low: F.array_join(F.filter(ps, lambda p, i: (p != "") & (F.array_position(low, F.get(low, i)) == i + 1) & ~is_boilerplate(p)), " ")))


def loose_text(html: Column) -> Column:
    """All text as one line (the tags' line breaks are collapsed), kept if it passes as a paragraph."""
    line = article_text(X.strip_html(strip_blocks(html)))
    return let(line, lambda t: F.when((F.length(t) >= 45) & ~is_boilerplate(t), t).otherwise(""))


def candidate_score(text: Column, priority: int) -> Column:
    plain = F.regexp_count(text, F.lit("[.!?]")) * 80 + F.size(X.non_empty(F.split(text, r"\s+"))) * 4 + F.least(F.length(text), F.lit(6000)) + priority
    ads = text.rlike("(?i)advertisement|subscribe|newsletter|cookie|privacy|terms|all rights reserved")
    return plain - F.when(X.looks_like_script(text), 10000).otherwise(0) - F.when(ads, 500).otherwise(0)


def best_text(parts: dict[str, Column]) -> Column:
    """The candidate of the highest score of those with 80 characters that are no script; '' if none."""

    def one(i: int, kind: str) -> Column:
        def scored_text(t: Column) -> Column:
            return F.when((F.length(t) >= 80) & ~X.looks_like_script(t), F.struct(candidate_score(t, PRIORITIES[kind]).alias("score"), F.lit(-i).alias("i"), t.alias("text")))

        return let(article_text(parts[kind]), scored_text)

    scored = F.array(*[one(i, kind) for i, kind in enumerate(parts)])
    return F.coalesce(F.array_max(F.array_compact(scored))["text"], F.lit(""))


def looks_like_listing(title: Column, text: Column, has_article: Column, url: Column) -> Column:
    n = X.phrases_present(F.lower(F.concat_ws(" ", title, text)), L.LISTING_SIGNALS)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    home = F.size(X.non_empty(F.split(path, "/"))) <= 1
    return (home & (n >= 2)) | (~has_article & home & (n >= 1))


def extract_articles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with title, author, published, text, has_article, readable, partial, listing."""
    h = F.coalesce(html, F.lit(""))
    df = pages.withColumns({"_ld": json_ld(h), "_article": F.regexp_extract(h, r"(?is)(<article.*?</article>)", 1), "_description": F.coalesce(F.nullif(meta_content(h, "og:description"), F.lit("")), meta_content(h, "description"))})
    title = F.coalesce(F.nullif(F.col("_ld.title"), F.lit("")), F.nullif(meta_content(h, "og:title"), F.lit("")), F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    df = df.withColumns(
        {
            "title": F.substring(X.collapse(X.decode_entities(title)), 1, 220),
            "author": F.coalesce(F.nullif(F.col("_ld.author"), F.lit("")), F.nullif(meta_content(h, "author"), F.lit("")), meta_content(h, "article:author")),
            "published": F.coalesce(F.nullif(F.col("_ld.published"), F.lit("")), published_at(h)),
            "has_article": (F.col("_article") != "") | (F.coalesce(F.col("_ld.text"), F.lit("")) != ""),
            "text": F.substring(best_text({"json_ld": F.coalesce(F.col("_ld.text"), F.lit("")), "article": paragraphs(F.col("_article")), "page": paragraphs(h), "description": F.col("_description"), "loose": loose_text(h)}), 1, 12000),
        }
    )
    words = F.size(X.non_empty(F.split("text", r"\s+")))
    return df.withColumns(
        {
            "readable": (F.length("text") >= 120) & (words >= 18) & ~X.looks_like_script(F.col("text")),
            "partial": words < 45,
            "listing": looks_like_listing(F.col("title"), F.col("text"), F.col("has_article"), F.col(url)),
        }
    ).drop("_ld", "_article", "_description")


def url_fallback(url: Column) -> Column:
    """A title from the last part of a link's path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    slug = F.coalesce(F.element_at(X.non_empty(F.split(path, "/")), -1), F.lit(""))
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(slug, r"\.[a-z]+$", ""), r"[-_]+", " ")))
