"""DuckDB fragments that mirror the expression library, for the oracle queries."""

from __future__ import annotations

from collections.abc import Iterable

from factloom.functions import lexicons as L


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def members(words: Iterable[str]) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def no_urls(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), 'https?://\\S+', ' ', 'gi')"


def tokens(x: str) -> str:
    kept = f"regexp_replace({no_urls(x)}, '[^\\p{{L}}\\p{{N}}\\s''-]+', ' ', 'g')"
    return f"list_transform(list_filter(string_split({collapse(kept)}, ' '), lambda w: w <> ''), lambda w: lower(w))"


def sentences(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({collapse(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def title(x: str) -> str:
    flat = collapse(x)
    first = f"trim(regexp_extract({flat}, '^([^.!?]*)', 1))"
    return f"trim(substring(CASE WHEN {first} = '' THEN {flat} ELSE {first} END, 1, 120))"


def hits(words: str, lexicon: Iterable[str]) -> str:
    return f"len(list_filter({words}, lambda w: w IN {members(lexicon)}))"


def present(x: str, patterns: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {lit(f'\\b(?:{p})\\b')}) AS INTEGER)" for p in patterns) + ")"


def contained(x: str, phrases: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit(p)}) AS INTEGER)" for p in phrases) + ")"


def occurrences(x: str, phrase: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(f'\\b(?:{phrase})\\b')}))"


def count_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def round_(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE)"


def whole(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def clamp(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"least({high}::DOUBLE, greatest({low}::DOUBLE, {x}))"


def uppercase_ratio(x: str) -> str:
    return f"({count_of(x, '[A-Z]')} / greatest({count_of(x, '[A-Za-z]')}, 1)::DOUBLE)"


def keyword_words(x: str) -> str:
    flat = f"regexp_replace({collapse(f'lower({no_urls(x)})')}, '[^a-z0-9\\s]', ' ', 'g')"
    words = f"list_filter(string_split(regexp_replace({flat}, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: CASE WHEN length(w) < 4 OR w IN {members(L.STOP_WORDS)} OR regexp_matches(w, '^\\d+$') THEN '' ELSE w END)"


def similarity_tokens(x: str) -> str:
    flat = collapse(f"regexp_replace({no_urls(f'lower({x})')}, '[^a-z0-9\\s]', ' ', 'g')")
    return f"list_distinct(list_filter(string_split({flat}, ' '), lambda w: length(w) >= 3))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both} / greatest(len({a}) + len({b}) - {both}, 1)::DOUBLE END"


def syllables(w: str) -> str:
    clean = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    groups = f"len(regexp_extract_all({clean}, '[aeiouy]+')) - CAST(regexp_matches({clean}, 'e$') AS INTEGER) + CAST(regexp_matches({clean}, '[^aeiouy]le$') AS INTEGER)"
    return f"CASE WHEN {clean} = '' THEN 0 WHEN length({clean}) <= 3 THEN 1 ELSE greatest({groups}, 1) END"


ARTICLES = f"""
articles AS (
  SELECT doc_id, lang, source, text, {title('text')} AS title, lower(coalesce(text, '')) AS lower_text,
         {tokens('text')} AS tokens, {sentences('text')} AS sents
  FROM documents)"""
