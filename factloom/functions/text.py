"""Column -> Column expressions over text.  Everything stays in Catalyst.

Word boundaries are ASCII and written as look-arounds, because Java's ``\\b``
follows Unicode; white space includes the Unicode spaces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The Unicode spaces of ``WS``.
_WIDE_WS = WS.replace(r"\s", "")
#: Members one by one: the regular expressions look such a class up in one table, while they ask ranges one after another.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: A decimal number; what it begins with is asked before its boundary.
NUMBER = rf"(?=[0-9]){LEFT}\d+(?:\.\d+)?{RIGHT}"


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up, towards plus infinity, at so many decimals."""
    if not digits:
        return F.floor(x + 0.5)
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(x, F.lit(0.0))))


def strip_ws(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WS}+|{WS}+$", "")


def collapse(x: Column) -> Column:
    """White space runs to one space, both ends trimmed."""

    def narrow(v: Column) -> Column:
        return F.when((F.octet_length(v) == F.length(v)) | ~F.regexp_replace(v, r"[\x00-\x7F]+", "").rlike(_WIDE_WS), v).otherwise(F.regexp_replace(v, _WIDE_WS, " "))

    # one plain space between words is the rule, and isn't replaced; a text without two is not read letter by letter
    one = lambda v: F.when(F.contains(v, F.lit("  ")), F.regexp_replace(v, "  +", " ")).otherwise(v)
    return F.trim(let(F.regexp_replace(let(F.coalesce(x, F.lit("")), narrow), r"[\t-\r]", " "), one))


def remove_urls(x: Column) -> Column:
    return let(F.coalesce(x, F.lit("")), lambda v: F.when(F.contains(v, F.lit("://")), F.regexp_replace(v, r"(?i)https?://\S+", " ")).otherwise(v))


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def _parts(flat: Column, pattern: str) -> Column:
    """Parts of a text that is trimmed and has single spaces: only an empty text has an empty part."""
    return let(flat, lambda v: F.when(v == "", F.array().cast("array<string>")).otherwise(F.split(v, pattern)))


#: The one space after an end of a sentence, in a collapsed text.
_SENTENCE_END = " (?<=[.!?] )"


def sentences(x: Column) -> Column:
    return _parts(collapse(x), _SENTENCE_END)


def first_sentence(flat: Column) -> Column:
    """The first of ``sentences`` of a collapsed text (empty if there is none), without the others."""
    return F.get(F.split(flat, _SENTENCE_END, 2), F.lit(0))


def tokens(x: Column, preserve_case: bool = False) -> Column:
    """Words of letters, digits, apostrophes and hyphens."""
    kept = collapse(F.regexp_replace(remove_urls(x), rf"(?=[^{_LOWER}{_UPPER}{_DIGITS} '-])[^\p{{L}}\p{{N}}\s'-]+", " "))
    # a space ends a word for the rules of case too, so all words are folded at once
    return _parts(kept if preserve_case else F.lower(kept), " ")


def paragraphs(x: Column) -> Column:
    """Number of parts between blank lines, at least 1."""
    parts = F.filter(F.split(F.coalesce(x, F.lit("")), r"\r?\n\s*\r?\n"), lambda p: strip_ws(p) != "")
    return F.greatest(F.size(parts), F.lit(1))


def bounded(phrase: str) -> str:
    return f"{LEFT}(?:{phrase}){RIGHT}"


def occurrences(lowered: Column, phrase: str) -> Column:
    """Whole-word hits of a literal phrase in lower-case text."""
    return F.regexp_count(lowered, F.lit(bounded(re.escape(phrase))))


_PLAIN = re.compile(r"[a-z0-9_]+")


def _needed(pattern: str) -> str:
    """A literal part that any text with the pattern holds ('' if there is none to be seen), for a quick look first."""
    if re.search(r"[|(){}\\]", pattern):
        return ""
    return max(re.split(r"\[[^]]*\][?*+]?|.[?*]|[.+^$]", pattern), key=len)


def _found(lowered: Column, pattern: str) -> Column:
    found = lowered.rlike(bounded(pattern))
    part = _needed(pattern)
    return F.contains(lowered, F.lit(part)) & found if part else found


def _split_patterns(patterns: Iterable[str]) -> tuple[list[str], list[str]]:
    """Single words, which are looked up among the text's words, and all others."""
    each = list(dict.fromkeys(patterns))
    return [p for p in each if _PLAIN.fullmatch(p)], [p for p in each if not _PLAIN.fullmatch(p)]


def ascii_words(x: Column) -> Column:
    return F.split(x, f"[^{_LOWER}{_UPPER}{_DIGITS}_]+")


def patterns_present(lowered: Column, patterns: Iterable[str], among: Column | None = None) -> Column:
    """How many patterns occur (not how often).  ``among``: ``ascii_words`` of the text, where they are there."""
    words, others = _split_patterns(patterns)
    out = F.size(F.array_intersect(ascii_words(lowered) if among is None else among, F.array(*[F.lit(w) for w in words]))) if words else F.lit(0)
    for p in others:
        out = out + _found(lowered, p).cast("int")
    return out


def any_present(lowered: Column, patterns: Iterable[str], among: Column | None = None) -> Column:
    words, others = _split_patterns(patterns)
    out = F.arrays_overlap(ascii_words(lowered) if among is None else among, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    for p in others:
        out = out | _found(lowered, p)
    return out


def occurrences_of(lowered: Column, phrases: Iterable[str], among: Column) -> Column:
    """``occurrences`` summed over phrases; single words are counted in one pass over ``among`` (``ascii_words`` of the text)."""
    phrases = list(phrases)
    words = [p for p in phrases if _PLAIN.fullmatch(p)]
    out = F.lit(0)
    for times in sorted({words.count(w) for w in words}):
        out = out + hits(among, [w for w in dict.fromkeys(words) if words.count(w) == times]) * times
    for p in phrases:
        if not _PLAIN.fullmatch(p):
            out = out + F.when(F.contains(lowered, F.lit(p)), occurrences(lowered, p)).otherwise(0)
    return out


def phrases_present(lowered: Column, phrases: Iterable[str]) -> Column:
    out = F.lit(0)
    for p in phrases:
        out = out + lowered.contains(p).cast("int")
    return out


def hits(words: Column, lexicon: Iterable[str]) -> Column:
    """Words of an array that are in a list."""
    members = list(lexicon)
    return F.size(F.filter(words, lambda w: w.isin(members)))


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def uppercase_ratio(x: Column) -> Column:
    letters = F.regexp_replace(x, f"[^{_LOWER}{_UPPER}]+", "")
    return let(letters, lambda v: count_of(v, "[A-Z]") / F.greatest(F.length(v), F.lit(1)))


def syllables(word: Column) -> Column:
    """Vowel groups, less a final e, plus a final le after a consonant; short words have one."""
    clean = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(clean, F.lit("[aeiouy]+")) - clean.rlike("e$").cast("int") + clean.rlike("[^aeiouy]le$").cast("int")
    return F.when(clean == "", 0).when(F.length(clean) <= 3, 1).otherwise(F.greatest(groups, F.lit(1)))


def syllables_in(words: Column) -> Column:
    """``syllables`` summed over an array of words without spaces: all words are counted in a few passes over their joined letters."""
    begin, end = "(?<![a-z])", "(?![a-z])"
    clean = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z ]+", "")

    # words of up to three letters count one each and are taken out first
    short = F.regexp_count(clean, F.lit(f"{begin}[a-z]{{1,3}}{end}"))
    rest = F.regexp_replace(clean, f"{begin}[a-z]{{1,3}}{end}", "")
    n = lambda p: F.regexp_count(rest, F.lit(p))
    silent = n(f"e{end}") - n(f"[bcdfghjklmnpqrstvwxz]le{end}")
    none = n(f"{begin}(?:[bcdfghjklmnpqrstvwxz]+|[bcdfghjklmnpqrstvwxz]*[aeiouy]*e){end}") - n(f"{begin}[bcdfghjklmnpqrstvwxz]+le{end}")
    return short + n("[aeiouy]+") - silent + none


def headline(x: Column) -> Column:
    """What stands before the first end of a sentence, 120 characters."""
    flat = collapse(x)
    first = F.trim(F.regexp_extract(flat, r"^([^.!?]*)", 1))
    return F.trim(F.substring(F.when(first == "", flat).otherwise(first), 1, 120))


def title_from(x: Column, limit: int = 110) -> Column:
    """The first sentence, cut; blank text has a stand-in."""
    return let(collapse(x), lambda flat: title_of(flat, limit))


def title_of(flat: Column, limit: int = 110) -> Column:
    """``title_from`` of a collapsed text."""
    first = F.trim(F.substring(first_sentence(flat), 1, limit))
    return F.when(flat == "", "Untitled Record").when(first == "", F.trim(F.substring(flat, 1, limit))).otherwise(first)


def summary(head: Column, x: Column, most: int = 3) -> Column:
    long_ones = F.filter(sentences(x), lambda s: F.length(s) > 35)
    joined = F.substring(collapse(F.array_join(F.slice(long_ones, 1, most), " ")), 1, 420)
    fallback = F.substring(collapse(F.concat(head, F.lit(". "), x)), 1, 280)
    return F.when(F.size(long_ones) > 0, joined).otherwise(F.when(fallback == "", "No summary available.").otherwise(fallback))


def keyword_words(x: Column) -> Column:
    """Lower-case ASCII words, with those that can't be keywords blanked, so positions hold."""
    words = non_empty(F.split(F.lower(remove_urls(x)), f"[^{_LOWER}{_DIGITS}]+"))
    return F.transform(words, lambda w: F.when((F.length(w) < 4) | w.isin(L.STOP_WORDS) | w.rlike(r"^\d+$"), "").otherwise(w))


def similarity_tokens(x: Column) -> Column:
    """Distinct lower-case ASCII words of at least 3 characters."""
    words = F.split(remove_urls(F.lower(F.coalesce(x, F.lit("")))), f"[^{_LOWER}{_DIGITS}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


#: Named references that are decoded, in this order (fixed values).
_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")]


def utf16_char(code: Column) -> Column:
    """The character of a UTF-16 code unit (a number modulo 65536); a lone surrogate becomes U+FFFD."""
    unit = F.pmod(code, F.lit(1 << 16))
    unit = F.when(unit.between(0xD800, 0xDFFF), 0xFFFD).otherwise(unit)
    return F.decode(F.unhex(F.lpad(F.hex(unit), 4, "0")), "UTF-16BE")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and stands once in the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decoded(x: Column, ref: str, base: int) -> Column:
    """Numeric references of one notation, in one pass: what they decode to isn't read again."""
    char = lambda c: utf16_char(F.pmod(F.conv(c, base, 10).cast("decimal(20,0)"), F.lit(1 << 16)).cast("long"))
    pieces = lambda v: F.zip_with(F.split(v, ref, -1), F.regexp_extract_all(v, F.lit(ref), F.lit(1)), lambda p, c: F.concat(p, F.when(c.isNull(), "").otherwise(char(c))))
    return let(x, lambda v: F.when(v.rlike(ref), F.array_join(pieces(v), "")).otherwise(v))


def decode_entities(x: Column) -> Column:
    """Seven named references in turn (so ``&amp;lt;`` decodes twice), then decimal and then hexadecimal ones."""
    for name, char in _ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return _decoded(_decoded(x, "&#([0-9]+);", 10), "&#[xX]([0-9a-fA-F]+);", 16)


def strip_html(x: Column) -> Column:
    bare = F.regexp_replace(x, r"(?is)<(script|style|noscript)[\s\S]*?</\1>", " ")
    return collapse(decode_entities(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")))


def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII parts: those with one part as two strings, those with several as a map."""
    one, several = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        parts = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if parts:
            (one if len(parts) == 1 else several)[chr(code)] = parts
    return "".join(one), "".join(one.values()), several


FOLD_FROM, FOLD_TO, FOLD_WIDE = _folds()
_WIDE = "[" + "".join(FOLD_WIDE) + "]"
#: Different characters outside ASCII up to which a text is folded by one replacement for each.
FEW = 24


def fold_ascii(x: Column) -> Column:
    """Compatibility forms (accents, ligatures, full-width letters, fractions, ...) folded to their ASCII parts, other non-ASCII dropped.

    Texts of ASCII only stay as they are.
    """
    # a map of thousands of literals is slow to plan, so it is read from one text
    wide = F.str_to_map(F.lit("\n".join(f"{c}\t{p}" for c, p in FOLD_WIDE.items())), F.lit("\n"), F.lit("\t"))
    is_wide = lambda v: F.length(F.translate(v, "".join(FOLD_WIDE), "")) < F.length(v)
    found = lambda v: F.array_distinct(F.regexp_extract_all(v, F.lit(f"({_WIDE})"), F.lit(1)))
    spread = lambda v: F.when(is_wide(v), F.aggregate(found(v), v, lambda acc, c: F.replace(acc, c, F.element_at(wide, c)))).otherwise(v)
    folded = lambda v: F.regexp_replace(F.translate(spread(v), FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]+", "")
    # a text of few different other characters has each replaced at once
    odd = lambda v: F.array_distinct(F.split(F.regexp_replace(v, r"[\x00-\x7F]+", ""), ""))
    each = lambda v, chars: F.aggregate(chars, v, lambda acc, c: F.replace(acc, c, folded(c)))
    several = lambda v: let(odd(v), lambda chars: F.when(F.size(chars) <= FEW, each(v, chars)).otherwise(folded(v)))
    return let(F.coalesce(x, F.lit("")), lambda v: F.when(F.octet_length(v) == F.length(v), v).otherwise(several(v)))


def normal_text(x: Column) -> Column:
    """ASCII, lower case, no links, letters and digits only, single spaces."""
    plain = let(F.lower(fold_ascii(x)), lambda v: F.when(F.contains(v, F.lit("://")), F.regexp_replace(v, r"https?://\S+", " ")).otherwise(v))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, f"[^{_LOWER}{_DIGITS} ]", " "), "  +", " "))


def looks_like_script(x: Column) -> Column:
    low = F.lower(x)
    marks = F.length(x) - F.length(F.translate(x, "{};=<>", ""))
    return (phrases_present(low, L.SCRIPT_SIGNALS) >= 2) | (marks / F.greatest(F.length(x), F.lit(1)) > 0.08)


def date_candidates(x: Column) -> Column:
    months = "|".join(L.MONTHS)
    found = [F.regexp_extract_all(x, F.lit(f"{LEFT}({p}){RIGHT}"), F.lit(1)) for p in (r"\d{4}-\d{2}-\d{2}", rf"(?:{months})\s+\d{{1,2}},\s+\d{{4}}", r"\d{1,2}/\d{1,2}/\d{4}")]
    return F.slice(F.array_distinct(F.concat(*found)), 1, 8)
