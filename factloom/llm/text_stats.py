"""Statistics of whole texts as one built-in expression, without Python workers.

Arrays are bound to lambda variables (``transform(array(x), v -> ...)[0]``), so
words and lines are split once however often they are used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\\x20\\x09-\\x0D]+"

#: Words that stand in some 8-word window found twice or more.  Windows are compared by
#: 64-bit hashes; only texts with a repeated hash sort (hash, position) pairs.
_REPEATED = """
CASE WHEN size(ws) < 9 THEN 0L ELSE
 transform(array(transform(sequence(1, size(ws) - 7), i -> xxhash64(slice(ws, i, 8)))), hs ->
  CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0L ELSE
   transform(array(sort_array(transform(hs, (h, i) -> struct(h AS h, i AS i)))), st ->
    transform(array(sort_array(transform(filter(st, (x, j) ->
       (j > 0 AND st[greatest(j - 1, 0)].h = x.h) OR (j + 1 < size(st) AND st[least(j + 1, size(st) - 1)].h = x.h)), x -> x.i))), ps ->
     aggregate(transform(ps, (p, j) -> CASE WHEN j = 0 THEN 8 ELSE least(8, p - ps[greatest(j - 1, 0)]) END), 0L, (a, x) -> a + x))[0])[0]
  END)[0]
END"""

_STATS = f"""
transform(array(filter(split(TEXT, '{_SPACE}'), w -> w <> '')), ws ->
 transform(array(filter(split(TEXT, '\\n'), l -> translate(l, ' \\t\\n\\u000b\\f\\r', '') <> '')), ls ->
  named_struct(
   'n_words', CAST(size(ws) AS BIGINT),
   'n_distinct', CAST(size(array_distinct(ws)) AS BIGINT),
   'n_lines', CAST(size(ls) AS BIGINT),
   'n_dup_lines', CAST(size(ls) - size(array_distinct(ls)) AS BIGINT),
   'n_repeat_words', {_REPEATED}))[0])[0]
"""


def counted(text: Column, pattern: str) -> Column:
    """Characters of an ASCII set, by what is left without them."""
    return (F.length(text) - F.length(F.translate(text, pattern, ""))).cast("long")


def text_stats(col: str) -> list[Column]:
    """n_chars, word_chars, n_symbols, n_upper, n_digits, n_marks, n_shouts, n_bars and a struct ``st`` of word and line counts of ``col`` (not null)."""
    text = F.col(col)
    return [
        F.length(text).cast("long").alias("n_chars"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        counted(text, "#*$%&|<>").alias("n_symbols"),
        counted(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        counted(text, "0123456789").alias("n_digits"),
        counted(text, ".,;:!?").alias("n_marks"),
        counted(text, "!").alias("n_shouts"),
        counted(text, "|").alias("n_bars"),
        F.expr(_STATS.replace("TEXT", col)).alias("st"),
    ]
