"""Interaction of five quality filters, from a histogram of failure masks.

Each document gets a mask of five bits, one for each filter that it fails: four
by built-in expressions over its text, the fifth (E, a copy) by the smallest id
that holds the same text.  Equal texts fail the same four, so documents are
first counted by (digest of the text, part, labels); the smallest id of a digest
then says which of them are copies, and a text that a third of all rows hold is
a few counts before anything meets.  What is left are at most 32 cells a part:
what any order of the filters removes, keeps or loses is a sum over cells, and
all 120 orders are enumerated from them.

Built-in expressions only.  Defined results: a null text is empty and equal to
every empty text; a null source is the part ''; a null id joins no label, is no
smaller id and has none, so such a row is never a copy; repeated rows of an id
are documents each, none a copy of the other (the id isn't smaller); with
several label rows of an id one of 1 is enough; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

FILTERS = "ABCDE"
#: Orders of the filters, as strings.
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_FLAGS = r"""
transform(array(filter(split(_text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')), ws ->
  CASE WHEN size(ws) < 200 THEN 1 ELSE 0 END
  + CASE WHEN 100L * size(array_distinct(ws)) < 50L * size(ws) THEN 2 ELSE 0 END)[0]
+ CASE WHEN 100L * (length(_text) - length(translate(_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2L * length(_text) THEN 4 ELSE 0 END
+ CASE WHEN length(translate(_text, '#$%&*|', '')) < length(_text) THEN 8 ELSE 0 END
"""


def failure_masks(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, part, digest and mask (bits A to D): narrow rows, one for each document."""
    whole = docs.select(F.col("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("_text"))
    return whole.select("doc_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), F.expr(_FLAGS).cast("int").alias("mask"))


def _flag(name: str) -> Column:
    return F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits A to E), n, good, toxic: at most 32 rows for each part."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(_flag("quality"), _flag("toxic"))
    # repeated rows are one before the join, so no id is hot there; rows without an id take no part in it
    counted = masks.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "masks")
    named = counted.where("doc_id IS NOT NULL").join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = named.unionByName(counted.where("doc_id IS NULL").withColumns({"quality": F.lit(False), "toxic": F.lit(False)}))
    keys = ["digest", "part", "mask", "quality", "toxic"]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("quality", "toxic")})
    sums = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min("doc_id").alias("least"),
        # rows of one id, part and digest are one here, so the smallest id's count is that of its struct
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("held"),
    )
    sums = materialise(sums, "digests")
    first = sums.groupBy(F.col("digest").alias("_digest")).agg(F.min("least").alias("first"))
    stays = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("held.n")).otherwise(F.lit(0))
    split = sums.join(first, F.col("digest") == F.col("_digest")).withColumn("stays", stays)
    by_mask = split.select("part", "quality", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))).alias("c"))
    return by_mask.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"),
        F.sum(F.when(F.col("quality"), F.col("c.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"),
    )


def _steps() -> Column:
    """Every step of every order as a literal: the order, the step, its filter's bit and the bits before it."""
    found = []
    for order in ORDERS:
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            found.append(f"named_struct('filter_order', '{order}', 'step', {k + 1}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return F.expr(f"array({', '.join(found)})")


def _total(value: str, condition: str) -> Column:
    return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (a, c) -> a + {value})")


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    held = cells(failure_masks(docs, text_col, source_col), labels)
    parts = held.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = parts.select("part", "cells", F.explode(_steps()).alias("s"))
    fails, passed = "(c.mask & s.bit) <> 0", "(c.mask & s.before) = 0"
    return steps.select(
        "part",
        "s.filter_order",
        F.col("s.step").cast("int").alias("step"),
        _total("c.n", "(c.mask & (s.before | s.bit)) = 0").alias("kept"),
        _total("c.n", f"{fails} AND {passed}").alias("removed"),
        _total("c.n", f"{fails} AND NOT {passed}").alias("redundant"),
        _total("c.n", "c.mask = s.bit").alias("unique_fails"),
        _total("c.good", f"{fails} AND {passed}").alias("good_lost"),
        _total("c.toxic", f"{fails} AND {passed}").alias("toxic_lost"),
        # a document that fails k filters is removed by each of them in 120 / k orders
        _total(f"c.n * CAST({len(ORDERS)} DIV bit_count(c.mask) AS BIGINT)", fails).alias("shapley"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
known AS (SELECT doc_id AS id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(w) < 200,
     'B': 100 * len(list_distinct(w)) < 50 * len(w),
     'C': 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'),
     'E': coalesce(doc_id > first, false)} AS f
  FROM words JOIN firsts USING (t) LEFT JOIN known ON doc_id = id),
docs AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x]) AS bad,
         count(*) AS n
  FROM (SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [f.A, f.B, f.C, f.D, f.E]) AS f FROM fails) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s, o[s] AS x, string_split(left(o, s - 1), '') AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
parts AS (SELECT DISTINCT part FROM docs),
told AS (
  SELECT p.part, o, s, x,
    sum(CASE WHEN NOT list_contains(bad, x) AND NOT list_has_any(bad, before) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN list_contains(bad, x) AND NOT list_has_any(bad, before) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN list_contains(bad, x) AND list_has_any(bad, before) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN bad = [x] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN list_contains(bad, x) AND NOT list_has_any(bad, before) AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN list_contains(bad, x) AND NOT list_has_any(bad, before) AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM parts p, steps JOIN docs d ON true WHERE d.part = p.part GROUP BY ALL)
SELECT part, o AS filter_order, s::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM told
"""
