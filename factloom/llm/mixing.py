"""Mixing sources to target weights.

Each document gets a hash-random key.  Within a source, documents are dealt to
ranges of that key, the ranges' word counts are summed, and a running sum inside
each range on top of the sums before it gives the exact place of every document
in its source's shuffled order.  A source whose target exceeds its size is read
through whole epochs first; the last, partial epoch ends exactly at the budget,
inside one document if need be.

A source that holds a third of all rows has as many ranges as its rows need, so
no task sees more than about ``run_rows`` of them.

Defined results: a null or blank text has size 0 and takes 0; a null source is
a source of its own, last in order; repeated rows count each; a null id keys as
the text 'null'; an empty table gives an empty result; other columns are kept
by ``mix`` only through a join on the id, and are not read here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, n_words, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Sources of up to this many rows in the table of sources are broadcast (some 100 bytes each).
BROADCAST_SOURCES = 20_000


def source_targets(slim: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """skey, source_size, rows, target: weights share the total, each source's share ends at ``most`` times its size.

    The excess is reshared: in order of size per weight, sources are full up to
    the first whose share of what is left stays below its limit.  One row per
    source, so windows over all of them are small.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = slim.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("c", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    before = W.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("wsum", F.sum("w").over(everything))
    per = per.withColumn("rate", (F.col("total") - F.coalesce(F.sum("c").over(before), F.lit(0.0))) / (F.col("wsum") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("full", F.col("c") <= F.col("rate") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.col("rate"))).over(everything)
    return per.withColumn("target", F.when(F.col("full"), F.col("c")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("w"))).select("skey", "source_size", "n_rows", "target")


def mix_plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", run_rows: int = 2000) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of ``docs``.

    ``copies``: the epochs in which the document, or its first words, is taken.
    """
    source = F.col(source_col)
    slim = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("skey"),
            n_words(text_or_empty(text_col)).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("key"),
        ),
        "mix",
    )
    targets = materialise(source_targets(slim, weights, most), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    dealt = slim.drop("source").join(targets, "skey").withColumn("run", F.floor(share * F.ceil(F.col("n_rows") / F.lit(run_rows))))
    sums = dealt.groupBy("skey", "run").agg(F.sum("size").alias("run_size"))
    sums = sums.select("skey", "run", (F.sum("run_size").over(W.partitionBy("skey").orderBy("run")) - F.col("run_size")).alias("runs_before"))
    inside = W.partitionBy("skey", "run").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("in_run", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["skey", "run"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    placed = placed.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size")).withColumn("before", F.col("runs_before") + F.col("in_run"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("epochs") + (F.col("before") < F.col("left")).cast("long")).cast("int").alias("copies"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    A document that a budget cuts through is kept whole, so each source's words
    exceed its target by less than one document.  Ids have to be distinct here;
    rows that share an id are joined to one plan row for each and deduplicated
    by the id first.
    """
    plan = mix_plan(docs, id_col=id_col, **options).groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    plan = plan.where("_copies > 0").select(F.struct("doc_id", "_copies").alias("p"))
    # whole rows are one column, so that no name of theirs meets another
    taken = docs.select(F.struct("*").alias("r")).join(plan, F.col(f"r.`{id_col}`").eqNullSafe(F.col("p.doc_id")))
    return taken.select("r", F.explode(F.sequence(F.lit(1), F.col("p._copies"))).alias("e")).select("r.*")


ORACLE = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w
  FROM slim GROUP BY source),
lim AS (SELECT *, source_size * 3.0::DOUBLE AS c, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS wsum FROM per),
rates AS (
  SELECT *, (total - coalesce(sum(c) OVER b, 0.0)) / (wsum - coalesce(sum(w) OVER b, 0.0)) AS rate
  FROM lim WINDOW b AS (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flags AS (SELECT *, c <= rate * w AS is_full FROM rates),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN c ELSE coalesce(max(CASE WHEN NOT is_full THEN rate END) OVER (), 0.0) * w END AS target
  FROM flags),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM slim s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken,
       CAST(epochs + CASE WHEN before < budget - epochs * source_size THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM cut
"""
