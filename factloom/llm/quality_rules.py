"""Quality rules whose cutoffs carry an exact risk certificate.

Each rule rejects documents whose statistic lies at or above a cutoff.  In each
stratum (the language) the labelled documents are halved by a hash of the id.
The first half orders the cutoffs: a cutoff's purity is the share of bad ones
among the documents it rejects, and for a purity p the rules together take the
lowest cutoffs that are at least as pure.  So there is one sequence of rule
sets for a stratum, from the purest on, each of which rejects all that the one
before does.

The second half, the holdout, certifies them: a rule set passes if, were its
true false-rejection rate above ``risk``, so few rejected good documents would
be seen with a probability of at most ``delta / strata`` (the exact binomial
tail).  Sets are tested in their order, ending at the first that fails, which
needs no further correction; strata share ``delta`` by Bonferroni.  One test
covers all rules at once, so the rules need no correction either.  With a
confidence of 1 - delta, no stratum loses more than ``risk`` of its good
documents to the rules.  Among its certified sets a stratum takes the one that
rejects most bad documents of the holdout, less the good ones; if none gains,
no rule rejects in that stratum.

Built-in expressions only; one narrow table of statistics is written and read
for calibration and verdict.  Defined results: null text counts as empty; a null
language is a stratum; without labels (or with too few for a certificate) only
the base rule rejects; repeated label rows count once (the lowest quality);
repeated documents each get a row; a null id joins no label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, text_or_empty
from .text_stats import text_stats

#: Share of good documents that may be lost, and the probability of being wrong about it.
RISK, DELTA = 0.05, 0.05
LEVELS = 400
BROADCAST_STRATA = 10_000


def _share(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / greatest({b}, 1)"


#: Name and statistic (SQL) of each rule, scaled so that LEVELS is beyond its range.
RULES: list[tuple[str, str]] = [
    ("symbols", f"{_share('n_symbols', 'word_chars')} * {LEVELS}"),
    ("bars", f"{_share('n_bars', 'n_words')} * {LEVELS}"),
    ("dup_lines", f"{_share('n_dup_lines', 'n_lines')} * {LEVELS}"),
    ("repeats", f"{_share('n_repeat_words', 'n_words')} * {LEVELS}"),
    ("capitals", f"{_share('n_upper', 'word_chars')} * {LEVELS}"),
    ("shouts", f"{_share('n_shouts', 'n_words')} * {LEVELS}"),
    ("long_words", f"{_share('word_chars', 'n_words')} * 10"),
]


def _level(stat: str) -> Column:
    return F.least(F.floor(F.expr(stat)), F.lit(LEVELS)).cast("int")


def _log_factorial(x: str) -> str:
    """ln x!, beyond 20 by Stirling's series, which is exact to double precision there."""
    y = f"CAST({x} AS DOUBLE)"
    series = f"{y} * ln({y}) - {y} + 0.5D * ln(2 * pi() * {y}) + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - 1 / (1680 * pow({y}, 7))"
    return f"CASE WHEN {x} <= 20 THEN ln(factorial(CAST(least({x}, 20) AS INT))) ELSE {series} END"


def certificate(k: str, n: str, rate: float) -> Column:
    """log P(Bin(n, rate) <= k): the largest term, times the sum of the others' ratios to it.

    The ratios fall from k downwards, ten standard deviations on below 1e-20; so
    many are added.
    """
    top = f"({_log_factorial(n)}) - ({_log_factorial(k)}) - ({_log_factorial(f'({n} - {k})')}) + {k} * ln({rate}D) + ({n} - {k}) * ln(1 - {rate}D)"
    terms = f"least({k}, CAST(10 * sqrt({n} * {rate}D) AS BIGINT) + 50)"
    ratio = f"({k} - i + 1) / CAST({n} - {k} + i AS DOUBLE) * {(1 - rate) / rate!r}D"
    rest = f"aggregate(sequence(1L, {terms}), named_struct('t', 1D, 's', 1D), (a, i) -> named_struct('t', a.t * {ratio}, 's', a.s + a.t * {ratio}), a -> a.s)"
    return F.expr(f"CASE WHEN {k} >= {rate}D * {n} THEN 0D WHEN {k} = 0 THEN {n} * ln(1 - {rate}D) ELSE {top} + ln({rest}) END")


def _purities(seen: DataFrame) -> DataFrame:
    """stratum and, for each rule, its levels with a higher purity than any lower one: arrays of (level, purity)."""
    names = [name for name, _ in RULES]
    each = seen.where("half = 0").select("stratum", "quality", F.posexplode("levels").alias("rule", "level"))
    counts = each.groupBy("stratum", "rule", "level").agg(F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 0")).alias("bad"))
    down = W.partitionBy("stratum", "rule").orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, 0)
    tails = counts.select("stratum", "rule", "level", F.sum("bad").over(down).alias("bad"), F.sum("good").over(down).alias("good"))
    tails = tails.withColumn("purity", F.col("bad") / (F.col("bad") + F.col("good") + 1))
    lower = W.partitionBy("stratum", "rule").orderBy("level").rowsBetween(W.unboundedPreceding, -1)
    steps = tails.withColumn("below", F.coalesce(F.max("purity").over(lower), F.lit(0.0))).where("level > 0 AND purity > below")
    per = [F.array_sort(F.collect_list(F.when(F.col("rule") == k, F.struct("level", "purity")))).alias(name) for k, name in enumerate(names)]
    return steps.groupBy("stratum").agg(*per)


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """stratum and cutoffs (map of rule to level): one row for each stratum in which a rule rejects."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = stats.where("NOT base_failed").join(known, "doc_id").select("stratum", F.col("quality").cast("int").alias("quality"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), F.array(*[_level(stat) for _, stat in RULES]).alias("levels"))
    seen = materialise(seen, "seen")
    pure = materialise(_purities(seen), "purities")  # at most RULES * LEVELS entries for each stratum
    few = F.broadcast(pure) if pure.count() <= BROADCAST_STRATA else pure

    def reached(name: str, k: int) -> Column:
        """The highest purity of the rule's cutoffs that reject the document."""
        return F.aggregate(F.col(name), F.lit(0.0), lambda a, x: F.when(x["level"] <= F.col("levels")[k], F.greatest(a, x["purity"])).otherwise(a))

    held = seen.where("half = 1").join(few, "stratum").withColumn("purity", F.greatest(*[reached(name, k) for k, (name, _) in enumerate(RULES)]))
    counts = held.groupBy("stratum", "purity").agg(F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 0")).alias("bad"))
    down = W.partitionBy("stratum").orderBy(F.col("purity").desc()).rowsBetween(W.unboundedPreceding, 0)
    tests = counts.select("stratum", "purity", F.sum("good").over(down).alias("k"), F.sum("good").over(W.partitionBy("stratum")).alias("n"), F.sum("bad").over(down).alias("bad"))
    n_strata = counts.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    tests = tests.crossJoin(F.broadcast(n_strata))  # one row
    passed = certificate("k", "n", risk) <= F.log(F.lit(delta) / F.col("n_strata"))
    tests = tests.withColumn("ok", F.min(passed.cast("int")).over(down) == 1)
    best = tests.where("ok AND purity > 0 AND bad > k").groupBy("stratum").agg(F.max(F.struct(F.col("bad") - F.col("k"), F.col("purity"))).alias("m"))
    chosen = best.join(pure, "stratum")
    lowest = [F.struct(F.lit(name).alias("rule"), F.array_min(F.transform(F.filter(name, lambda x: x["purity"] >= F.col("m.purity")), lambda x: x["level"])).alias("level")) for name, _ in RULES]
    return chosen.select("stratum", F.map_from_entries(F.filter(F.array(*lowest), lambda x: x["level"].isNotNull())).alias("cutoffs"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, stratum_col: str = "lang") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and ``rejected_by`` (names of rules)."""
    raw = docs.select(F.col("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("n")).alias("stratum"), text_or_empty("text").alias("_text"))
    stats = raw.select("doc_id", "stratum", *text_stats("_text")).select("*", "st.*").drop("st")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = materialise(stats.withColumn("base_failed", failed), "stats")
    found = materialise(cutoffs(stats, labels, risk, delta), "cutoffs")
    if found.count() <= BROADCAST_STRATA:
        found = F.broadcast(found)
    hits = F.filter(F.array(*[F.when(_level(stat) >= F.col("cutoffs")[name], F.lit(name)) for name, stat in RULES]), lambda x: x.isNotNull())
    return (
        stats.join(found, "stratum", "left")
        .withColumn("rejected_by", F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(hits))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
    )
