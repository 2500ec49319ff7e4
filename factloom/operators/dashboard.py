"""Dashboard widgets over analyses: id, label, confidence (0..100), trust_score, host, badge, ts.

Each widget is one aggregate, joined to a spine where empty buckets count.
``as_of`` is always given; nothing reads the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import labels as B
from factloom.functions.text import js_round

BUCKETS = [("0-20", 0, 20), ("21-40", 21, 40), ("41-60", 41, 60), ("61-80", 61, 80), ("81-100", 81, 100)]


def rounded_mean(x: Column) -> Column:
    """Of integers: one exact sum, one division."""
    return F.coalesce(js_round(F.sum(x) / F.greatest(F.count(x), F.lit(1))), F.lit(0))


def label_distribution(analyses: DataFrame) -> DataFrame:
    """Three rows in fixed order, zeros included."""
    counts = analyses.agg(*[F.count_if(B.result_label(F.col("label")) == k).alias(k) for k in B.LABELS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("label"), F.col(k).alias("n")) for i, k in enumerate(B.LABELS)])).alias("x")).select("x.*")


def overview(analyses: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return analyses.agg(
        n.alias("total"),
        *[F.count_if(F.col("label") == k).alias(k.lower()) for k in B.LABELS],
        F.coalesce(js_round(F.sum("confidence") / F.greatest(n, F.lit(1))), F.lit(0)).alias("mean_confidence"),
        rounded_mean(F.when(F.col("trust_score") > 0, F.col("trust_score"))).alias("mean_trust"),
    )


def prediction_statistics(analyses: DataFrame) -> DataFrame:
    risk = B.risk_level(F.col("label"), F.col("confidence") / 100)
    return analyses.agg(*[F.count_if(risk == k).alias(f"risk_{k.lower()}") for k in ("HIGH", "MEDIUM", "LOW")], F.count_if(F.col("badge") == "Trusted").alias("trusted_sources"))


def live_counters(analyses: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows of the day, ISO week and month of ``as_of``; a missing time counts as the epoch."""
    ts = F.coalesce("ts", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"))
    now = F.lit(as_of).cast("timestamp_ntz")
    same = lambda unit: F.count_if(F.date_trunc(unit, ts.cast("timestamp")) == F.date_trunc(unit, now.cast("timestamp")))
    return analyses.agg(same("DAY").alias("today"), same("WEEK").alias("week"), same("MONTH").alias("month"), F.count_distinct(F.when(F.col("badge") == "Suspicious", F.col("host"))).alias("suspicious_domains"))


def confidence_histogram(analyses: DataFrame) -> DataFrame:
    """Five closed buckets; what fits none goes to the first."""
    c = F.col("confidence")
    place = F.lit(0)
    for i, (_, low, high) in enumerate(BUCKETS):
        place = F.when(c.between(low, high), i).otherwise(place)
    counts = analyses.select(place.alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    spine = analyses.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(BUCKETS)], "place int, bucket string")
    return spine.join(counts, "place", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def series(analyses: DataFrame, as_of: dt.date, unit: str, n: int) -> DataFrame:
    """``n`` buckets (day, week, month) up to ``as_of``: counts by label, mean confidence, mean positive trust."""
    spark: SparkSession = analyses.sparkSession
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[unit]
    last = F.trunc(F.lit(as_of), unit.upper()) if unit != "day" else F.lit(as_of)
    back = F.add_months(last, -(n - 1)) if unit == "month" else F.date_sub(last, (n - 1) * (7 if unit == "week" else 1))
    spine = spark.range(1).select(F.explode(F.sequence(back, last, F.expr(step))).alias("bucket"))
    day = F.col("ts").cast("date")
    facts = analyses.where(F.col("ts").isNotNull()).withColumn("bucket", F.trunc(day, unit.upper()) if unit != "day" else day)
    facts = facts.where((F.col("bucket") >= back) & (F.col("bucket") <= last))
    counts = facts.groupBy("bucket").agg(
        *[F.count_if(F.col("label") == k).alias(k.lower()) for k in B.LABELS],
        F.count(F.lit(1)).alias("total"),
        rounded_mean(F.col("confidence")).alias("mean_confidence"),
        rounded_mean(F.when(F.col("trust_score") > 0, F.col("trust_score"))).alias("mean_trust"),
    )
    return spine.join(counts, "bucket", "left").na.fill(0)


def suspicious_keywords(analyses: DataFrame, model_terms: DataFrame, keywords: DataFrame, most: int = 8) -> DataFrame:
    """term, score, mentions over rows that aren't clearly sound.

    ``model_terms``: id, term, weight; ``keywords``: id, term, rank.  Points are in tenths, so sums are exact.
    """
    odd = analyses.where((F.col("label") != "REAL") | (F.col("trust_score") < 60) | (F.col("risk") == "HIGH"))
    odd = odd.select("id", F.when(F.col("label") == "FAKE", 10).when(F.col("label") == "UNCERTAIN", 6).otherwise(3).alias("boost"))
    a = odd.join(model_terms, "id").select("id", "term", (F.floor(F.greatest("weight", F.lit(0.08)) * 1000 + 0.5) + F.col("boost") * 10).alias("points"), F.lit(0).alias("kind"))
    b = odd.join(keywords.where("rank <= 6"), "id").select("id", "term", (50 + 4 * F.col("boost")).cast("long").alias("points"), F.lit(1).alias("kind"))
    per = a.unionByName(b).groupBy(F.lower("term").alias("term")).agg(js_round(F.sum("points") / 10).alias("score"), F.count(F.lit(1)).alias("mentions"))
    return per.orderBy(F.col("score").desc(), F.col("mentions").desc(), "term").limit(most)


def recent_feed(parts: list[tuple[DataFrame, int]], most: int = 10) -> DataFrame:
    """Feeds (kind, id, ts, title), each cut to its newest rows, one after the other."""
    out = None
    for place, (df, n) in enumerate(parts):
        part = df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n).withColumn("place", F.lit(place))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("place", F.col("ts").desc(), F.col("id").desc()).limit(most)
