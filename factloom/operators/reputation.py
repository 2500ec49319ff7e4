"""Source reputation: hosts against a registry of domains and aliases.

A host matches an entry if it equals, or ends in a dot and, the domain or an
alias; the entry that stands first wins.  Written as an equi-join of the host's
suffixes with the registry's names, not as a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import labels as B
from factloom.functions import lexicons as L


def badge_of(score, badge=None):
    derived = F.when(score >= 80, "Trusted").when(score >= 55, "Medium").otherwise("Suspicious")
    return derived if badge is None else F.when(badge.isin("Trusted", "Medium", "Suspicious"), badge).otherwise(derived)


def registry(spark: SparkSession, entries=L.REGISTRY) -> DataFrame:
    """place, domain, aliases, badge, trust, bias, country, reliability."""
    rows = [(i, *e) for i, e in enumerate(entries) if e[0]]
    df = spark.createDataFrame(rows, "place int, domain string, aliases array<string>, badge string, trust int, bias string, country string, reliability string")
    return df.withColumn("badge", badge_of(F.col("trust"), F.col("badge"))).withColumn("aliases", F.array_distinct(F.transform("aliases", lambda a: F.lower(F.trim(a)))))


def with_reputation(df: DataFrame, host: str, entries: DataFrame) -> DataFrame:
    """``df`` with domain, badge, trust, bias, country, reliability (null: not in the registry).

    Only distinct hosts meet the registry; the registry is small by nature and
    left to the planner's own size check for broadcasting.
    """
    hosts = df.select(F.col(host).alias("_host")).where("_host <> ''").distinct()
    parts = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    names = entries.select(F.explode(F.array_distinct(F.concat(F.array("domain"), F.col("aliases")))).alias("_name"), "place", "domain", "badge", "trust", "bias", "country", "reliability")
    found = hosts.select("_host", F.explode(suffixes).alias("_name")).join(names, "_name")
    best = found.groupBy("_host").agg(F.min_by(F.struct("domain", "badge", "trust", "bias", "country", "reliability"), "place").alias("e")).select("_host", "e.*")
    return df.join(best, F.col(host) == F.col("_host"), "left").drop("_host")


def domain_usage(df: DataFrame, most: int = 8) -> DataFrame:
    """host, n, trust (mean of positive scores, rounded), badge last seen; expects host, trust_score, badge, pos."""
    used = df.where((F.col("host") != "") & (F.col("host") != "Unknown domain"))
    per = used.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col("trust_score") > 0, F.col("trust_score"))), F.lit(0.0)).alias("_mean"), F.max_by("badge", "pos").alias("badge"))
    out = per.withColumn("trust", F.floor(F.col("_mean") + 0.5)).drop("_mean")
    return out.orderBy(F.col("n").desc(), F.col("trust").desc(), "host").limit(most)


def page_host(url: str = "url"):
    return B.domain(F.col(url))
