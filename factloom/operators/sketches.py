"""Mergeable summaries: distinct counts and exact totals by day, stored once and merged for longer spans.

A stored summary has a row for each day and group, so weeks and months are
aggregates of summaries and no event is read again; days are appended or
replaced one by one.  Distinct counts are HyperLogLog sketches: their relative
standard error is about 1.04 / sqrt(2 ** log2k) or less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG2K = 14


def standard_error(log2k: int = LOG2K) -> float:
    return 1.04 / 2 ** (log2k / 2)


def daily(events: DataFrame, group: list[str], counted: Column, log2k: int = LOG2K, time: str = "ts") -> DataFrame:
    """day, the groups, n rows, and a sketch of the values of ``counted`` (nulls aren't counted; a day with none has an empty sketch)."""
    return events.groupBy(F.to_date(time).alias("day"), *group).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(counted, F.lit(log2k)).alias("sketch"))


def merged(days: DataFrame, group: list[str], unit: str) -> DataFrame:
    """begin of each week or month (``unit``), the groups, n, and the distinct values as estimated from the days' sketches."""
    begin = F.trunc("day", unit).alias("begin")
    return days.groupBy(begin, *group).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
