"""Relational conformance beyond the text product: joins, cubes, sets, windows over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text_queries import read


def star_join(spark, sf_dir):
    """Revenue by nation and year; dimensions are left to the planner's size checks."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return j.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(cents).alias("cents"))


STAR = """SELECT n_name, year(o_orderdate)::INTEGER AS year, count(*) AS n_lines, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT))::BIGINT AS cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""


def pricing_summary(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("l_quantity")).alias("quantity"), F.max("l_discount").alias("max_discount"))


PRICING = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(floor(l_quantity) AS BIGINT))::BIGINT AS quantity, max(l_discount) AS max_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"


def semi_anti(spark, sf_dir):
    """Customers with and without orders."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    on = c.c_custkey == o.o_custkey
    buyers = c.join(o, on, "left_semi").select("c_custkey", F.lit("buyer").alias("kind"))
    others = c.join(o, on, "left_anti").select("c_custkey", F.lit("other").alias("kind"))
    return buyers.unionByName(others).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


SEMI = """SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'buyer' ELSE 'other' END AS kind, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1"""


def cube_rollup(spark, sf_dir):
    c = read(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))
    return c.select("c_mktsegment", "c_nationkey", F.col("level").cast("long").alias("level"), "n")


CUBE = "SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment, c_nationkey)::BIGINT AS level, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)"


def set_operations(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "first": a.subtract(b), "either": a.union(b).distinct(), "all": a.exceptAll(b)}
    out = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("keys")).select(F.lit(name).alias("op"), "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out


SETS = """WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier),
p AS (SELECT 'both' AS op, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
  UNION ALL SELECT 'either', k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'all', k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b))
SELECT o.op, count(k) AS n, coalesce(sum(k), 0)::BIGINT AS keys FROM (VALUES ('both'), ('first'), ('either'), ('all')) o(op) LEFT JOIN p ON o.op = p.op GROUP BY o.op"""


def window_ranks(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).alias("place"), F.lag("o_orderkey").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("recent"))


RANKS = """SELECT o_orderkey, row_number() OVER w::INTEGER AS place, lag(o_orderkey) OVER w AS before, ntile(4) OVER w::INTEGER AS quarter, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


def as_of_join(spark, sf_dir):
    """For each purchase, the user's latest earlier click: one union and one window, no range join."""
    e = read(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.where("event_type IN ('click', 'purchase')").select("event_id", "event_type", seen.alias("click_id")).where("event_type = 'purchase'").select("event_id", "click_id")


AS_OF = """WITH e AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id
  FROM events WHERE event_type IN ('click', 'purchase')) SELECT event_id, click_id FROM e WHERE event_type = 'purchase'"""

QUERIES = {f.__name__: f for f in (star_join, pricing_summary, semi_anti, cube_rollup, set_operations, window_ranks, as_of_join)}
ORACLES = {"star_join": STAR, "pricing_summary": PRICING, "semi_anti": SEMI, "cube_rollup": CUBE, "set_operations": SETS, "window_ranks": RANKS, "as_of_join": AS_OF}
