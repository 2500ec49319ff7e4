"""Events that belong to an earlier one for a limited time: answers to requests, activity under a token.

The joins take streams or tables; streams need the watermarks that are set here,
so that state goes once no partner can come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Life of a session from its issue, and the longest that an answer is waited for.
LIFE, PATIENCE = "12 hours", "10 minutes"


def _marked(df: DataFrame, time: str, late: str) -> DataFrame:
    return df.withWatermark(time, late) if df.isStreaming else df


def answered(requests: DataFrame, responses: DataFrame, key: str = "request_id", patience: str = PATIENCE, late: str = "1 hour") -> DataFrame:
    """``requests`` (key, ts, ...) with answered_at, duration_ms and the other columns of the response (key, ts, ...).

    One row for each response within ``patience``; a request without any has one
    row with nulls, in a stream once the watermark has passed its limit.
    """
    left = _marked(requests, "ts", late).alias("q")
    right = _marked(responses.withColumnRenamed("ts", "answered_at").withColumnRenamed(key, "_key"), "answered_at", late).alias("s")
    within = F.col("s.answered_at").between(F.col("q.ts"), F.col("q.ts") + F.expr(f"INTERVAL {patience}"))
    joined = left.join(right, (F.col(f"q.{key}") == F.col("s._key")) & within, "left_outer")
    return joined.drop("_key").withColumn("duration_ms", F.expr("unix_millis(answered_at) - unix_millis(ts)"))


def under_tokens(activity: DataFrame, tokens: DataFrame, key: str = "user_id", life: str = LIFE, late: str = "1 hour") -> DataFrame:
    """``activity`` (key, ts, ...) with token_id and issued of each token (key, token_id, issued) alive at ts; nulls where none is: refused.

    A token lives from its issue up to ``life`` later, whatever happens meanwhile.
    """
    left = _marked(activity, "ts", late).alias("a")
    right = _marked(tokens.withColumnRenamed(key, "_key"), "issued", late).alias("t")
    alive = (F.col("a.ts") >= F.col("t.issued")) & (F.col("a.ts") < F.col("t.issued") + F.expr(f"INTERVAL {life}"))
    return left.join(right, (F.col(f"a.{key}") == F.col("t._key")) & alive, "left_outer").drop("_key")


def newest_token(activity: DataFrame, tokens: DataFrame, key: str = "user_id", life: str = LIFE) -> DataFrame:
    """``activity`` once, with token_id and issued of its newest live token (largest id of equal times), or nulls. Tables only.

    As lives are equal, the newest token is alive if any is.  Time is cut into
    spans of one life and a token is copied to the next, so a key with many
    rows is many groups, and no pairs of activity and tokens are made.
    """
    width = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {life})")
    span = lambda c: F.floor(F.expr(f"unix_micros({c})") / width).cast("long")
    rows = activity.select(F.struct(*activity.columns).alias("row"), F.col(key).alias("key"), F.col("ts").alias("at"), F.lit(None).cast(tokens.schema["token_id"].dataType).alias("token_id"), span("ts").alias("span"))
    marks = tokens.where(F.col(key).isNotNull()).select(
        F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col(key).alias("key"), F.col("issued").alias("at"), "token_id", F.explode(F.array(span("issued"), span("issued") + 1)).alias("span")
    )
    so_far = W.partitionBy("key", "span").orderBy("at", F.col("row").isNotNull(), "token_id").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.col("row").isNull(), F.struct("token_id", F.col("at").alias("issued")))
    seen = rows.unionByName(marks).withColumn("token", F.last(mark, ignorenulls=True).over(so_far)).where("row IS NOT NULL")
    alive = F.when(F.col("at") < F.col("token.issued") + F.expr(f"INTERVAL {life}"), F.col("token"))
    return seen.select("row", alive.alias("token")).select("row.*", "token.token_id", "token.issued")
