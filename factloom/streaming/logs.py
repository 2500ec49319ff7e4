"""Structured Streaming over the request log: append, windows, sessions, newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str, glob: str = "events*.parquet") -> DataFrame:
    """A stream of new files; the time column is cast, as watermarks need a zoned type."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """bucket, event_type, n, total: one row for each window once the watermark has passed it."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def keep_newest(events: DataFrame, target: str, checkpoint: str, n: int = 250) -> StreamingQuery:
    """A bounded log: after each batch the target holds the newest ``n`` rows, in a folder for each batch."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        both = batch if epoch == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/{epoch - 1}"))
        both.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).write.mode("overwrite").parquet(f"{target}/{epoch}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Checkpointed append: failures are raised, nothing is lost."""
    return events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
