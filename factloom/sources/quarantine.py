"""Records and rejects: lines and processed records are checked, and none is lost.

Every line that isn't blank, and every record, is either a training record or a
reject with its reason.  One pass judges; ``store`` writes both sides at once, in
folders that readers prune by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text as X

from . import datasets as DS

#: Why a line or a record is no training record, in the order in which they are asked.
MALFORMED, NO_TEXT, UNKNOWN_LABEL = "malformed", "no text", "unknown label"
FIELDS = DS.strings(*DS.RECORD)


def _reason(malformed: Column) -> Column:
    return F.when(malformed, MALFORMED).when(F.coalesce("text", F.lit("")) == "", NO_TEXT).when(F.col("label").isNull(), UNKNOWN_LABEL)


def revalidate(records: DataFrame) -> DataFrame:
    """The five fields in normal form, all other columns, and ``reason``: null for records that may be trained on."""
    return DS.conform(records).withColumn("reason", _reason(F.lit(False)))


def judge_lines(spark: SparkSession, path: str, form: str) -> DataFrame:
    """``revalidate`` of the lines of JSON ('json') or CSV ('csv', a header line is passed over) files, with file and line.

    A line is malformed if it can't be parsed, or has fewer or more cells than
    fields.  Fields that a JSON line lacks are empty.  Files are split at lines,
    so a quoted line break makes two malformed lines.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    shape = T.StructType([*FIELDS.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\\uFEFF", "").alias("line"))
    lines = lines.where(X.strip_ws(F.col("line")) != "")
    if form == "csv":
        parsed = F.from_csv("line", ", ".join(f"`{f.name}` string" for f in shape.fields), {**options, "escape": '"'})
        lines = lines.where(F.lower(F.regexp_replace("line", r'["\s]', "")) != ",".join(DS.RECORD))
    else:
        parsed = F.from_json("line", shape, options)
    rows = lines.withColumn("_r", parsed).select("file", "line", *[F.coalesce(F.col(f"_r.{c}"), F.lit("")).alias(c) for c in DS.RECORD], (F.col("_r").isNull() | F.col("_r._bad").isNotNull()).alias("_malformed"))
    return DS.conform(rows).withColumn("reason", _reason(F.col("_malformed"))).drop("_malformed")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NULL").select(*DS.RECORD)


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NOT NULL")


def store(judged: DataFrame, target: str) -> None:
    """Both sides in one pass, under kept=true and kept=false."""
    judged.withColumn("kept", F.col("reason").isNull()).write.mode("error").partitionBy("kept").parquet(target)


def read_store(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """Records and rejects that ``store`` wrote."""
    both = spark.read.parquet(target)
    return both.where("kept = 'true'").select(*DS.RECORD), both.where("kept = 'false'").drop("kept")


def summary(judged: DataFrame) -> DataFrame:
    """reason ('' for records), n."""
    return judged.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
