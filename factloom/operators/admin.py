"""Users, counts, previews, notifications and status: small projections and aggregates."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import labels as B
from factloom.functions import text as X

from . import html as H
from . import reputation as R

#: Sources of the local corpus that count as trusted (fixed value).
TRUSTED_SOURCES = ["Reuters dataset"]
SECRETS = ("password_hash",)


# ---------------------------------------------------------------- users and keys


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """At most one row; the filter on the key reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def public(users: DataFrame) -> DataFrame:
    return users.drop(*SECRETS)


def users_by_name(users: DataFrame) -> DataFrame:
    return public(users).orderBy("name", "email")


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """Whatever the case."""
    return users.where(F.lower("email") == email.strip().lower()).limit(1)


def password_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def token(payload: Column) -> Column:
    """A struct as base64 of its JSON; nothing is signed."""
    return F.base64(F.to_json(payload).cast("binary"))


def read_token(x: Column, schema: str) -> Column:
    """Null for what is no base64 or no JSON."""
    return F.from_json(F.try_to_binary(x, F.lit("base64")).cast("string"), schema)


# ---------------------------------------------------------------- documents


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document or lines of them; nothing there is an empty table."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_first(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Of several paths the first that is there."""
    for path in paths:
        jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            return read_documents(spark, path, schema)
    return spark.createDataFrame([], schema)


def write_report(spark: SparkSession, path: str, payload: dict) -> None:
    """A report of a bounded size as one indented JSON file, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(payload, indent=2, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def seed(tables: dict[str, DataFrame], path: str) -> None:
    """Each table to its folder; a folder is replaced as a whole, there is no transaction over all of them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def written_at(x: Column, as_of: str | None = None) -> Column:
    """A timestamp; what is none becomes ``as_of``, or null without it."""
    found = F.try_to_timestamp(x.cast("string"))
    return found if as_of is None else F.coalesce(found, F.lit(as_of).cast("timestamp"))


def missing_names(expected: DataFrame, available: DataFrame, name: str = "name") -> DataFrame:
    return expected.select(name).distinct().join(available.select(name), name, "left_anti").orderBy(name)


# ---------------------------------------------------------------- counts and previews


def overview(users: DataFrame, articles: DataFrame, analyses: DataFrame, logs: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """One row of counts, with what is known of the model."""
    n = F.count(F.lit(1))
    one = users.agg(n.alias("users"), F.count_if(F.col("status") == "Active").alias("active_users"), F.count_if(F.col("role") == "Admin").alias("admins"), F.count_if(F.col("role") == "Analyst").alias("analysts"))
    rows = [articles.agg(n.alias("articles"), F.count_if(F.col("label") == "REAL").alias("real_articles"), F.count_if(F.col("label") == "FAKE").alias("fake_articles")), analyses.agg(n.alias("analyses"))]
    if logs is not None:
        rows.append(logs.agg(n.alias("log_entries")))
    for r in rows:  # one row each
        one = one.crossJoin(F.broadcast(r))
    known = model or {}
    return one.withColumns({k: F.lit(known.get(k, none)) for k, none in (("best_model", "Unavailable"), ("model_version", "Unavailable"), ("model_status", "unknown"))})


def system_status(articles: DataFrame, analyses: DataFrame, health: dict | None = None) -> DataFrame:
    h = health or {}
    status = h.get("status", "unknown")
    one = articles.agg(F.count(F.lit(1)).alias("articles")).crossJoin(F.broadcast(analyses.agg(F.count(F.lit(1)).alias("analyses"))))  # one row
    fixed = {"status": status, "status_label": "Operational" if status == "ok" else "Degraded", "store": h.get("store", "json"), "model_status": h.get("model_status", "unknown"), "best_model": h.get("best_model"), "model_version": h.get("model_version"), "last_analysis_at": h.get("last_analysis_at")}
    return one.withColumns({k: F.lit(v).cast("string") for k, v in fixed.items()} | {"confidence_threshold": F.lit(float(h.get("confidence_threshold", 0.72)))})


def dataset_preview(articles: DataFrame, order: str, most: int = 12) -> DataFrame:
    """The first articles, with preview (180 characters) and summary."""
    first = articles.orderBy(order).limit(most)
    return first.withColumns({"preview": F.substring(F.coalesce("text", F.lit("")), 1, 180), "summary": X.summary(F.col("title"), F.col("text"), 3)})


def model_versions(comparison: DataFrame, version: str = "Unavailable") -> DataFrame:
    """The candidates of a comparison; the best is in production."""
    return comparison.select("id", "name", F.lit(version).alias("version"), "accuracy", "precision", "recall", "f1", F.when(F.col("best"), "Production").otherwise("Candidate").alias("status"))


def article_preview(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Extracted articles with host, reputation and summary."""
    read = H.extract_articles(pages).withColumn("host", B.hostname(F.col("url")))
    return R.with_reputation(read, "host", registry).withColumn("summary", X.summary(F.col("title"), F.col("text")))


def notifications(analyses: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is told of each saved analysis."""
    said = F.concat(F.col("label"), F.lit(' result saved for "'), F.substring("title", 1, 80), F.lit('" at '), F.col("confidence").cast("string"), F.lit("% confidence."))
    return analyses.select(key, F.lit("Article analyzed").alias("title"), said.alias("text"), F.lit("Just now").alias("time"), F.lit(True).alias("unread"))


def trusted_corpus(articles: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Real articles of trusted sources; the filter reaches the scan."""
    return articles.where((F.col("label") == "REAL") & F.col("source").isin(TRUSTED_SOURCES if sources is None else sources))


# ---------------------------------------------------------------- scores and texts


def first_positive(*candidates: Column) -> Column:
    """Trust of an analysis: the first of several scores above 0, else 0."""
    return F.coalesce(*[F.when((c > 0) & ~F.isnan(c.cast("double")), c.cast("double")) for c in candidates], F.lit(0.0))


def probability_map(probabilities: Column) -> Column:
    """REAL, FAKE, UNCERTAIN of a map with labels in any spelling, each cut to 0..1; of several spellings the last wins."""
    entries = F.map_entries(probabilities)
    of = lambda k: F.coalesce(X.clamp(F.element_at(F.transform(F.filter(entries, lambda e: B.result_label(e["key"]) == k), lambda e: e["value"]), -1).cast("double")), F.lit(0.0))
    return F.struct(*[of(k).alias(k) for k in B.LABELS])


def binary_map(probabilities: Column) -> Column:
    """REAL and FAKE of a ``probability_map``, together 1; half and half if both are 0."""
    real, fake = probabilities["REAL"], probabilities["FAKE"]
    share = lambda x: F.when((real <= 0) & (fake <= 0), 0.5).otherwise(X.js_round(x / (real + fake), 4))
    return F.struct(share(real).alias("REAL"), share(fake).alias("FAKE"))


def model_probabilities(binary: Column, model: Column, final: Column, label: Column, score: Column) -> Column:
    """REAL, FAKE, UNCERTAIN from the first of three maps that has them; without any, from the label and its score."""
    guess = lambda k, none: F.when(label == k, F.coalesce(F.nullif(score, F.lit(0.0)), F.lit(0.5))).otherwise(none)
    of = lambda k, maps, none: X.clamp(F.coalesce(*[m[k] for m in maps], guess(k, none))).alias(k)
    return F.struct(of("REAL", (binary, model, final), 0.5), of("FAKE", (binary, model, final), 0.5), of("UNCERTAIN", (model, final), 0.0))


def claim_explanation() -> Column:
    """Expects verdict, n_support, n_contradict, n_related, confidence (fixed texts)."""
    sure = F.concat(X.js_round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    n = lambda c: F.col(c).cast("string")
    return (
        F.when(F.col("verdict") == "SUPPORTED", F.concat(F.lit("Trusted coverage aligns with this claim. "), n("n_support"), F.lit(" supporting article(s) were found with "), sure, F.lit(" confidence and no stronger contradictory signal.")))
        .when(F.col("verdict") == "CONTRADICTED", F.concat(F.lit("Trusted reporting challenges this claim. "), n("n_contradict"), F.lit(" contradicting article(s) outweighed "), n("n_support"), F.lit(" supporting article(s), producing "), sure, F.lit(" confidence in the contradiction signal.")))
        .when(F.col("n_support") + F.col("n_contradict") + F.col("n_related") == 0, "Unable to verify this claim using trusted sources.")
        .otherwise(F.concat(F.lit("Trusted sources covered related material, but the evidence was not strong enough to clearly support or contradict this claim. Evidence confidence is "), sure, F.lit(".")))
    )


def gather(providers: dict[str, Callable[[], DataFrame]], schema: str, spark: SparkSession) -> tuple[DataFrame, list[dict]]:
    """The corpora of all providers (with ``provider``), and what became of each: one that fails adds nothing."""
    out = spark.createDataFrame([], schema).withColumn("provider", F.lit(""))
    statuses = []
    for name, read in providers.items():
        try:
            df = read()
            found = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields]).withColumn("provider", F.lit(name))
        except Exception as failed:  # noqa: BLE001
            statuses.append({"id": name, "status": "failed", "reason": str(failed)[:200]})
            continue
        out = out.unionByName(found)
        statuses.append({"id": name, "status": "ok", "reason": ""})
    return out, statuses
