"""Training datasets: readers, conforming, profile, deduplication, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factloom.functions import labels as B
from factloom.functions import lexicons as L
from factloom.functions import text as X

RECORD = ["text", "title", "label", "source", "dataset_type"]
# Columns, labels, names and types of the datasets.
LIAR_COLUMNS = ["id", "label", "statement", "subjects", "speaker", "speaker_job_title", "state_info", "party_affiliation", "barely_true_counts", "false_counts", "half_true_counts", "mostly_true_counts", "pants_on_fire_counts", "context"]
LIAR_LABELS = {"true": "REAL", "mostly-true": "REAL", "false": "FAKE", "pants-fire": "FAKE", "half-true": "UNCERTAIN", "barely-true": "UNCERTAIN", "mostly false": "FAKE"}
FEVER_LABELS = {"SUPPORTS": "REAL", "REFUTES": "FAKE", "NOT ENOUGH INFO": "UNCERTAIN", "NEI": "UNCERTAIN"}
ARTICLE_SOURCE, LIAR_SOURCE, FEVER_SOURCE = "Kaggle Fake and Real News", "LIAR Dataset", "FEVER"
ARTICLE_TYPE, LIAR_TYPE, FEVER_TYPE = "article", "claim", "claim_verification"
SMALL, UNKNOWN_SHARE = 50, 0.2


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _mapped(x: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), x)


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as strings, null as ''; BOM and quoted line breaks are read."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _listed(*parts: Column) -> Column:
    return F.array_join(X.non_empty(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts])), " | ")


def read_articles(spark: SparkSession, fake: str, true: str) -> DataFrame:
    """Two files of articles, the label from which file, the source from subject and date."""

    def part(path: str, label: str) -> DataFrame:
        df = read_csv(spark, path, ("title", "text"))
        own = [F.col(c) for c in ("subject", "date") if c in df.columns]
        return df.select("text", "title", F.lit(label).alias("label"), _listed(F.lit(ARTICLE_SOURCE), *own).alias("source"), F.lit(ARTICLE_TYPE).alias("dataset_type"))

    return part(fake, "FAKE").unionByName(part(true, "REAL"))


def read_liar(spark: SparkSession, path: str) -> DataFrame:
    """Fourteen tab-separated columns, with or without a header line; short lines are padded; unknown labels are passed over."""
    raw = spark.read.csv(path, sep="\t", schema=strings(*LIAR_COLUMNS), quote="")
    rows = raw.na.fill("").where(~((F.lower("label") == "label") & (F.lower("statement") == "statement")))
    source = _listed(F.lit(LIAR_SOURCE), F.col("speaker"), F.col("party_affiliation"), F.col("context"))
    label = _mapped(F.lower(F.trim("label")), LIAR_LABELS)
    text = F.trim("statement")
    return rows.select(text.alias("text"), X.title_from(text, 96).alias("title"), label.alias("label"), source.alias("source"), F.lit(LIAR_TYPE).alias("dataset_type")).where("label IS NOT NULL")


def evidence_pages(evidence: Column) -> Column:
    """Pages that evidence (JSON) names, in order: the third part of a listed sentence, or page or title of an object, in groups or alone."""
    empty = F.array().cast("array<string>")
    kind = lambda v: F.schema_of_variant(v)
    items = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    named = lambda v: F.coalesce(F.nullif(F.try_variant_get(v, "$.page", "string"), F.lit("")), F.try_variant_get(v, "$.title", "string"))
    listed = lambda v: F.when(kind(F.get(items(v), F.lit(2))) == "STRING", F.try_variant_get(v, "$[2]", "string"))
    item = lambda v: F.when(F.startswith(kind(v), F.lit("ARRAY")), listed(v)).when(F.startswith(kind(v), F.lit("OBJECT")), named(v))
    group = lambda v: F.when(F.startswith(kind(v), F.lit("ARRAY")), F.transform(items(v), item)).when(F.startswith(kind(v), F.lit("OBJECT")), F.array(named(v))).otherwise(empty)
    return F.filter(F.flatten(F.transform(items(F.try_parse_json(evidence)), group)), lambda p: p.isNotNull() & (p != ""))


def read_fever(spark: SparkSession, path: str) -> DataFrame:
    """Claims as JSON lines; the source is the first page that the row or its evidence names; unknown labels are passed over."""
    rows = read_jsonl(spark, path, strings("claim", "label", "page_title", "title", "source", "wiki_page", "evidence"))
    own = [F.nullif(c, F.lit("")) for c in ("page_title", "title", "source", "wiki_page")]
    page = F.trim(F.coalesce(*own, F.get(evidence_pages(F.col("evidence")), F.lit(0))))
    source = F.when(page.isNull(), FEVER_SOURCE).otherwise(F.concat(F.lit(f"{FEVER_SOURCE} | "), page))
    label = _mapped(F.upper(F.trim("label")), FEVER_LABELS)
    text = F.trim(F.coalesce("claim", F.lit("")))
    return rows.select(text.alias("text"), X.title_from(text, 100).alias("title"), label.alias("label"), source.alias("source"), F.lit(FEVER_TYPE).alias("dataset_type")).where("label IS NOT NULL")


def conform(df: DataFrame) -> DataFrame:
    """The five fields, normal white space; an unknown label becomes null, for ``quarantine``."""
    return df.select(
        X.collapse(F.col("text")).alias("text"),
        X.collapse(F.col("title")).alias("title"),
        B.training_label(F.col("label")).alias("label"),
        F.coalesce(F.nullif(X.collapse(F.col("source")), F.lit("")), F.lit("Unknown source")).alias("source"),
        F.coalesce(F.nullif(X.collapse(F.col("dataset_type")), F.lit("")), F.lit("general")).alias("dataset_type"),
        *[c for c in df.columns if c not in RECORD],
    )


def combined_text(title: Column, text: Column) -> Column:
    """Title and text, without the title if the text begins with it."""
    t, x = X.collapse(title), X.collapse(text)
    return F.when((t != "") & F.startswith(F.lower(x), F.lower(t)), x).otherwise(F.trim(F.concat(t, F.lit(" "), x)))


def signature(title: Column, text: Column) -> Column:
    """Of normal title and text."""
    return F.concat(title, F.lit("||"), text)


def normalised(df: DataFrame) -> DataFrame:
    """With ``_title`` and ``_text``, each computed once for all that read it."""
    return df.withColumns({"_title": X.normal_text(F.col("title")), "_text": X.normal_text(F.col("text"))})


def digested(df: DataFrame) -> DataFrame:
    """Records without title and text, so that no join or shuffle moves these: their signature's digest, what is blank, and the language stand for them."""
    facts = {
        "_no_text": F.trim("text") == "",
        "_no_title": F.trim("title") == "",
        "_no_language": language_hint(F.col("_text")) == "unknown",
        "_key": F.sha2(signature(F.col("_title"), F.col("_text")), 256),
    }
    return normalised(df).select(*[c for c in df.columns if c not in ("title", "text")], *[v.alias(k) for k, v in facts.items()])


def _is_digested(df: DataFrame) -> bool:
    return "_key" in df.columns


def deduplicate(df: DataFrame, order: str, key: Column | None = None) -> DataFrame:
    """First row of each signature (of records, or of what ``digested`` leaves of them); groups meet by the signature's hash, with partial aggregation, so copies don't pile up in one task."""
    if _is_digested(df):
        keyed = df
    else:
        keyed = df.withColumn("_key", F.sha2(signature(X.normal_text(F.col("title")), X.normal_text(F.col("text"))) if key is None else key, 256))
    first = keyed.groupBy("_key").agg(F.min(F.struct(order, *[c for c in df.columns if c != order])).alias("r"))
    return first.select("r.*").select(df.columns)


def language_hint(normal: Column) -> Column:
    """From the first 120 words of a normal text."""
    words = F.split(F.substring_index(normal, " ", 120), " ")
    return F.when(X.hits(words, L.ENGLISH_MARKERS) >= 2, "en").otherwise("unknown")


def profile(df: DataFrame, order: str) -> DataFrame:
    """One row: rows, blank texts and titles, duplicates, unknown languages, labels, warnings (of records, or of what ``digested`` leaves of them)."""
    n = F.count(F.lit(1))
    facts = df if _is_digested(df) else digested(df)  # the rows that aggregates see are narrow
    seen = facts.agg(
        n.alias("n_rows"),
        F.count_if("_no_text").alias("blank_texts"),
        F.count_if("_no_title").alias("blank_titles"),
        F.count_if("_no_language").alias("unknown_language"),
        *[F.count_if(F.col("label") == k).alias(f"n_{k.lower()}") for k in B.LABELS],
        F.count_distinct("_key").alias("n_distinct"),
    )
    return seen.select(
        "*",
        (F.col("n_rows") - F.col("n_distinct")).alias("duplicates"),
        (F.col("n_rows") < SMALL).alias("warn_small"),
        (F.col("unknown_language") > UNKNOWN_SHARE * F.col("n_rows")).alias("warn_language"),
    )


def merge(parts: list[DataFrame], order: str) -> DataFrame:
    """Union of conformed datasets (all whole or all ``digested``), unknown labels and blank texts out, first of each signature."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return deduplicate(both.where("label IS NOT NULL AND " + ("NOT _no_text" if _is_digested(both) else "text <> ''")), order)


def report(records: DataFrame, order: str, name: str) -> DataFrame:
    """One row: sizes before and after cleaning, blank and repeated rows, warnings (texts, in order)."""
    filled = F.trim("text") != ""
    languages = deduplicate(records.where(filled), order).agg(F.count(F.lit(1)).alias("dataset_size"), F.count_if(language_hint(X.normal_text(F.col("text"))) == "unknown").alias("unknown_language"))
    seen = records.agg(F.count(F.lit(1)).alias("rows_before_cleaning"), F.count_if(~filled).alias("empty_text_rows"), F.count_if(F.trim("title") == "").alias("empty_title_rows"))
    one = seen.crossJoin(languages).withColumn("duplicate_rows", F.col("rows_before_cleaning") - F.col("empty_text_rows") - F.col("dataset_size"))  # two single rows
    said = [
        F.when(F.col("empty_text_rows") > 0, F.concat(F.lit("Removed "), F.col("empty_text_rows"), F.lit(" row(s) with empty text."))),
        F.when(F.col("duplicate_rows") > 0, F.concat(F.lit("Removed "), F.col("duplicate_rows"), F.lit(" duplicate row(s)."))),
        F.when(F.col("dataset_size") < SMALL, F.concat(F.lit(f"{name} contains "), F.col("dataset_size"), F.lit(f" cleaned row(s), which is below the recommended minimum of {SMALL}."))),
        F.when((F.col("dataset_size") > 0) & (F.col("unknown_language") > UNKNOWN_SHARE * F.col("dataset_size")), F.lit("More than 20% of rows could not be confidently identified as English.")),
    ]
    return one.select(F.lit(name).alias("dataset_name"), F.lit("ready").alias("status"), "rows_before_cleaning", F.col("dataset_size").alias("rows_after_cleaning"), "empty_text_rows", "empty_title_rows", "duplicate_rows", F.filter(F.array(*said), lambda w: w.isNotNull()).alias("warnings"))


def distributions(records: DataFrame, order: str) -> DataFrame:
    """stage (before, after cleaning), distribution (label, dataset_type, language), value, n."""
    clean = deduplicate(records.where(F.trim("text") != ""), order)
    parts = []
    for stage, df, names in (("before", records, ("label", "language")), ("after", clean, ("label", "dataset_type", "language"))):
        values = {"label": F.coalesce("label", F.lit("")), "dataset_type": F.col("dataset_type"), "language": language_hint(X.normal_text(F.col("text")))}
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("distribution"), values[n].alias("value")) for n in names])).alias("x")
        parts.append(df.select(F.lit(stage).alias("stage"), each).groupBy("stage", "x.distribution", "x.value").agg(F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1])


def missing_report(name: str, expected: list[str]) -> dict:
    """What is said of a dataset whose files aren't there."""
    return {"dataset_name": name, "dataset_type": name, "status": "missing", "expected_files": expected, "warnings": ["Dataset files were not found, so this dataset was skipped."]}


def merge_report(datasets: dict[str, DataFrame | None], order: str, expected: dict[str, list[str]] | None = None) -> tuple[DataFrame | None, dict]:
    """The merged dataset, and a report: per dataset and of the whole, available and missing ones.  None stands for a missing dataset."""
    there = {k: df for k, df in datasets.items() if df is not None}
    out = {
        "status": "ready" if there else "missing_datasets",
        "available_datasets": list(there),
        "missing_datasets": sorted(set(datasets) - set(there)),
        "datasets": {k: report(df, order, k).first().asDict(True) if df is not None else missing_report(k, (expected or {}).get(k, [])) for k, df in datasets.items()},
        "final_dataset": None,
    }
    if not there:
        return None, out | {"message": "No supported dataset files were found."}
    cleaned = [deduplicate(df.where("label IS NOT NULL AND trim(text) <> ''"), order) for df in there.values()]
    both = cleaned[0]
    for df in cleaned[1:]:
        both = both.unionByName(df)
    final = merge(cleaned, order)
    out["final_dataset"] = report(both, order, "final_dataset").first().asDict(True)
    return final, out


def seed_articles(df: DataFrame, per_label: int, order: str) -> DataFrame:
    """The first rows of each label with ids PREFIX-00001; a missing date falls on 2017-01-01 plus the place modulo 365."""
    n = F.row_number().over(W.partitionBy("label").orderBy(order))
    ranked = df.withColumn("_n", n).where(F.col("_n") <= per_label)
    parsed = F.coalesce(F.try_to_date("date", F.lit("yyyy-MM-dd")), F.try_to_date("date", F.lit("MMMM d, yyyy")))
    date = F.coalesce(parsed, F.date_add(F.lit("2017-01-01").cast("date"), ((F.col("_n") - 1) % 365).cast("int")))
    return ranked.withColumns({"id": F.concat("label", F.lit("-"), F.lpad(F.col("_n").cast("string"), 5, "0")), "date": F.date_format(date, "yyyy-MM-dd")}).drop("_n")
