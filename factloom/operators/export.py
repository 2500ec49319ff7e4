"""Exports: CSV lines with minimal quoting, JSON packages, report sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import labels as B


def csv_value(df: DataFrame, name: str) -> Column:
    """Scalars as they are, arrays of scalars joined by ' | ', others as JSON; quoted only if need be."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("array<") and not kind.startswith(("array<struct", "array<array", "array<map")):
        text = F.array_join(F.transform(name, lambda x: x.cast("string")), " | ")
    elif kind.startswith(("array", "struct", "map")):
        text = F.to_json(name)
    else:
        text = F.col(name).cast("string")
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """``line``: one CSV line for each row, without the header."""
    return df.select(F.concat_ws(",", *[csv_value(df, c) for c in columns]).alias("line"))


def csv_header(columns: list[str]) -> str:
    return ",".join(columns)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_package(rows: DataFrame, name: str = "payload") -> DataFrame:
    """Each row as a JSON document."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))


def top_terms(df: DataFrame, column: str, most: int = 8) -> DataFrame:
    """term, n over an array column, by count and name."""
    terms = df.select(F.explode(column).alias("term")).where("term <> ''")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "term").limit(most)


def sections(parts: dict[str, Column]) -> Column:
    """Report sections as an array of heading and body, blank bodies left out."""
    return F.filter(F.array(*[F.struct(F.lit(h).alias("heading"), F.coalesce(b, F.lit("")).alias("body")) for h, b in parts.items()]), lambda s: s["body"] != "")


#: Headers of the history export, in order, and the columns below them (fixed values).
HISTORY_COLUMNS = {
    "Report Type": "report_type", "Exported At": "exported_at", "Title": "title", "Article": "article", "Source": "source", "URL": "url", "Prediction": "prediction", "Confidence": "confidence", "Trust Score": "trust_score",
    "Trust Level": "trust_level", "Risk Level": "risk", "Model": "model", "Model Version": "model_version", "Source Domain": "source_domain", "Source Trust Score": "source_trust", "Source Reliability": "reliability", "Political Bias": "bias",
    "Evidence Verdict": "evidence_verdict", "Evidence Confidence": "evidence_percent", "Supporting Articles": "supporting", "Contradicting Articles": "contradicting", "Trusted Sources Found": "trusted_sources", "Keywords": "keywords",
    "Influential Keywords": "influential_terms", "Entities": "entities", "Summary": "summary", "Explanation": "explanation", "Recommendation": "recommendation", "Sentiment": "sentiment", "Language": "language_name", "Article Category": "category",
    "Reading Complexity": "level", "Writing Style": "style", "Emotion": "emotion", "Date": "date",
}
#: Columns of the export of one analysis, in order (fixed values).
ANALYSIS_COLUMNS = {
    "reportType": "report_type", "exportedAt": "exported_at", "analysisId": "analysis_id", "title": "title", "articleText": "article", "source": "source", "url": "url", "author": "author", "publishedAt": "published", "prediction": "prediction",
    "confidence": "confidence", "trustScore": "trust_score", "trustLevel": "trust_level", "riskLevel": "risk", "summary": "summary", "explanation": "explanation", "recommendation": "recommendation", "warning": "warning",
    "probabilities": "probabilities", "modelProbabilities": "model_probabilities", "keywords": "keywords", "influentialKeywords": "influential", "suspiciousSentences": "suspicious", "trustReasons": "trust_reasons", "trustSignals": "trust_signals",
    "ruleFindings": "findings", "evidenceVerdict": "evidence_verdict", "evidenceConfidence": "evidence_percent", "similarityScore": "similarity_percent", "trustedSourcesFound": "trusted_sources", "supportingArticles": "supporting",
    "contradictingArticles": "contradicting", "claimAnalyses": "claims", "entities": "entities", "sentiment": "sentiment", "language": "language_name", "articleCategory": "category", "readingComplexity": "level", "writingStyle": "style",
    "emotion": "emotion", "sourceDomain": "source_domain", "sourceTrustScore": "source_trust", "sourceBadge": "badge", "sourceReliability": "reliability", "model": "model", "modelVersion": "model_version", "systemStatus": "system_status",
    "nodeVersion": "runtime_version", "dbClient": "store", "date": "date",
}


def _conformed(df: DataFrame, kind: str, as_of: str, columns: dict[str, str], key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (as ``analyze`` makes it, whole or in part) with all columns of an export; those it has no values for are blank."""
    have = set(df.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)
    body = [F.nullif(text(c), F.lit("")) for c in ("text", "preview", "summary")]
    made = {
        "report_type": F.lit(kind),
        "exported_at": F.lit(as_of),
        "analysis_id": text(key),
        "article": F.coalesce(*body, F.lit("No article body was stored for this analysis.")),
        "prediction": text("label"),
        "source_domain": text("domain"),
        "evidence_percent": B.rounded_percent(number("evidence_confidence")),
        "similarity_percent": B.rounded_percent(number("similarity")),
        "supporting": number("supporting"),
        "contradicting": number("contradicting"),
        "influential_terms": F.transform("influential", lambda t: t["term"]) if "influential" in have else F.lit(""),
        "entities": F.struct(*[c for c in ("people", "organizations", "locations", "dates") if c in have]) if "people" in have else F.lit(""),
        "probabilities": F.struct(F.col("f_real").alias("REAL"), F.col("f_fake").alias("FAKE"), F.col("f_uncertain").alias("UNCERTAIN")) if "f_real" in have else F.lit(""),
        "model_probabilities": F.struct(F.col("p_real").alias("REAL"), F.col("p_fake").alias("FAKE")) if "p_real" in have else F.lit(""),
        "claims": F.col("main_claims") if "main_claims" in have else F.lit(""),
    }
    blank = {c: F.lit("") for c in columns.values() if c not in have and c not in made}
    out = df.withColumns({c: v for c, v in made.items() if c in columns.values()} | blank)
    return out.select(key, *columns.values(), *keep)


def history_columns(df: DataFrame, as_of: str, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return _conformed(df, "history", as_of, HISTORY_COLUMNS, key, keep)


def analysis_columns(df: DataFrame, as_of: str, key: str = "doc_id") -> DataFrame:
    return _conformed(df, "analysis", as_of, ANALYSIS_COLUMNS, key)


def history_summary(rows: DataFrame, most: int = 8) -> DataFrame:
    """One row: total, labels, mean confidence, trust and evidence (rounded), evidence_backed, top_keywords, top_domains (term, n).

    ``rows`` as ``history_columns`` makes them, with n_evidence beside them where
    it is known (otherwise supporting and contradicting articles count).
    """
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    mean = lambda c: F.floor(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) / n + 0.5).cast("long")
    backed = F.col("n_evidence") > 0 if "n_evidence" in rows.columns else F.col("supporting") + F.col("contradicting") > 0
    one = rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("prediction") == k).alias(f"n_{k.lower()}") for k in B.LABELS],
        mean("confidence").alias("mean_confidence"),
        mean("trust_score").alias("mean_trust"),
        mean("evidence_percent").alias("mean_evidence"),
        F.count_if(backed).alias("evidence_backed"),
    )
    kinds = dict(rows.dtypes)
    tops = []
    for name, column in (("top_keywords", "keywords"), ("top_domains", "source_domain")):
        terms = rows if kinds[column] == "array<string>" else rows.withColumn(column, F.array(column))
        top = top_terms(terms, column, most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term", "n"))).alias(name))
        tops.append(top.select(F.transform(name, lambda t: F.struct(t["term"].alias("term"), t["n"].alias("n"))).alias(name)))
    for top in tops:  # one row each
        one = one.crossJoin(F.broadcast(top))
    return one


def probability_items(p: dict[str, float]) -> list[dict]:
    percent = lambda x: int((x * 100 if 0 <= x <= 1 else x) + 0.5)
    return [{"label": k, "value": percent(v), "displayValue": f"{percent(v)}%"} for k, v in p.items()]


def history_report(rows: DataFrame, as_of: str, brand: str, search: str = "", label: str = "", version: str = "", order: str = "doc_id", listed: int = 20) -> dict:
    """The report of a history: metric cards, charts and sections, of one summary row and the first ``listed`` analyses."""
    s = history_summary(rows).first().asDict(True)
    share = int(100 * s["evidence_backed"] / s["total"] + 0.5) if s["total"] else 0
    mix = ", ".join(f"{k} {s[f'n_{k.lower()}']}" for k in B.LABELS)
    counted = lambda items, none: ", ".join(f"{t['term']} ({t['n']})" for t in items or []) or none
    cards = [("Analyses", str(s["total"])), ("Avg Confidence", f"{s['mean_confidence']}%"), ("Avg Trust Score", f"{s['mean_trust']}/100"), ("Avg Evidence", f"{s['mean_evidence']}%")]
    charts = [
        {"title": "Prediction Distribution", "items": [{"label": k, "value": s[f"n_{k.lower()}"]} for k in B.LABELS], "maxValue": max(1, *(s[f"n_{k.lower()}"] for k in B.LABELS))},
        {"title": "Portfolio Score Overview", "items": [{"label": "Avg Confidence", "value": s["mean_confidence"]}, {"label": "Avg Trust", "value": s["mean_trust"]}, {"label": "Avg Evidence", "value": s["mean_evidence"]}, {"label": "Evidence-backed", "value": share}], "maxValue": 100},
    ]
    parts = [
        ("Executive Summary", "\n".join([f"This export contains {s['total']} saved analyses prepared by {brand}.", f"Average confidence is {s['mean_confidence']}%, average trust score is {s['mean_trust']}/100, and {s['evidence_backed']} analysis record(s) contain trusted-source evidence.", f"Prediction mix: {mix}.", f'Filter scope: {f"Search filter: {chr(34)}{search}{chr(34)}" if search else "Search filter: none"} | {f"Label filter: {label}" if label else "Label filter: all labels"}.'])),
        ("Portfolio Insights", "\n".join([f"Top analyzed domains: {counted(s['top_domains'], 'No domains available')}", f"Top recurring keywords: {counted(s['top_keywords'], 'No recurring keywords available')}", f"UNCERTAIN analyses: {s['n_uncertain']}"])),
    ]
    for i, r in enumerate(rows.orderBy(order).limit(listed).collect()):
        words = ", ".join(dict.fromkeys(r.keywords)) if isinstance(r.keywords, list) else str(r.keywords or "")
        parts.append((f"{i + 1}. {r.title}", "\n".join([f"Prediction: {r.prediction} | Confidence: {r.confidence}% | Trust score: {r.trust_score}/100 | Risk: {r.risk or 'UNKNOWN'}", f"Source: {r.source} | Domain: {r.source_domain or 'Unknown'} | Date: {r.date}", f"Evidence: {r.supporting} supporting, {r.contradicting} contradicting, {r.evidence_percent}% evidence confidence, verdict {r.evidence_verdict or 'UNVERIFIED'}", f"Keywords: {words or 'None extracted'}", f"Summary: {r.summary or 'No summary available.'}"])))
    return {
        "meta": {"brand": brand, "reportType": "history", "generatedAt": as_of, "filters": {"search": search, "label": label}},
        "summary": s,
        "metricCards": [{"label": k, "value": v} for k, v in cards],
        "charts": charts,
        "sections": [{"heading": h, "body": b} for h, b in parts],
        "metaLine": f"Generated {as_of} | {s['total']} analyses | Model version {version or 'Not available'}",
    }


def analysis_report(df: DataFrame, as_of: str, key: str = "doc_id") -> DataFrame:
    """key, report: each analysis as a JSON package of highlights, charts and the record itself."""
    percent = lambda c: B.rounded_percent(F.coalesce(F.col(c), F.lit(0))).cast("long")
    item = lambda k, v: F.struct(F.lit(k).alias("label"), v.cast("long").alias("value"))
    charts = F.struct(
        F.array(item("REAL", percent("f_real")), item("FAKE", percent("f_fake")), item("UNCERTAIN", percent("f_uncertain"))).alias("probabilityDistribution"),
        F.array(item("Confidence", F.col("confidence")), item("Trust Score", F.col("trust_score")), item("Evidence Confidence", percent("evidence_confidence")), item("Source Trust Score", F.coalesce("source_trust", F.lit(50)))).alias("credibilityComponents"),
    )
    highlights = F.struct(F.col("label").alias("prediction"), "confidence", F.col("trust_score").alias("trustScore"), "summary", "recommendation", F.col("evidence_verdict").alias("evidenceVerdict"), F.col("trusted_sources").alias("trustedSourcesFound"))
    return df.select(key, F.to_json(F.struct(F.lit("analysis").alias("reportType"), F.lit(as_of).alias("generatedAt"), charts.alias("charts"), highlights.alias("highlights"), F.struct(*df.columns).alias("analysis"))).alias("report"))
