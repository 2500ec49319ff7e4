"""The whole analysis of articles: every operator of the package composed to one record.

Text statistics and scores are column expressions over the articles; evidence
and keywords come from tables that are joined by the article's key once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import labels as B
from factloom.functions import lexicons as L
from factloom.functions import text as X

from . import evidence as E
from . import html as H
from . import intelligence as I
from . import reputation as R
from . import trust as T

LEAST_CHARS = 40
HEURISTIC = "Heuristic Fallback Analyzer"
NO_EVIDENCE = "Unable to verify this claim using trusted sources."


def _given(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""


def requests(articles: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Articles with title, text, source, url, author, published filled from their pages (``H.extract_articles``, by url) where they are short, and ``error`` (null: fit to be analysed)."""
    have = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in articles.columns else F.lit("") for c in ("title", "text", "source", "url", "author", "published")}
    df = articles.withColumns(have)
    df = df.withColumn("url", F.when((F.col("url") == "") & B.is_http_url(F.col("source")), F.col("source")).otherwise(F.col("url")))
    if pages is not None:
        found = pages.groupBy(F.col("url").alias("_url")).agg(F.min(F.struct("title", "text", "author", "published")).alias("_page"))
        df = df.join(found, (F.col("url") == F.col("_url")) & (F.length("text") < 180), "left")
        filled = {c: F.when(F.col(c) == "", F.coalesce(F.col("_page")[c], F.lit(""))).otherwise(F.col(c)) for c in ("title", "text", "author", "published")}
        df = df.withColumns(filled).withColumn("source", F.when(F.col("_page").isNotNull(), B.hostname(F.col("url"))).otherwise(F.col("source"))).drop("_url", "_page")
    df = df.withColumn("source", F.when(F.col("source") == "", "Manual input").otherwise(F.col("source")))
    return df.withColumn("error", F.when(F.length(F.trim("text")) < LEAST_CHARS, "There is not enough readable article text to analyze.").when(X.looks_like_script(F.col("text")), "The submitted text looks like webpage script or boilerplate instead of article content."))


def _percent(x: Column) -> Column:
    return X.js_round(x * 100).cast("int").cast("string")


def recommendation() -> Column:
    """Expects label, credibility, n_suspicious, the rules, author, published (fixed texts)."""
    risky = F.filter(F.array(*[F.when(F.col(f"r_{k}") >= 0.55, F.lit(t.lower())) for k, t in L.RULE_TITLES.items()]), lambda t: t.isNotNull())
    missing = F.filter(F.array(F.when(~_given("author"), F.lit("author")), F.when(~_given("published"), F.lit("publication date"))), lambda m: m.isNotNull())
    fake = F.concat(F.lit("High risk of misinformation. Do not share this article until it is verified against reputable outlets and primary sources."), F.when(F.size(risky) > 0, F.concat(F.lit(" Review these warning areas first: "), F.array_join(F.slice(risky, 1, 3), ", "), F.lit("."))).otherwise(""))
    unsure = F.concat(F.lit("Treat this article as unverified for now. Compare it with at least two trusted publishers, inspect quoted evidence, and confirm metadata before relying on it."), F.when(F.size(missing) > 0, F.concat(F.lit(" Missing: "), F.array_join(missing, " and "), F.lit("."))).otherwise(""))
    real = F.concat(F.lit("The article appears relatively credible in the language-based review with a "), F.col("credibility").cast("string"), F.lit("/100 base credibility score. Still confirm the source, quoted evidence, and publication context before making decisions based on it."), F.when(F.col("n_suspicious") > 0, " A few sentences still deserve a closer read.").otherwise(""))
    return F.when(F.col("label") == "FAKE", fake).when(F.col("label") == "UNCERTAIN", unsure).otherwise(real)


def explanation(model: str, version: str) -> Column:
    """Expects label, p_real, p_fake, the rules, credibility, language_name, category, keywords (fixed texts)."""
    both = F.col("p_real") + F.col("p_fake")
    fake = F.when(both > 0, X.js_round(F.col("p_fake") / both, 4)).otherwise(0.5)
    ranked = F.array(*[F.struct(F.col(f"r_{k}").alias("score"), X.js_round(F.col(f"r_{k}") * L.RULE_WEIGHTS[k], 6).alias("weighed"), F.lit(-i).alias("place"), F.lit(t.lower()).alias("title")) for i, (k, t) in enumerate(L.RULE_TITLES.items())])
    strong = F.transform(F.filter(ranked, lambda r: r["score"] > 0.2), lambda r: F.struct(r["weighed"].alias("w"), r["place"].alias("p"), r["title"].alias("t")))
    rules = F.array_join(F.transform(F.slice(F.sort_array(strong, asc=False), 1, 3), lambda r: r["t"]), ", ")
    words = F.array_join(F.slice("keywords", 1, 6), ", ")
    name = f"{model} model{f' ({version})' if version else ''}"
    return F.concat(
        F.lit("The "), F.col("label"), F.lit(f" decision combined the {name} with a rule-based credibility review. The model estimated "), _percent(fake),
        F.lit("% fake likelihood, the rule engine contributed "), _percent(F.col("rule_risk")),
        F.lit("% risk, and the base credibility score before evidence verification and trust weighting is "), F.col("credibility").cast("string"),
        F.lit("/100. Detected language: "), F.col("language_name"), F.lit(". Article category: "), F.col("category"),
        F.lit(". Influential keywords: "), F.when(words == "", "not enough strong keywords").otherwise(words),
        F.lit(". Highest-impact rule signals: "), F.when(rules == "", "no major rule signals").otherwise(rules), F.lit("."),
    )


def with_evidence(df: DataFrame, corpus: DataFrame, key: str, lex: I.Lexicon) -> DataFrame:
    """Claims matched to ``corpus`` (item_id, title, text, source), rolled up: n_claims, n_supported, n_contradicted, n_unverified, n_evidence, supporting, contradicting, n_trusted, similarity, evidence_confidence, evidence_credibility, evidence_verdict, main_claims, trusted_sources."""
    claims = E.main_claims(df, key, lex=lex)
    matches = E.match_evidence(claims, corpus, key, lex=lex)
    verdicts = E.claim_verdicts(claims, matches, corpus, key)
    up = E.roll_up(verdicts, key).withColumnRenamed("overall", "evidence_verdict")
    means = verdicts.groupBy(key).agg(F.count_if(F.col("verdict") == "UNVERIFIED").alias("n_unverified"), X.js_round(F.sum(X.js_round(F.col("mean_similarity") * 10000)) / F.count(F.lit(1)) / 10000, 4).alias("similarity"))
    named = E.best_evidence(matches, corpus, key)
    articles = named.select(key, "item_source", "item_title", "stance").distinct()
    sources = articles.groupBy(key).agg(F.count_if(F.col("stance") == "SUPPORT").alias("supporting"), F.count_if(F.col("stance") == "CONTRADICT").alias("contradicting"), F.slice(F.array_sort(F.collect_set("item_source")), 1, 6).alias("trusted_sources"))
    said = claims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "claim"))), lambda c: c["claim"]).alias("main_claims"))
    out = df.join(up, key, "left").join(means, key, "left").join(sources, key, "left").join(said, key, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"trusted_sources": F.coalesce("trusted_sources", none), "main_claims": F.coalesce("main_claims", none), "evidence_verdict": F.coalesce("evidence_verdict", F.lit("UNVERIFIED"))})
    return out.na.fill(0, ["n_claims", "n_supported", "n_contradicted", "n_unverified", "n_evidence", "supporting", "contradicting", "similarity", "evidence_confidence"]).withColumn("n_trusted", F.size("trusted_sources"))


def analyze(articles: DataFrame, corpus: DataFrame, registry: DataFrame, key: str = "doc_id", lex: I.Lexicon = L.ENGLISH, threshold: float = 0.72, model: str = HEURISTIC, version: str = "") -> DataFrame:
    """One record for each article (``requests``) that is fit to be analysed.

    ``corpus``: item_id, title, text, source of trusted articles.  If the articles
    carry p_real and p_fake of a model, these are fused, otherwise those of the
    rule-based classifier.
    """
    base = articles.where("error IS NULL").drop("error") if "error" in articles.columns else articles
    base = base.withColumn("title", F.when(_given("title"), F.trim("title")).otherwise(X.headline(F.col("text"))))
    if "host" not in base.columns:
        base = base.withColumn("host", B.domain(F.when(F.col("url") != "", F.col("url")).otherwise(F.col("source"))))
    if "badge" not in base.columns:
        base = R.with_reputation(base, "host", registry)
    # language, entities and topics see the title too
    a = base.withColumns({"_body": F.col("text"), "text": F.concat_ws(". ", F.nullif("title", F.lit("")), "text")})
    a = I.entities(I.language(I.prepare(a))).withColumn("text", F.col("_body")).drop("_body")
    a = I.topics(I.emotions(I.readability(I.readability_counts(I.sentiment(I.prepare(a), lex))), lex), lex)
    a = I.rules(I.count_suspicious(a, lex), lex)
    given = {"p_real", "p_fake"} <= set(a.columns)
    a = I.fuse(a if given else I.heuristic(a, threshold, lex), threshold)
    a = I.rule_findings(I.writing_style(a, lex))
    words = I.keywords(a, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda k: k["term"]).alias("keywords"))
    a = a.join(words, key, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    a = with_evidence(a, corpus, key, lex)
    a = T.reasons(T.trust_score(a))
    a = a.withColumns({"language_name": F.coalesce(F.create_map(*[F.lit(v) for kv in L.LANGUAGE_NAMES.items() for v in kv])[F.col("language")], F.lit("Unknown")), "confidence_score": F.col("confidence")})
    found = F.concat(F.lit("Claim-level verification found "), F.col("n_supported"), F.lit(" supported, "), F.col("n_contradicted"), F.lit(" contradicted, and "), F.col("n_unverified"), F.lit(" unverified claims with "), _percent(F.col("evidence_confidence")), F.lit("% evidence confidence."))
    has = F.col("n_evidence") > 0
    advice = F.when(has, "Review the evidence report before sharing the article.").otherwise("Unable to verify this claim with trusted-source evidence, so manual review is recommended.")
    a = a.withColumns(
        {
            "explanation": F.concat_ws(" ", explanation(model, version), F.when(has, found).otherwise(NO_EVIDENCE)),
            "recommendation": F.concat_ws(" ", recommendation(), advice),
            "trust_explanation": T.trust_explanation(),
            "summary": X.summary(F.col("title"), F.col("text"), 4),
            "adjusted_credibility": E.adjusted_credibility(F.col("credibility"), F.col("evidence_credibility"), F.col("evidence_confidence"), F.col("n_evidence")),
            "risk": B.risk_level(F.col("label"), F.col("confidence_score")),
            "confidence": X.js_round(F.col("confidence_score") * 100).cast("int"),
            "influential": F.transform("keywords", lambda k, i: F.struct(k.alias("term"), X.js_round(0.8 - i * 0.08, 3).alias("weight"))),
            "model": F.lit(model),
            "model_version": F.lit(version),
            "preview": F.substring("text", 1, 320),
        }
    )
    scores = [f"s_{k}" for k in L.TRUST_WEIGHTS]
    return a.select(
        key, "title", "source", "url", "author", "published", "label", "confidence", "confidence_score", "risk", "f_real", "f_fake", "f_uncertain", "p_real", "p_fake", "rule_risk", "findings", "n_suspicious",
        F.col("credibility").alias("base_credibility"), "adjusted_credibility", F.col("trust_score").alias("credibility"), "trust_score", "trust_level", "trust_signals", "trust_reasons", "trust_explanation", *scores,
        "host", "domain", "badge", F.col("trust").alias("source_trust"), "bias", "country", "reliability", "language", "language_name", "language_confidence", "sentiment", "sentiment_score", "emotional_intensity", "emotion", "second_emotion",
        "emotion_score", "topic", "category", "topic_confidence", "level", "flesch", "grade", "style", "style_share", "people", "organizations", "locations", "dates", "keywords", "influential", "main_claims", "n_claims", "n_supported", "n_contradicted",
        "n_unverified", "n_evidence", "supporting", "contradicting", "trusted_sources", "similarity", "evidence_confidence", "evidence_credibility", "evidence_verdict", "summary", "explanation", "recommendation", "model", "model_version", "preview", "text",
    )


def analyze_pages(pages: DataFrame, corpus: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """``analyze`` of pages (page_id, url, html) by what is extracted from them."""
    read = H.extract_articles(pages).withColumns({"source": B.hostname(F.col("url"))})
    return analyze(requests(read.select("page_id", "title", "text", "source", "url", "author", "published")), corpus, registry, key="page_id", **options)
