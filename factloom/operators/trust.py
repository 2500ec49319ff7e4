"""Trust score: ten signals, their weighted mean, level and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import labels as B
from factloom.functions import lexicons as L
from factloom.functions import text as X


def length_score(n: Column) -> Column:
    return F.when(n > 2600, 0.58).when(n > 1800, 0.72).when(n >= 220, 1.0).when(n >= 160, 0.78).when(n >= 90, 0.5).otherwise(0.28)


def word_diversity(x: Column) -> Column:
    """Distinct words of all ASCII words of at least three characters, 0 without any."""
    words = F.filter(F.split(X.collapse(F.regexp_replace(F.lower(X.collapse(x)), r"[^a-z0-9\s]", " ")), " "), lambda w: F.length(w) >= 3)
    return F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) == 0, 0.0).otherwise(F.size(F.array_distinct(ws)) / F.size(ws))), F.lit(0))


def writing_quality(df: DataFrame) -> Column:
    """Of sentence length, structure, diversity and calm; expects sents, n_suspicious."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(X.non_empty(F.split(X.collapse(text), " ")))
    n = F.size("sents")
    asl = words / F.greatest(n, F.lit(1))
    structure = F.when(n >= 4, 1.0).when(n == 3, 0.82).when(n == 2, 0.58).otherwise(0.35)
    noise = F.least(F.lit(1.0), 0.18 * X.count_of(text, "[!?]{2,}") + 1.7 * X.uppercase_ratio(text) + 0.12 * F.col("n_suspicious"))
    return X.clamp(0.35 * B.closeness(asl, 22, 18) + 0.2 * structure + 0.2 * X.clamp((word_diversity(text) - 0.28) / 0.3) + 0.25 * (1 - noise))


def domain_score() -> Column:
    """Expects badge, trust (0..100, null: unknown), host, r_suspicious_domain."""
    host = F.coalesce("host", F.lit("")) != ""
    return F.when(F.col("trust").isNotNull(), F.col("trust") / 100).when(host & (F.col("r_suspicious_domain") >= 0.72), 0.16).when(host, 0.56).otherwise(0.38)


def domain_texts() -> tuple[Column, Column]:
    """What is said of a domain (fixed values)."""
    host, badge = F.coalesce("host", F.lit("")) != "", F.coalesce("badge", F.lit(""))
    known = F.col("trust").isNotNull()
    odd = host & (F.col("r_suspicious_domain") >= 0.72)
    good = (
        F.when(known & (badge == "Trusted"), "Reliable domain")
        .when(known & (badge == "Medium"), "Domain has mixed but known reputation signals")
        .when(known, "The domain appears in the suspicious-source registry")
        .when(odd, "Domain reputation looks acceptable.")
        .when(host, "Domain reputation is acceptable.")
        .otherwise("Source domain is present.")
    )
    bad = (
        F.when(known & (badge == "Suspicious"), "The domain is listed as suspicious in the source reputation registry.")
        .when(known & (badge == "Medium"), "The domain has mixed or medium reputation signals.")
        .when(known, "Domain reputation is not strong enough to build high trust.")
        .when(odd, "The domain looks suspicious or low-reputation.")
        .when(host, "The domain is not clearly established as reliable.")
        .otherwise("No clear domain reputation signal is available.")
    )
    return good, bad


def source_reliability() -> Column:
    """Expects trust, badge, and the evidence columns n_claims, n_supported, n_contradicted, n_trusted, evidence_confidence."""
    base = F.when(F.col("trust").isNotNull(), F.col("trust") / 100).when(F.col("badge") == "Trusted", 0.7).otherwise(0.45)
    claims = F.greatest("n_claims", F.lit(1))
    return X.clamp(0.62 * base + 0.22 * (F.col("n_supported") / claims) + F.least(0.08 * F.col("n_trusted"), F.lit(0.18)) + 0.18 * F.col("evidence_confidence") - 0.35 * (F.col("n_contradicted") / claims))


def reliability_texts() -> tuple[Column, Column]:
    """What is said of a source's reliability (fixed values)."""
    badge, n = F.coalesce("badge", F.lit("")), F.col("n_trusted")
    holds = F.col("n_supported") >= F.col("n_contradicted")
    good = (
        F.when((badge == "Trusted") & (n > 1) & holds, "Reliable domain with multiple trusted sources")
        .when((n > 1) & holds, "Multiple trusted sources support the article")
        .when((n >= 1) & holds, "Trusted source support is available")
        .when(badge == "Trusted", "Reliable domain")
        .when(badge == "Medium", "Source reliability is mixed")
        .when(badge == "Suspicious", "The source has a weak reliability record")
        .otherwise("Source reliability is acceptable")
    )
    bad = (
        F.when(badge == "Suspicious", "The source appears in the suspicious-source registry and should be verified carefully.")
        .when(~holds, "Trusted-source support is contradicted by other reporting.")
        .when(n == 0, "Trusted-source support is weak or unavailable.")
        .otherwise("Trusted-source support is limited.")
    )
    return good, bad


def trust_score(df: DataFrame, weights: dict[str, float] = L.TRUST_WEIGHTS, high: float = 75, moderate: float = 55) -> DataFrame:
    """Ten columns s_* (0..100), trust_score, trust_level.  Expects sentiment, rules, reputation, evidence and p_real, p_fake."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    words = F.size(X.non_empty(F.split(X.collapse(F.coalesce("text", F.lit(""))), " ")))
    both = F.col("p_real") + F.col("p_fake")
    real = F.when(both > 0, X.js_round(F.col("p_real") / both, 4)).otherwise(0.5)
    unit = {
        "ml_probability": real,
        "clickbait_detection": 1 - F.col("r_clickbait_title"),
        "domain_reputation": domain_score(),
        "writing_quality": writing_quality(df),
        "sensational_language": 1 - F.col("r_sensational_phrases"),
        "emotional_language": 1 - F.greatest("r_emotional_language", "emotional_intensity"),
        "author_presence": F.when(blank("author"), 0.28).otherwise(1.0),
        "publication_date": F.when(blank("published"), 0.34).otherwise(1.0),
        "article_length": length_score(words),
        "source_reliability": source_reliability(),
    }
    percent = lambda u: F.least(F.lit(100), F.greatest(F.lit(0), X.js_round(u * 100))).cast("int")
    df = df.withColumns({f"s_{k}": percent(u) for k, u in unit.items()})
    # tenths of weights, so that the sum is exact
    total = reduce(lambda a, b: a + b, [F.col(f"s_{k}") * round(w * 10) for k, w in weights.items()])
    score = X.js_round(total / max(1, sum(round(w * 10) for w in weights.values())))
    return df.withColumn("trust_score", score.cast("int")).withColumn("trust_level", B.credibility_level(F.col("trust_score"), high, moderate))


def reasons(df: DataFrame, weights: dict[str, float] = L.TRUST_WEIGHTS) -> DataFrame:
    """trust_signals (names of those that speak), trust_reasons (texts), strengths first; the cut-offs 75 and 45 are fixed."""
    texts = {k: (F.lit(good), F.lit(bad)) for k, (good, bad) in L.TRUST_TEXTS.items()} | {"domain_reputation": domain_texts(), "source_reliability": reliability_texts()}
    signals = [F.struct(F.lit(k).alias("id"), F.col(f"s_{k}").alias("score"), (F.col(f"s_{k}") * round(w * 10)).alias("up"), ((100 - F.col(f"s_{k}")) * round(w * 10)).alias("down"), F.lit(-i).alias("place"), texts[k][0].alias("good"), texts[k][1].alias("bad")) for i, (k, w) in enumerate(weights.items())]
    df = df.withColumn("_signals", F.array(*signals))

    def ordered(key: str, text: str, keep) -> Column:
        ranked = F.sort_array(F.transform(F.filter("_signals", keep), lambda s: F.struct(s[key].alias("k"), s["place"].alias("place"), s["id"].alias("id"), s[text].alias("text"))), asc=False)
        return F.transform(ranked, lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text")))

    df = df.withColumns({"_good": ordered("up", "good", lambda s: s["score"] >= 70), "_bad": ordered("down", "bad", lambda s: s["score"] < 50)})
    mixed = F.concat(F.slice("_good", 1, 2), F.slice("_bad", 1, 2))
    picked = F.when(F.col("trust_score") >= 75, F.slice("_good", 1, 4)).when(F.col("trust_score") <= 45, F.slice("_bad", 1, 4)).otherwise(mixed)
    df = df.withColumn("_picked", F.when(F.size(picked) == 0, mixed).otherwise(picked))
    return df.withColumns({"trust_signals": F.transform("_picked", lambda s: s["id"]), "trust_reasons": F.transform("_picked", lambda s: s["text"])}).drop("_signals", "_good", "_bad", "_picked")


def trust_explanation() -> Column:
    said = F.when(F.size("trust_reasons") > 0, F.concat(F.lit("Reasons: "), F.array_join("trust_reasons", "; "), F.lit("."))).otherwise("No strong trust signals were identified.")
    return F.concat(F.lit("Trust Score "), F.col("trust_score"), F.lit("/100 indicates "), F.lower("trust_level"), F.lit(". "), said)
