"""Labels, risk, dates and hosts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import LEFT, RIGHT, js_round

LABELS = ["REAL", "FAKE", "UNCERTAIN"]


def result_label(x: Column) -> Column:
    """Any spelling of a verdict; what is unknown is UNCERTAIN."""
    up = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(up.isin("REAL", "TRUE"), "REAL").when(up.isin("FAKE", "FALSE"), "FAKE").otherwise("UNCERTAIN")


def article_label(x: Column) -> Column:
    """Articles are real unless said to be fake."""
    return F.when(F.upper(F.trim(F.coalesce(x, F.lit("")))) == "FAKE", "FAKE").otherwise("REAL")


def training_label(x: Column) -> Column:
    """Null where a training label isn't known, for quarantine."""
    up = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return (
        F.when(up.isin("FAKE", "FALSE", "REFUTES", "REFUTED"), "FAKE")
        .when(up.isin("REAL", "TRUE", "SUPPORTS", "SUPPORTED"), "REAL")
        .when(up.isin("UNCERTAIN", "NEI", "NOT ENOUGH INFO", "HALF-TRUE", "HALF TRUE", "BARELY-TRUE", "BARELY TRUE", "MIXED", "UNKNOWN", "UNVERIFIED"), "UNCERTAIN")
    )


def risk_level(label: Column, score: Column) -> Column:
    return (
        F.when(label == "FAKE", F.when(score >= 0.8, "HIGH").otherwise("MEDIUM"))
        .when(label == "REAL", F.when(score >= 0.8, "LOW").otherwise("MEDIUM"))
        .otherwise(F.when(score < 0.55, "HIGH").otherwise("MEDIUM"))
    )


def trust_level(score: Column, high: float = 75, moderate: float = 55) -> Column:
    return F.when(score >= high, "High").when(score >= moderate, "Moderate").otherwise("Low")


def credibility_level(score: Column, high: float = 75, moderate: float = 55) -> Column:
    return F.concat(trust_level(score, high, moderate), F.lit(" credibility"))


def rounded_percent(x: Column) -> Column:
    return js_round(F.when(x <= 1, x * 100).otherwise(x))


def closeness(x: Column, best: float, tolerance: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.abs(x - best) / tolerance))


def is_http_url(x: Column) -> Column:
    return F.coalesce(x.rlike("(?i)^https?://") & F.try_parse_url(x, F.lit("HOST")).isNotNull(), F.lit(False))


def hostname(x: Column) -> Column:
    """Host without www., '' if there is none."""
    full = F.when(x.startswith("http"), x).otherwise(F.concat(F.lit("https://"), x))
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def domain(x: Column) -> Column:
    """A host from a link or a name; names of several words without a dot have none."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(low == "", "").when(low.rlike(r"\s") & ~low.contains("."), "").otherwise(hostname(low))


def suspicious_host(host: Column) -> Column:
    words = "|".join(L.SUSPICIOUS_HOST_WORDS)
    return host.rlike(f"(?i){LEFT}(?:{words}){RIGHT}") | host.rlike(rf"(?i)\.({'|'.join(L.SUSPICIOUS_TLDS)})$")


def age_text(minutes: Column, day: Column) -> Column:
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(minutes < 60, F.concat(F.greatest(minutes, F.lit(1)).cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hours ago")))
        .when(days <= 30, F.concat(days.cast("string"), F.lit(" days ago")))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
