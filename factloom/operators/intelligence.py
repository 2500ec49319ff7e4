"""Text intelligence: DataFrame -> DataFrame operators that add columns.

Each takes articles with ``title`` and ``text`` (and, where named, ``source``,
``url``, ``author``, ``published``).  Tokens and sentences are made once, by
``prepare``; no operator here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import labels as B
from factloom.functions import lexicons as L
from factloom.functions import text as X

Lexicon = L.Lexicon


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def prepare(articles: DataFrame) -> DataFrame:
    """Adds tokens, sents, lower_text."""
    return articles.withColumns({"tokens": X.tokens(F.col("text")), "sents": X.sentences(F.col("text")), "lower_text": F.lower(F.coalesce("text", F.lit("")))})


def sentiment(df: DataFrame, lex: Lexicon = L.ENGLISH) -> DataFrame:
    n = F.size("tokens")
    df = df.withColumns({"n_positive": X.hits(F.col("tokens"), lex.positive), "n_negative": X.hits(F.col("tokens"), lex.negative), "n_emotional": X.hits(F.col("tokens"), lex.emotional)})
    score = X.clamp((F.col("n_positive") - F.col("n_negative")) / F.greatest(n / 12, F.lit(1.0)), -1.0, 1.0)
    return df.withColumns(
        {
            "sentiment": F.when(score > 0.12, "positive").when(score < -0.12, "negative").otherwise("neutral"),
            "sentiment_score": X.js_round(score, 3),
            "emotional_intensity": X.js_round(X.clamp(F.col("n_emotional") / F.greatest(n / 14, F.lit(1.0))), 3),
        }
    )


def language(df: DataFrame) -> DataFrame:
    """language, language_confidence from marker words of the first 280 tokens; ties go to the earlier profile."""
    df = df.withColumn("_first", F.slice("tokens", 1, 280))
    accented = F.size(F.filter("_first", lambda w: w.rlike(f"(?i)[{L.ACCENTED}]")))
    scores = []
    for i, (code, markers) in enumerate(L.LANGUAGES):
        n = X.hits(F.col("_first"), markers)
        # hundredths, so that sums are exact
        scores.append(F.struct((n * 100 + (accented * 18 if i else 0)).cast("long").alias("score"), F.lit(-i).alias("place"), F.lit(code).alias("code")))
    df = df.withColumn("_scores", F.array(*scores))
    total = F.aggregate("_scores", F.lit(0).cast("long"), lambda a, s: a + s["score"])
    df = df.withColumns({"_top": F.array_max("_scores"), "_total": total})
    known = F.col("_top.score") >= 200
    out = df.withColumns(
        {
            "language": F.when((F.size("_first") == 0) | ~known, "unknown").otherwise(F.col("_top.code")),
            "language_confidence": F.when(F.size("_first") == 0, 0.0).when(~known, 0.2).otherwise(X.js_round(F.col("_top.score") / F.greatest("_total", "_top.score", F.lit(1)), 3)),
        }
    )
    return out.drop("_first", "_scores", "_top", "_total")


def readability_counts(df: DataFrame) -> DataFrame:
    """words_alpha, n_syllables, n_letters, n_distinct, n_sentences."""
    df = df.withColumn("_alpha", F.filter("tokens", lambda w: w.rlike("[a-zA-Z]")))
    return df.withColumns(
        {
            "words_alpha": F.size("_alpha"),
            "n_syllables": X.syllables_in(F.col("_alpha")),
            "n_letters": F.length(F.array_join("_alpha", "")),
            "n_distinct": F.size(F.array_distinct("_alpha")),
            "n_sentences": F.size("sents"),
        }
    ).drop("_alpha")


def readability(df: DataFrame) -> DataFrame:
    """Flesch ease and grade, level, averages; expects the counts."""
    words, sents = F.greatest("words_alpha", F.lit(1)), F.greatest("n_sentences", F.lit(1))
    asl, asw = words / sents, F.col("n_syllables") / words
    ease = 206.835 - 1.015 * asl - 84.6 * asw
    return df.withColumns(
        {
            "flesch": X.js_round(ease),
            "grade": X.js_round(0.39 * asl + 11.8 * asw - 15.59, 1),
            "level": F.when(ease < 30, "Expert").when(ease < 50, "Advanced").when(ease >= 70, "Easy").otherwise("Standard"),
            "sentence_length": X.js_round(asl, 1),
            "word_length": X.js_round(F.col("n_letters") / words, 1),
            "diversity": X.js_round(F.col("n_distinct") / words, 3),
            "syllables_per_word": X.js_round(asw, 2),
            "reading_minutes": F.greatest(F.lit(1), X.js_round(words / 220)),
        }
    )


def emotions(df: DataFrame, lex: Lexicon = L.ENGLISH) -> DataFrame:
    """emotion, second_emotion, emotion_score; ties go to the earlier lexicon."""
    n = F.size("tokens")
    ranked = F.array(*[F.struct(X.hits(F.col("tokens"), words).alias("count"), F.lit(-i).alias("place"), F.lit(name).alias("emotion")) for i, (name, words) in enumerate(lex.emotions)])
    df = df.withColumn("_ranked", F.sort_array(ranked, asc=False))
    # a score is the count over a common divisor, cut at 1: beyond the cut, counts decide, so the order is that of counts
    first, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    return df.withColumns(
        {
            "emotion": F.when(first["count"] == 0, "neutral").otherwise(first["emotion"]),
            "second_emotion": F.when((first["count"] > 0) & (second["count"] > 0), second["emotion"]),
            "emotion_score": F.when(first["count"] == 0, 0.12).otherwise(X.js_round(X.clamp(first["count"] / F.greatest(n / 22, F.lit(1.0))), 3)),
        }
    ).drop("_ranked")


def entities(df: DataFrame) -> DataFrame:
    """organizations, people, locations, dates: distinct, in order, at most 10, 12, 10, 8."""
    text = F.coalesce("text", F.lit(""))
    suffixes = "|".join(L.ORG_SUFFIXES)
    word = "[A-Z][a-z]+"
    find = lambda p: F.regexp_extract_all(text, F.lit(f"{X.LEFT}{p}{X.RIGHT}"), F.lit(1))
    df = df.withColumns(
        {
            "organizations": F.slice(F.array_distinct(find(rf"({word}(?:\s+{word}){{0,4}}\s+(?:{suffixes}))")), 1, 10),
            "_people": F.array_distinct(find(rf"({word}(?:\s+{word}){{1,2}})")),
            "_places": F.array_distinct(find(rf"(?:in|at|from|to|near)\s+({word}(?:\s+{word}){{0,2}})")),
            "dates": X.date_candidates(text),
        }
    )
    person = F.filter(F.array_except("_people", "organizations"), lambda p: ~F.split(p, " ")[0].isin(L.MONTHS) & ~p.rlike(f"(?:{suffixes})$"))
    df = df.withColumn("people", F.slice(person, 1, 12))
    return df.withColumn("locations", F.slice(F.array_except("_places", F.array_union("people", "organizations")), 1, 10)).drop("_people", "_places")


def keywords(df: DataFrame, key: str = "doc_id", most: int = 8, text: Column | None = None) -> DataFrame:
    """One row for each keyword: key, term, n, first_pos, rank.  Frequency first, then first place."""
    from pyspark.sql import Window as W

    words = df.select(key, F.posexplode_outer(X.keyword_words(F.col("text") if text is None else text)).alias("pos", "term")).where("term <> ''")
    counted = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("n").desc(), "first_pos"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)


def keyword_array(text: Column, most: int) -> Column:
    """The same keywords as an array, without a shuffle; for short texts."""
    # the words are made once, not once for each word
    scored = lambda words: F.transform(
        F.filter(F.array_distinct(words), lambda w: w != ""),
        lambda w: F.struct((-F.size(F.filter(words, lambda o: o == w))).alias("n"), F.array_position(words, w).alias("pos"), w.alias("term")),
    )
    return F.transform(F.slice(F.sort_array(X.let(X.keyword_words(text), scored)), 1, most), lambda s: s["term"])


def key_phrases(df: DataFrame, key: str = "doc_id", most: int = 8) -> DataFrame:
    """Two- and three-word phrases: key, term, score (hundredths exact), rank."""
    from pyspark.sql import Window as W

    fit = lambda w: (F.length(w) >= 4) & ~w.isin(L.CONTENT_STOP_WORDS)
    grams = df.select(key, F.posexplode_outer(F.arrays_zip(F.col("tokens").alias("a"), F.slice("tokens", 2, 1 << 30).alias("b"), F.slice("tokens", 3, 1 << 30).alias("c"))).alias("pos", "g"))
    grams = grams.select(key, "g.a", "g.b", "g.c").where(fit(F.col("a")) & fit(F.col("b")))
    two = F.struct(F.concat_ws(" ", "a", "b").alias("term"), F.lit(100).alias("w"))
    three = F.struct(F.when(F.col("c").isNotNull() & fit(F.col("c")), F.concat_ws(" ", "a", "b", "c")).alias("term"), F.lit(125).alias("w"))
    terms = grams.select(key, F.explode(F.array(two, three)).alias("t")).select(key, "t.term", "t.w").where("term IS NOT NULL")
    summed = terms.groupBy(key, "term").agg((F.sum("w") / 100).alias("score"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "term"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= most)


def keyword_metadata(df: DataFrame, key: str = "doc_id", model_terms: DataFrame | None = None) -> DataFrame:
    """Model terms, phrases and frequent words merged, the first of a key winning: key, term, origin, score, place."""
    from pyspark.sql import Window as W

    parts = []
    if model_terms is not None:
        parts.append(model_terms.select(key, "term", F.lit("model").alias("origin"), X.js_round(F.greatest("weight", F.lit(0.18)) * 100, 2).alias("score"), F.col("rank").alias("place"), F.lit(0).alias("tier")))
    parts.append(key_phrases(df, key).select(key, "term", F.lit("phrase").alias("origin"), X.js_round(F.col("score") * 18, 2).alias("score"), F.col("rank").alias("place"), F.lit(1).alias("tier")))
    parts.append(keywords(df, key, 12).select(key, "term", F.lit("frequency").alias("origin"), X.js_round(36 - (F.col("rank") - 1) * 2.2, 2).alias("score"), F.col("rank").alias("place"), F.lit(2).alias("tier")))
    merged = reduce(DataFrame.unionByName, parts)
    first = F.row_number().over(W.partitionBy(key, F.lower("term")).orderBy("tier", "place"))
    ranked = merged.withColumn("_n", first).where("_n = 1")
    order = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "tier", "place"))
    return ranked.withColumn("rank", order).where("rank <= 12").select(key, "term", "origin", "score", "rank")


def _meets(words: str, member: str) -> Column:
    return F.exists(words, lambda k: k.contains(member) | F.lit(member).contains(k)).cast("int")


def topics(df: DataFrame, lex: Lexicon = L.ENGLISH, words: str | None = None) -> DataFrame:
    """topic, topic_score, topic_confidence, topics (array, best first).  Title hits count in the body too.

    ``words``: an array column of keywords; a topic word that contains one, or is contained, adds 2.2.
    """
    head = F.lower(F.coalesce("title", F.lit("")))
    body = F.lower(F.concat_ws(" ", "title", "text"))
    scored = []
    for i, (name, category, members) in enumerate(lex.topics):
        parts = []
        for m in members:
            part = X.occurrences(head, m) * 280 + F.least(X.occurrences(body, m), F.lit(6)) * 75
            if words is not None:
                part = part + _meets(words, m) * 220
            parts.append(part)
        scored.append(F.struct(_sum(parts).cast("long").alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("topic"), F.lit(category).alias("category")))
    df = df.withColumn("topics", F.sort_array(F.filter(F.array(*scored), lambda t: t["score"] > 0), asc=False))
    total = F.aggregate("topics", F.lit(0).cast("long"), lambda a, t: a + t["score"])
    top = F.get("topics", F.lit(0))
    return df.withColumns(
        {
            "topic": F.coalesce(top["topic"], F.lit("general")),
            "category": F.coalesce(top["category"], F.lit("General")),
            "topic_score": F.coalesce(top["score"] / 100, F.lit(0.0)),
            "topic_confidence": F.coalesce(X.js_round(top["score"] / F.greatest(total, F.lit(1)), 3), F.lit(0.35)),
        }
    )


def suspicious_sentences(df: DataFrame, key: str = "doc_id", lex: Lexicon = L.ENGLISH) -> DataFrame:
    """key, pos, sentence, score (thousandths exact), rank: at most five for each text."""
    from pyspark.sql import Window as W

    each = df.select(key, F.posexplode_outer("sents").alias("pos", "sentence"))
    ranked = each.withColumn("score", _suspicion(F.col("sentence"), lex)).where("score >= 0.35")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "pos"))
    return ranked.withColumn("rank", rank).where("rank <= 5")


def _suspicion(sentence: Column, lex: Lexicon) -> Column:
    def points(low: Column, words: Column) -> Column:
        return (
            F.when(X.any_present(low, lex.sensational, words), 45).otherwise(0)
            + F.when(X.any_present(low, lex.emotional, words), 30).otherwise(0)
            + F.when(sentence.rlike("[!?]{2,}"), 20).otherwise(0)
            + F.when(X.uppercase_ratio(sentence) > 0.24, 18).otherwise(0)
            + F.when(X.any_present(low, lex.unsupported, words), 40).otherwise(0)
        )

    # the words are made once for all lists
    return F.least(X.let(F.lower(sentence), lambda low: X.let(X.ascii_words(low), lambda words: points(low, words))), F.lit(100)) / 100


def _suspicious(sentence: Column, lex: Lexicon) -> Column:
    """Whether ``_suspicion`` is 0.35 or more: one of the two heavy signs, or two of the three light ones; cheap ones are asked first."""
    marks, capital = sentence.rlike("[!?]{2,}"), X.uppercase_ratio(sentence) > 0.24

    def found(low: Column, words: Column) -> Column:
        emotional = X.any_present(low, lex.emotional, words)
        two = F.when(marks, emotional | capital).otherwise(emotional & capital)
        return X.any_present(low, [*lex.sensational, *lex.unsupported], words) | two

    return X.let(F.lower(sentence), lambda low: X.let(X.ascii_words(low), lambda words: found(low, words)))


def count_suspicious(df: DataFrame, lex: Lexicon = L.ENGLISH) -> DataFrame:
    """n_suspicious (at most 5) without exploding."""
    return df.withColumn("n_suspicious", F.least(F.size(F.filter("sents", lambda s: _suspicious(s, lex))), F.lit(5)))


def rules(df: DataFrame, lex: Lexicon = L.ENGLISH) -> DataFrame:
    """Nine rule columns r_*, rule_risk (weighted mean).  Expects host, badge (null: unknown source), author, published."""
    text = F.coalesce("text", F.lit(""))
    n = F.size("tokens")
    # each count is a column of its own first, so that no branch below computes it again
    df = df.withColumn("_words", X.ascii_words(F.col("lower_text"))).withColumns(
        {
            "_caps": X.uppercase_ratio(text),
            "_marks": X.count_of(text, "[!?]") + X.count_of(text, "[!?]{2,}") * 2,
            "_emotional": X.patterns_present(F.col("lower_text"), lex.emotional, F.col("_words")),
            "_sensational": X.patterns_present(F.col("lower_text"), lex.sensational, F.col("_words")),
            "_clickbait": X.patterns_present(F.lower(F.trim(F.coalesce("title", F.lit("")))), lex.clickbait),
        }
    )
    caps, density, emotional, sensational, clickbait = F.col("_caps"), F.col("_marks") / F.greatest(n, F.lit(1)), F.col("_emotional"), F.col("_sensational"), F.col("_clickbait")
    badge, host = F.coalesce("badge", F.lit("Unknown")), F.coalesce("host", F.lit(""))
    odd_host = (host != "") & (badge != "Trusted") & B.suspicious_host(host)
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    df = df.withColumns(
        {
            "r_clickbait_title": F.least(F.lit(1.0), clickbait / 2),
            "r_excessive_capitalization": F.when(caps >= 0.28, 1.0).when(caps >= 0.18, 0.55).otherwise(0.0),
            "r_excessive_punctuation": F.when(density >= 0.14, 1.0).when(density >= 0.08, 0.55).otherwise(0.0),
            "r_emotional_language": F.when(emotional >= 6, 1.0).when(emotional >= 3, 0.55).when(emotional > 0, 0.25).otherwise(0.0),
            "r_sensational_phrases": F.when(sensational >= 4, 1.0).when(sensational >= 2, 0.65).when(sensational > 0, 0.3).otherwise(0.0),
            "r_suspicious_domain": F.when(badge == "Suspicious", 0.98).when(odd_host, 0.92).when(badge == "Medium", 0.35).when((host != "") & (badge != "Trusted"), 0.25).otherwise(0.0),
            "r_article_length": F.when(n < 120, 0.95).when(n < 220, 0.55).when(n > 2600, 0.15).otherwise(0.0),
            "r_missing_author": F.when(blank("author"), 0.7).otherwise(0.0),
            "r_missing_publication_date": F.when(blank("published"), 0.65).otherwise(0.0),
        }
    )
    weighted = _sum([F.col(f"r_{k}") * w for k, w in L.RULE_WEIGHTS.items()])
    return df.withColumn("rule_risk", X.js_round(weighted / sum(L.RULE_WEIGHTS.values()), 4)).drop("_words", "_caps", "_marks", "_emotional", "_sensational", "_clickbait")


def rule_findings(df: DataFrame) -> DataFrame:
    """findings: the rules as an array of id, score, weight, severity."""
    severity = lambda c: F.when(c >= 0.72, "high").when(c >= 0.4, "medium").when(c > 0, "low").otherwise("none")
    return df.withColumn("findings", F.array(*[F.struct(F.lit(k).alias("id"), F.col(f"r_{k}").alias("score"), F.lit(w).alias("weight"), severity(F.col(f"r_{k}")).alias("severity")) for k, w in L.RULE_WEIGHTS.items()]))


def writing_style(df: DataFrame, lex: Lexicon = L.ENGLISH) -> DataFrame:
    """style, style_share.  Expects sentiment, readability, rules and n_suspicious."""
    text, low = F.coalesce("text", F.lit("")), F.col("lower_text")
    words = F.col("_words")
    count = lambda phrases: X.occurrences_of(low, phrases, words)
    df = df.withColumn("_words", X.ascii_words(low)).withColumns(
        {
            "_opinion": count(lex.opinionated),
            "_analysis": count(lex.analytical),
            "_talk": count(lex.conversational),
            "_person": X.hits(words, ["i", "we", "our", "my", "us"]),
            "_asks": X.count_of(text, r"\?"),
            "_quotes": F.floor(X.count_of(text, '"') / 2),
            "_numbers": X.count_of(text, X.NUMBER),
            "_loud": F.col("r_clickbait_title") + F.col("r_excessive_punctuation") + F.col("r_emotional_language") + F.col("r_sensational_phrases"),
            "_baits": X.patterns_present(F.lower(F.coalesce("title", F.lit(""))), lex.clickbait),
        }
    )
    c = F.col
    values = [
        ("Straight News", c("_quotes") * 0.18 + c("_analysis") * 0.12 + c("_numbers") * 0.06 + F.when(c("sentiment") == "neutral", 0.18).otherwise(0.0) + F.when(c("n_suspicious") > 0, 0.0).otherwise(0.12)),
        ("Analytical", c("_analysis") * 0.18 + c("_numbers") * 0.08 + c("sentence_length") / 90 + c("_quotes") * 0.04),
        ("Opinionated", c("_opinion") * 0.18 + c("_person") * 0.1 + F.abs(c("sentiment_score")) * 0.5),
        ("Conversational", c("_talk") * 0.16 + c("_asks") * 0.18 + c("_person") * 0.08),
        ("Sensational", c("_loud") * 0.55 + c("n_suspicious") * 0.18 + c("_baits") * 0.3),
    ]
    df = df.withColumn("_styles", F.array(*[F.struct(X.js_round(v, 6).alias("value"), F.lit(-i).alias("place"), F.lit(k).alias("style")) for i, (k, v) in enumerate(values)]))
    top = F.array_max("_styles")
    total = F.aggregate("_styles", F.lit(0.0), lambda a, s: a + s["value"])
    df = df.withColumns({"style": top["style"], "style_share": X.js_round(top["value"] / F.when(total == 0, 1.0).otherwise(total), 3)})
    return df.drop("_words", "_opinion", "_analysis", "_talk", "_person", "_asks", "_quotes", "_numbers", "_loud", "_baits", "_styles")


def heuristic(df: DataFrame, threshold: float = 0.72, lex: Lexicon = L.ENGLISH) -> DataFrame:
    """The rule-based classifier: h_label, h_score, margin, p_real, p_fake, p_uncertain."""
    combined = F.lower(F.concat_ws(" ", "title", "text"))
    trusted = F.when(F.coalesce("badge", F.lit("")) == "Trusted", 2).otherwise(0)
    n = F.size(X.non_empty(F.split(X.collapse(combined), " ")))
    df = df.withColumn("_words", X.ascii_words(combined))
    df = df.withColumns({"margin": X.patterns_present(combined, lex.real, F.col("_words")) + trusted - X.patterns_present(combined, lex.fake, F.col("_words")), "_n": n})
    decided = (F.col("_n") >= 45) & (F.abs("margin") >= 2)
    score = F.when(decided, F.least(F.lit(0.89), (60 + F.abs("margin") * 8) / 100)).otherwise(0.55)
    df = df.withColumn("h_score", score)
    df = df.withColumn("h_label", F.when(~decided | (F.col("h_score") < threshold), "UNCERTAIN").when(F.col("margin") > 0, "REAL").otherwise("FAKE"))
    rest = X.js_round(1 - F.col("h_score"), 4)
    pick = lambda own, other: F.when(F.col("h_label") == own, F.col("h_score")).when(F.col("h_label") == other, rest).otherwise(0.4)
    return df.withColumns({"p_real": pick("REAL", "FAKE"), "p_fake": pick("FAKE", "REAL"), "p_uncertain": F.when(F.col("h_label") == "UNCERTAIN", 0.2).otherwise(0.0)}).drop("_n", "_words")


def fuse(df: DataFrame, threshold: float = 0.72, ml_weight: float = 0.68, rule_weight: float = 0.32) -> DataFrame:
    """Model and rule risk to three probabilities: f_real, f_fake, f_uncertain, label, credibility.  Expects p_real, p_fake, rule_risk, n_suspicious."""
    w = ml_weight / (ml_weight + rule_weight)
    both = F.col("p_fake") + F.col("p_real")
    ml = F.when(both > 0, F.col("p_fake") / both).otherwise(0.5)
    df = df.withColumn("_ml", ml).withColumn("_fake", X.clamp(F.col("_ml") * w + F.col("rule_risk") * (1 - w)))
    f = F.col("_fake")
    ambiguity, conflict = 1 - F.abs(2 * f - 1), F.abs(F.col("_ml") - F.col("rule_risk"))
    gap = F.greatest(F.lit(0.0), threshold - F.greatest(f, 1 - f)) / threshold
    unsure = X.clamp(0.45 * ambiguity + 0.35 * conflict + 0.2 * gap)
    df = df.withColumn("_unsure", F.when((F.col("n_suspicious") >= 3) & (unsure < 0.32), 0.32).otherwise(unsure))
    u = F.col("_unsure")
    df = df.withColumns({"_r": (1 - f) * (1 - u), "_f": f * (1 - u)})
    total = F.col("_r") + F.col("_f") + u
    df = df.withColumns({"f_real": X.js_round(F.col("_r") / total, 4), "f_fake": X.js_round(F.col("_f") / total, 4), "f_uncertain": X.js_round(u / total, 4)})
    best = F.greatest("f_real", "f_fake", "f_uncertain")
    label = F.when(F.col("f_real") == best, "REAL").when(F.col("f_fake") == best, "FAKE").otherwise("UNCERTAIN")
    df = df.withColumns({"label": F.when(best < threshold, "UNCERTAIN").otherwise(label), "confidence": best, "credibility": X.js_round((1 - f) * 100)})
    return df.drop("_ml", "_fake", "_unsure", "_r", "_f")
