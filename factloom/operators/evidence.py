"""Claims, their matches in a trusted corpus, stances and verdicts.

Matching is an inverted-index join with a two-sided prefix filter.  A pair can
only reach the threshold if one of its three similarities (titles, claim and text,
keywords) reaches its own share of it (``FLOORS``).  Tokens are ordered by how rare
they are in the corpus; of each set only the rarest ones, as many as that floor
leaves, meet, on both sides, so frequent words make no pairs.  What meets must
also agree in size, and what follows the common token on either side must suffice.
Similarities are computed for what is left.  No cross join of claims and articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import lexicons as L
from factloom.functions import text as X

from .intelligence import Lexicon, keyword_array
from .ml import written

MATCH, PER_PROVIDER, PER_CLAIM, SURE = 0.16, 8, 5, 0.34
#: Weights of the similarities of titles, claim and text, and keywords.
WEIGHTS = {"t": 0.32, "c": 0.48, "k": 0.2}
#: Floors of the similarities: a pair under all three is under the threshold, as they sum to it by weight.
FLOORS = {"t": 0.16, "c": 0.2, "k": 0.0635}


def claim_points(sentence: Column, head_words: Column, lex: Lexicon) -> Column:
    """Hundredths."""
    said = lambda low: F.size(F.filter(head_words, lambda k: low.contains(k))) * 35 + X.patterns_present(low, lex.claim_verbs) * 25
    numbers = X.count_of(sentence, X.NUMBER)
    names = X.count_of(sentence, rf"(?=[A-Z]){X.LEFT}[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}{X.RIGHT}")
    return X.let(F.lower(sentence), said) + numbers * 20 + F.least(names, F.lit(3)) * 12 - F.when(F.length(sentence) > 260, 10).otherwise(0)


def main_claims(articles: DataFrame, key: str = "doc_id", most: int = 3, lex: Lexicon = L.ENGLISH) -> DataFrame:
    """key, claim_no, claim, title: the headline, then the best sentences, distinct, at most ``most``.

    Texts are read once; what is made of claims reads the written table.
    """
    a = articles.withColumn("_words", keyword_array(F.col("title"), 8))
    # a text's sentences are scored once and its best ones taken before rows are made of them; a filter on rows would score them twice
    fit = F.filter(F.transform("sents", lambda s, i: F.struct(i.alias("pos"), s.alias("sentence"))), lambda x: F.length(x["sentence"]).between(55, 260))
    scored = F.transform(fit, lambda x: F.struct((-claim_points(x["sentence"], F.col("_words"), lex)).alias("minus"), x["pos"].alias("pos"), x["sentence"].alias("sentence")))
    own = F.slice(F.sort_array(F.filter(scored, lambda x: x["minus"] < -35)), 1, most)
    each = a.select(key, "title", F.explode_outer(own).alias("x")).where("x IS NOT NULL").select(key, "title", (-F.col("x.minus")).alias("points"), "x.pos", "x.sentence")
    best = each.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.col("points").desc(), "pos"))).where(F.col("n") <= most)
    both = best.select(key, "title", "n", F.trim("sentence").alias("claim")).unionByName(a.select(key, "title", F.lit(0).alias("n"), F.trim("title").alias("claim")))
    first = both.where("claim <> ''").groupBy(key, "title", "claim").agg(F.min("n").alias("n"))
    return written(first.withColumn("claim_no", F.row_number().over(W.partitionBy(key).orderBy("n"))).where(F.col("claim_no") <= most).select(key, "claim_no", "claim", "title"), "claims")


def _indexed(df: DataFrame, ids: list[str], sets: dict[str, str]) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("set")) for k, c in sets.items()])
    return df.select(*ids, F.explode(kinds).alias("x")).select(*ids, "x.kind", F.explode("x.set").alias("token"))


def _ranked(df: DataFrame, ids: list[str], often: DataFrame) -> DataFrame:
    """With ``place`` (the rarest token of a set is 1; tokens that the corpus has not come first) and ``size`` of the set."""
    own = W.partitionBy(*ids, "kind")
    return df.join(often, ["kind", "token"], "left").withColumns({"place": F.row_number().over(own.orderBy(F.coalesce("df", F.lit(0)), "token")), "size": F.count(F.lit(1)).over(own)})


def candidate_pairs(left: DataFrame, right: DataFrame, key: str, floors: dict[str, float]) -> DataFrame:
    """key, claim_no, item_id of all pairs with a similarity at its floor: of (key, claim_no, kind, token) and (item_id, kind, token).

    Kinds t and c are measured by intersection over union, k by the claim's share.
    """
    often = right.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df"))
    floor = F.create_map(*[F.lit(v) for pair in floors.items() for v in pair])[F.col("kind")]
    least = F.greatest(F.ceil(F.col("size") * floor - 1e-9), F.lit(1))  # tokens that a set of this size has to share
    l = _ranked(left, [key, "claim_no"], often).where(F.col("df").isNotNull() & (F.col("place") <= F.col("size") - least + 1)).select(key, "claim_no", "kind", "token", F.struct("place", "size").alias("l"))
    # a keyword set is measured by the claim's, so any one of the article's may be the common one
    r = _ranked(right, ["item_id"], often).where((F.col("kind") == "k") | (F.col("place") <= F.col("size") - least + 1)).select("item_id", "kind", "token", F.struct("place", "size").alias("r"))
    met = l.join(r, ["kind", "token"])
    rest = 1 + F.least(F.col("l.size") - F.col("l.place"), F.col("r.size") - F.col("r.place"))
    need = F.when(F.col("kind") == "k", F.col("l.size") * floor).otherwise((F.col("l.size") + F.col("r.size")) * floor / (1 + floor))
    alike = (F.col("kind") == "k") | (F.least("l.size", "r.size") >= F.greatest("l.size", "r.size") * floor - 1e-9)
    return met.where(alike & (rest >= need - 1e-9)).select(key, "claim_no", "item_id").distinct()


def match_evidence(claims: DataFrame, corpus: DataFrame, key: str = "doc_id", threshold: float = MATCH, most: int = PER_PROVIDER, lex: Lexicon = L.ENGLISH, floors: dict[str, float] | None = None) -> DataFrame:
    """key, claim_no, item_id, title_similarity, claim_similarity, overlap, similarity, stance, rank.

    ``corpus``: item_id, title, text.  ``floors`` sum to the threshold by weight, at most.
    """
    floors = floors or {k: f * threshold / MATCH for k, f in FLOORS.items()}
    if sum(WEIGHTS[k] * f for k, f in floors.items()) > threshold:
        raise ValueError("floors that exceed the threshold by weight lose pairs")
    floors = {k: f * (1 - 0.00005 / threshold) for k, f in floors.items()}  # the threshold holds for the rounded similarity
    c = claims.withColumns(
        {"ct": X.similarity_tokens(F.col("title")), "cc": X.similarity_tokens(F.col("claim")), "ck": keyword_array(F.concat_ws(" ", "title", "claim"), 10), "query": F.lower(F.concat_ws(" ", "title", "claim"))}
    )
    t = corpus.withColumns(
        {
            "tt": X.similarity_tokens(F.col("title")),
            "tc": X.similarity_tokens(F.concat_ws(" ", F.col("title"), F.substring("text", 1, 900))),
            "tk": keyword_array(F.concat_ws(" ", "title", "text"), 12),
            "item_text": F.lower(F.concat_ws(" ", "title", "text")),
        }
    )
    c, t = written(c.drop("claim", "title"), "claim-sets"), written(t.drop("title", "text"), "item-sets")
    left = _indexed(c, [key, "claim_no"], {"t": "ct", "c": "cc", "k": "ck"})
    right = _indexed(t, ["item_id"], {"t": "tt", "c": "tc", "k": "tk"})
    met = candidate_pairs(left, right, key, floors)
    pair = met.join(c.select(key, "claim_no", "ct", "cc", "ck", "query"), [key, "claim_no"]).join(t.select("item_id", "tt", "tc", "tk", "item_text"), "item_id")
    pair = pair.withColumns({"title_similarity": X.jaccard(F.col("ct"), F.col("tt")), "claim_similarity": X.jaccard(F.col("cc"), F.col("tc")), "overlap": F.when(F.size("ck") > 0, F.size(F.array_intersect("ck", "tk")) / F.size("ck")).otherwise(0.0)})
    pair = pair.withColumn("similarity", X.js_round(F.col("title_similarity") * WEIGHTS["t"] + F.col("claim_similarity") * WEIGHTS["c"] + F.col("overlap") * WEIGHTS["k"], 4)).where(F.col("similarity") >= threshold)
    pair = pair.withColumn("stance", stance(lex))
    rank = F.row_number().over(W.partitionBy(key, "claim_no").orderBy(F.col("similarity").desc(), "item_id"))
    return written(pair.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "claim_no", "item_id", "title_similarity", "claim_similarity", "overlap", "similarity", "stance", "rank"), "matches")


def stance(lex: Lexicon) -> Column:
    """From phrases in query and item_text, and the similarities."""
    against_query = X.phrases_present(F.col("query"), lex.contradictions)
    against = X.phrases_present(F.col("item_text"), lex.contradictions)
    support = X.phrases_present(F.col("item_text"), lex.supports)
    strong = (F.col("claim_similarity") >= 0.38) | (F.col("title_similarity") >= 0.72)
    return (
        F.when((against > support) & (against_query == 0), "CONTRADICT")
        .when((against_query > 0) & (support > against), "CONTRADICT")
        .when(support > against, "SUPPORT")
        .when(strong & (against == 0), "SUPPORT")
        .otherwise("RELATED")
    )


def best_evidence(matches: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches distinct by source, title and stance, the best five of each claim, with item_source and item_title (lower case)."""
    source = F.lower(F.coalesce("source", F.lit(""))) if "source" in corpus.columns else F.lit("")
    named = matches.join(corpus.select("item_id", F.lower("title").alias("item_title"), source.alias("item_source")), "item_id")
    first = F.row_number().over(W.partitionBy(key, "claim_no", "item_source", "item_title", "stance").orderBy("rank"))
    place = F.row_number().over(W.partitionBy(key, "claim_no").orderBy("rank"))
    return named.withColumn("_f", first).where("_f = 1").withColumn("_p", place).where(F.col("_p") <= PER_CLAIM).drop("_f", "_p")


def claim_verdicts(claims: DataFrame, matches: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, claim_no, counts by stance, mean similarity, confidence, verdict; of the best evidence."""
    kept = best_evidence(matches, corpus, key)
    per = kept.groupBy(key, "claim_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("stance") == "SUPPORT").alias("n_support"),
        F.count_if(F.col("stance") == "CONTRADICT").alias("n_contradict"),
        F.count_if(F.col("stance") == "RELATED").alias("n_related"),
        F.sum(F.floor(F.col("similarity") * 10000 + 0.5)).alias("_sum"),
    )
    out = claims.select(key, "claim_no").join(per, [key, "claim_no"], "left").na.fill(0)
    n = F.greatest("n", F.lit(1))
    mean = F.col("_sum") / n / 10000
    dominant = F.greatest("n_support", "n_contradict", "n_related") / n
    out = out.withColumns({"mean_similarity": X.js_round(mean, 4), "confidence": F.when(F.col("n") == 0, 0.0).otherwise(X.js_round(0.65 * mean + 0.2 * F.least(F.col("n") / 4, F.lit(1.0)) + 0.15 * dominant, 4))})
    sure = F.col("confidence") >= SURE
    verdict = F.when((F.col("n") > 0) & (F.col("n_contradict") > F.col("n_support")) & sure, "CONTRADICTED").when((F.col("n") > 0) & (F.col("n_support") > F.col("n_contradict")) & sure, "SUPPORTED").otherwise("UNVERIFIED")
    return out.withColumn("verdict", verdict).drop("_sum")


def roll_up(verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each article: counts, overall verdict, evidence credibility."""
    s, c, r = F.sum("n_support"), F.sum("n_contradict"), F.sum("n_related")
    per = verdicts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.count_if(F.col("verdict") == "SUPPORTED").alias("n_supported"),
        F.count_if(F.col("verdict") == "CONTRADICTED").alias("n_contradicted"),
        F.sum("n").alias("n_evidence"),
        F.when(s + c + r > 0, X.js_round(100 * (s + r / 2) / (s + c + r / 2))).otherwise(50).alias("evidence_credibility"),
        F.sum(F.floor(F.col("confidence") * 10000 + 0.5)).alias("_conf"),
    )
    overall = (
        F.when(F.col("n_contradicted") > F.col("n_supported"), "CONTRADICTS")
        .when(F.col("n_supported") > F.col("n_contradicted"), "SUPPORTS")
        .when(F.col("n_supported") > 0, "MIXED")
        .otherwise("UNVERIFIED")
    )
    return per.withColumns({"overall": overall, "evidence_confidence": X.js_round(F.col("_conf") / F.col("n_claims") / 10000, 4)}).drop("_conf")


def adjusted_credibility(base: Column, evidence: Column, confidence: Column, n_evidence: Column) -> Column:
    weight = X.js_round(0.18 + 0.32 * confidence, 3)
    return F.when(n_evidence > 0, X.js_round(base * (1 - weight) + evidence * weight)).otherwise(base)


def best_snippet(claims: Column, text: Column) -> Column:
    """Of the first twelve sentences of 45 characters and more, the one most like a claim."""
    fit = F.slice(F.filter(X.sentences(text), lambda s: F.length(s) >= 45), 1, 12)
    like = lambda s: F.array_max(F.transform(claims, lambda c: X.jaccard(X.similarity_tokens(c), X.similarity_tokens(s))))
    scored = F.transform(fit, lambda s, i: F.struct(F.coalesce(like(s), F.lit(0.0)).alias("v"), (-i).alias("i"), s.alias("s")))
    return F.when(F.size(fit) == 0, F.substring(X.collapse(text), 1, 220)).otherwise(F.array_max(scored)["s"])
