"""Queries over documents as articles: text intelligence, scoring, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import labels as B
from factloom.functions import lexicons as L
from factloom.functions import text as X
from factloom.operators import intelligence as I
from factloom.operators import reputation as R
from factloom.operators import trust as T

from . import sqltext as S

LEX = L.CORPUS
#: The registry of the driver's invented sources.
SOURCES = [
    ("src1.example", ["src11.example"], "Trusted", 90, "Center", "Nowhere", "High"),
    ("src2.example", ["src12.example"], "", 60, "Center", "Nowhere", "Mixed"),
    ("src3.example", [], "Suspicious", 12, "Unknown", "Nowhere", "Low"),
    ("src13.example", ["src1.example"], "Suspicious", 10, "Unknown", "Nowhere", "Low"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return I.prepare(docs.withColumn("title", X.headline(F.col("text"))))


# ---------------------------------------------------------------- statistics


def token_stats(spark, sf_dir):
    a = articles(spark, sf_dir)
    n = F.size("tokens")
    return a.select(
        "doc_id",
        n.alias("n_tokens"),
        F.size(F.array_distinct("tokens")).alias("n_distinct"),
        F.size("sents").alias("n_sentences"),
        X.paragraphs(F.col("text")).alias("n_paragraphs"),
        F.length("text").alias("n_chars"),
        F.greatest(F.lit(1), X.js_round(n / 220)).alias("reading_minutes"),
        "title",
    )


TOKEN_STATS = f"""WITH {S.ARTICLES}
SELECT doc_id, len(tokens)::INTEGER AS n_tokens, len(list_distinct(tokens))::INTEGER AS n_distinct, len(sents)::INTEGER AS n_sentences,
       greatest(len(list_filter(regexp_split_to_array(text, '\\r?\\n\\s*\\r?\\n'), lambda p: trim(p) <> '')), 1)::INTEGER AS n_paragraphs,
       length(text)::INTEGER AS n_chars, greatest(1, {S.whole('len(tokens) / 220.0::DOUBLE')}) AS reading_minutes, title
FROM articles"""

_COUNTS = f"""counts AS (
  SELECT *, list_filter(tokens, lambda w: regexp_matches(w, '[a-zA-Z]')) AS alpha FROM articles),
sums AS (
  SELECT *, len(alpha) AS words_alpha, coalesce(list_sum(list_transform(alpha, lambda w: {S.syllables('w')})), 0)::BIGINT AS n_syllables,
         coalesce(list_sum(list_transform(alpha, lambda w: length(w))), 0)::BIGINT AS n_letters,
         len(list_distinct(alpha)) AS n_distinct, len(sents) AS n_sentences FROM counts)"""


def _readability(prefix: str) -> str:
    asl, asw = f"({prefix}words / {prefix}sents)", f"({prefix}syl / {prefix}words)"
    ease = f"(206.835::DOUBLE - 1.015::DOUBLE * {asl} - 84.6::DOUBLE * {asw})"
    return f"""{S.whole(ease)} AS flesch, {S.round_(f'0.39::DOUBLE * {asl} + 11.8::DOUBLE * {asw} - 15.59::DOUBLE', 1)} AS grade,
       CASE WHEN {ease} < 30 THEN 'Expert' WHEN {ease} < 50 THEN 'Advanced' WHEN {ease} >= 70 THEN 'Easy' ELSE 'Standard' END AS level,
       {S.round_(asl, 1)} AS sentence_length"""


def readability_docs(spark, sf_dir):
    return I.readability(I.readability_counts(articles(spark, sf_dir))).select("doc_id", "flesch", "grade", "level", "sentence_length", "word_length", "diversity", "syllables_per_word", "reading_minutes")


READABILITY_DOCS = f"""WITH {S.ARTICLES}, {_COUNTS},
r AS (SELECT *, greatest(words_alpha, 1)::DOUBLE AS words, greatest(n_sentences, 1)::DOUBLE AS sents1, n_syllables::DOUBLE AS syl FROM sums)
SELECT doc_id, {_readability('').replace('sents', 'sents1')}, {S.round_('n_letters / words', 1)} AS word_length, {S.round_('n_distinct / words', 3)} AS diversity,
       {S.round_('syl / words', 2)} AS syllables_per_word, greatest(1, {S.whole('words / 220')}) AS reading_minutes
FROM r"""


def readability_by_lang(spark, sf_dir):
    counts = I.readability_counts(articles(spark, sf_dir))
    per = counts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("words_alpha").alias("words_alpha"),
        F.sum("n_syllables").alias("n_syllables"),
        F.sum("n_sentences").alias("n_sentences"),
        F.sum("n_letters").alias("n_letters"),
        F.sum("n_distinct").alias("n_distinct"),
    )
    return I.readability(per).select("lang", "n_docs", "words_alpha", "n_syllables", "n_sentences", "flesch", "grade", "level", "sentence_length")


READABILITY_BY_LANG = f"""WITH {S.ARTICLES}, {_COUNTS},
per AS (SELECT lang, count(*) AS n_docs, sum(words_alpha)::BIGINT AS words_alpha, sum(n_syllables)::BIGINT AS n_syllables, sum(n_sentences)::BIGINT AS n_sentences FROM sums GROUP BY lang),
r AS (SELECT *, greatest(words_alpha, 1)::DOUBLE AS words, greatest(n_sentences, 1)::DOUBLE AS sents, n_syllables::DOUBLE AS syl FROM per)
SELECT lang, n_docs, words_alpha, n_syllables, n_sentences, {_readability('')} FROM r"""


# ---------------------------------------------------------------- lexicons


def sentiment_score(spark, sf_dir):
    return I.sentiment(articles(spark, sf_dir), LEX).select("doc_id", "n_positive", "n_negative", "n_emotional", "sentiment", "sentiment_score", "emotional_intensity")


_SENT_SCORE = S.clamp("(n_positive - n_negative) / greatest(len(tokens) / 12.0::DOUBLE, 1.0::DOUBLE)", "-1.0")
_SENTIMENT = f"""feel AS (
  SELECT *, {S.hits('tokens', LEX.positive)}::INTEGER AS n_positive, {S.hits('tokens', LEX.negative)}::INTEGER AS n_negative, {S.hits('tokens', LEX.emotional)}::INTEGER AS n_emotional FROM articles),
felt AS MATERIALIZED (
  SELECT *, CASE WHEN {_SENT_SCORE} > 0.12 THEN 'positive' WHEN {_SENT_SCORE} < -0.12 THEN 'negative' ELSE 'neutral' END AS sentiment,
         {S.round_(_SENT_SCORE, 3)} AS sentiment_score,
         {S.round_(S.clamp('n_emotional / greatest(len(tokens) / 14.0::DOUBLE, 1.0::DOUBLE)'), 3)} AS emotional_intensity FROM feel)"""
SENTIMENT_SCORE = f"WITH {S.ARTICLES}, {_SENTIMENT} SELECT doc_id, n_positive, n_negative, n_emotional, sentiment, sentiment_score, emotional_intensity FROM felt"


def lexicon_hits(spark, sf_dir):
    """Real lexicons over conversations and the corpus lexicon by language."""
    a = I.sentiment(articles(spark, sf_dir), LEX)
    return a.groupBy("lang", "sentiment").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_positive").alias("n_positive"), F.sum("n_negative").alias("n_negative"))


LEXICON_HITS = f"WITH {S.ARTICLES}, {_SENTIMENT} SELECT lang, sentiment, count(*) AS n_docs, sum(n_positive)::BIGINT AS n_positive, sum(n_negative)::BIGINT AS n_negative FROM felt GROUP BY ALL"


def language_detect(spark, sf_dir):
    return I.language(articles(spark, sf_dir)).select("doc_id", "lang", "language", "language_confidence")


def _lang_scores() -> str:
    out = []
    for i, (code, markers) in enumerate(L.LANGUAGES):
        extra = "" if i == 0 else f" + 18 * len(list_filter(first, lambda w: regexp_matches(w, '(?i)[{L.ACCENTED}]')))"
        out.append(f"{{'score': ({S.hits('first', markers)} * 100{extra})::BIGINT, 'place': {-i}, 'code': '{code}'}}")
    return "[" + ", ".join(out) + "]"


_LANGUAGE = f"""firsts AS (SELECT *, tokens[1:280] AS first FROM articles),
ls AS (SELECT *, {_lang_scores()} AS scores FROM firsts),
lt AS (SELECT *, list_max(scores) AS top, list_sum(list_transform(scores, lambda s: s.score)) AS total FROM ls),
lang_of AS (
  SELECT doc_id, lang, CASE WHEN len(first) = 0 OR top.score < 200 THEN 'unknown' ELSE top.code END AS language,
         CASE WHEN len(first) = 0 THEN 0.0::DOUBLE WHEN top.score < 200 THEN 0.2::DOUBLE
              ELSE {S.round_('top.score / greatest(total, top.score, 1)::DOUBLE', 3)} END AS language_confidence FROM lt)"""
LANGUAGE_DETECT = f"WITH {S.ARTICLES}, {_LANGUAGE} SELECT * FROM lang_of"


def language_confusion(spark, sf_dir):
    return I.language(articles(spark, sf_dir)).groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


LANGUAGE_CONFUSION = f"WITH {S.ARTICLES}, {_LANGUAGE} SELECT lang, language, count(*) AS n FROM lang_of GROUP BY ALL"


def emotion_profile(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("tokens", X.tokens(F.col("text")))
    return I.emotions(turns, LEX).select("conv_id", "turn", "emotion", "second_emotion", "emotion_score")


EMOTION_PROFILE = f"""
WITH t AS (SELECT conv_id, turn, {S.tokens('text')} AS tokens FROM conversations),
c AS (SELECT *, list_sort([{', '.join(f"{{'count': {S.hits('tokens', words)}::INTEGER, 'place': {-i}, 'emotion': '{k}'}}" for i, (k, words) in enumerate(LEX.emotions))}], 'DESC') AS ranked FROM t)
SELECT conv_id, turn, CASE WHEN ranked[1].count = 0 THEN 'neutral' ELSE ranked[1].emotion END AS emotion,
       CASE WHEN ranked[1].count > 0 AND ranked[2].count > 0 THEN ranked[2].emotion END AS second_emotion,
       CASE WHEN ranked[1].count = 0 THEN 0.12::DOUBLE ELSE {S.round_(S.clamp('ranked[1].count / greatest(len(tokens) / 22.0::DOUBLE, 1.0::DOUBLE)'), 3)} END AS emotion_score
FROM c"""


# ---------------------------------------------------------------- keywords


def top_keywords_per_doc(spark, sf_dir):
    return I.keywords(read(spark, sf_dir, "documents")).select("doc_id", "term", "n", "rank")


_KEYWORDS = f"""kw AS (
  SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {S.keyword_words('text')} AS ws FROM documents)),
kc AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM kw WHERE term <> '' GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos)::INTEGER AS rank FROM kc)"""
TOP_KEYWORDS = f"WITH {_KEYWORDS} SELECT doc_id, term, n, rank FROM kr WHERE rank <= 8"


def key_phrases(spark, sf_dir):
    return I.key_phrases(articles(spark, sf_dir))


_PHRASES = f"""grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(tokens)), lambda i: [tokens[i], tokens[i + 1], tokens[i + 2]])) AS g FROM articles),
fit AS (SELECT doc_id, g[1] AS a, g[2] AS b, g[3] AS c FROM grams WHERE length(g[1]) >= 4 AND length(g[2]) >= 4
        AND g[1] NOT IN {S.members(L.CONTENT_STOP_WORDS)} AND g[2] NOT IN {S.members(L.CONTENT_STOP_WORDS)}),
terms AS (
  SELECT doc_id, a || ' ' || b AS term, 100 AS w FROM fit
  UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c, 125 FROM fit WHERE c IS NOT NULL AND length(c) >= 4 AND c NOT IN {S.members(L.CONTENT_STOP_WORDS)}),
ps AS (SELECT doc_id, term, sum(w) / 100.0::DOUBLE AS score FROM terms GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)::INTEGER AS rank FROM ps)"""
KEY_PHRASES = f"WITH {S.ARTICLES}, {_PHRASES} SELECT doc_id, term, score, rank FROM pr WHERE rank <= 8"


def keyword_metadata(spark, sf_dir):
    return I.keyword_metadata(articles(spark, sf_dir))


KEYWORD_METADATA = f"""WITH {S.ARTICLES}, {_KEYWORDS}, {_PHRASES},
merged AS (
  SELECT doc_id, term, 'phrase' AS origin, {S.round_('score * 18', 2)} AS score, rank AS place, 1 AS tier FROM pr WHERE rank <= 8
  UNION ALL SELECT doc_id, term, 'frequency', {S.round_('36 - (rank - 1) * 2.2::DOUBLE', 2)}, rank, 2 FROM kr WHERE rank <= 12),
firsts AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY tier, place) = 1)
SELECT doc_id, term, origin, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tier, place)::INTEGER AS rank FROM firsts QUALIFY rank <= 12"""


def topic_scores(spark, sf_dir):
    return I.topics(articles(spark, sf_dir), LEX).select("doc_id", "topic", "category", "topic_score", "topic_confidence", F.array_join(F.transform("topics", lambda t: t["topic"]), "|").alias("topics"))


def _topics() -> str:
    out = []
    for i, (name, category, words) in enumerate(LEX.topics):
        score = " + ".join(f"{S.occurrences('head', w)} * 280 + least({S.occurrences('body', w)}, 6) * 75" for w in words)
        out.append(f"{{'score': ({score})::BIGINT, 'place': {-i}, 'topic': '{name}', 'category': '{category}'}}")
    return "[" + ", ".join(out) + "]"


TOPIC_SCORES = f"""WITH {S.ARTICLES},
b AS (SELECT doc_id, lower(title) AS head, lower(concat_ws(' ', title, text)) AS body FROM articles),
s AS (SELECT doc_id, list_sort(list_filter({_topics()}, lambda t: t.score > 0), 'DESC') AS topics FROM b)
SELECT doc_id, coalesce(topics[1].topic, 'general') AS topic, coalesce(topics[1].category, 'General') AS category, coalesce(topics[1].score / 100.0::DOUBLE, 0.0::DOUBLE) AS topic_score,
       coalesce({S.round_('topics[1].score / greatest(list_sum(list_transform(topics, lambda t: t.score)), 1)::DOUBLE', 3)}, 0.35::DOUBLE) AS topic_confidence,
       coalesce(list_aggregate(list_transform(topics, lambda t: t.topic), 'string_agg', '|'), '') AS topics
FROM s"""


# ---------------------------------------------------------------- entities

_ORGS = "|".join(L.ORG_SUFFIXES)
_CAP = "[A-Z][a-z]+"


def entities(spark, sf_dir):
    e = I.entities(articles(spark, sf_dir))
    return e.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("organizations", "people", "locations", "dates")])


# RE2's longest run of capitalised words after a boundary, as in the expressions
_ENTITIES = f"""found AS (
  SELECT doc_id,
    list_distinct_in_order(regexp_extract_all(text, '\\b({_CAP}(?:\\s+{_CAP}){{0,4}}\\s+(?:{_ORGS}))\\b', 1))[1:10] AS organizations,
    list_distinct_in_order(regexp_extract_all(text, '\\b({_CAP}(?:\\s+{_CAP}){{1,2}})\\b', 1)) AS people0,
    list_distinct_in_order(regexp_extract_all(text, '\\b(?:in|at|from|to|near)\\s+({_CAP}(?:\\s+{_CAP}){{0,2}})\\b', 1)) AS places0,
    list_distinct_in_order(list_concat(list_concat(regexp_extract_all(text, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1),
      regexp_extract_all(text, '\\b((?:{'|'.join(L.MONTHS)})\\s+\\d{{1,2}},\\s+\\d{{4}})\\b', 1)), regexp_extract_all(text, '\\b(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})\\b', 1)))[1:8] AS dates
  FROM articles),
persons AS (
  SELECT *, list_filter(people0, lambda p: NOT list_contains(organizations, p) AND string_split(p, ' ')[1] NOT IN {S.members(L.MONTHS)} AND NOT regexp_matches(p, '(?:{_ORGS})$'))[1:12] AS people FROM found),
ents AS (SELECT doc_id, organizations, people, list_filter(places0, lambda p: NOT list_contains(people, p) AND NOT list_contains(organizations, p))[1:10] AS locations, dates FROM persons)"""


def _in_order(sql: str) -> str:
    """list_distinct keeps no order in DuckDB; keep each element's first place instead."""
    out, at = "", 0
    while (i := sql.find("list_distinct_in_order(", at)) >= 0:
        out += sql[at:i]
        j, depth = i + len("list_distinct_in_order("), 1
        k = j
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0) if not _quoted(sql, k) else 0
            k += 1
        inner = sql[j : k - 1]
        out += f"list_filter({inner}, lambda x, i: list_position({inner}, x) = i)"
        at = k
    return out + sql[at:]


def _quoted(sql: str, k: int) -> bool:
    return sql[:k].count("'") % 2 == 1


_ENTITIES = _in_order(_ENTITIES)
ENTITIES = f"""WITH {S.ARTICLES}, {_ENTITIES}
SELECT doc_id, array_to_string(organizations, '|') AS organizations, array_to_string(people, '|') AS people, array_to_string(locations, '|') AS locations, array_to_string(dates, '|') AS dates FROM ents"""


def top_entities(spark, sf_dir):
    """Entities over all documents: category and lower-case name, display form first seen, top 10."""
    e = I.entities(articles(spark, sf_dir))
    each = e.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("names")) for c in ("people", "organizations", "locations", "dates")])).alias("x"))
    names = each.select("doc_id", "x.category", F.posexplode("x.names").alias("pos", "name"))
    per = names.groupBy("category", F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min_by("name", F.struct("doc_id", "pos")).alias("entity"))
    return per.orderBy(F.col("n").desc(), "entity", "category").limit(10).select("category", "entity", "n")


TOP_ENTITIES = f"""WITH {S.ARTICLES}, {_ENTITIES},
cats AS (
  SELECT doc_id, 'people' AS category, unnest(people) AS name, generate_subscripts(people, 1) AS pos FROM ents
  UNION ALL SELECT doc_id, 'organizations', unnest(organizations), generate_subscripts(organizations, 1) FROM ents
  UNION ALL SELECT doc_id, 'locations', unnest(locations), generate_subscripts(locations, 1) FROM ents
  UNION ALL SELECT doc_id, 'dates', unnest(dates), generate_subscripts(dates, 1) FROM ents)
SELECT category, arg_min(name, {{'d': doc_id, 'p': pos}}) AS entity, count(*) AS n FROM cats GROUP BY category, lower(name) ORDER BY n DESC, entity, category LIMIT 10"""


# ---------------------------------------------------------------- suspicion, rules, fusion, trust


def suspicious_sentences(spark, sf_dir):
    return I.suspicious_sentences(articles(spark, sf_dir), lex=LEX).select("doc_id", "pos", "score", "rank")


def _suspicion(s: str) -> str:
    low = f"lower({s})"
    return f"""least(CASE WHEN {S.present(low, LEX.sensational)} > 0 THEN 45 ELSE 0 END + CASE WHEN {S.present(low, LEX.emotional)} > 0 THEN 30 ELSE 0 END
      + CASE WHEN regexp_matches({s}, '[!?]{{2,}}') THEN 20 ELSE 0 END + CASE WHEN {S.uppercase_ratio(s)} > 0.24 THEN 18 ELSE 0 END
      + CASE WHEN {S.present(low, LEX.unsupported)} > 0 THEN 40 ELSE 0 END, 100) / 100.0::DOUBLE"""


_SUSPICIOUS = f"""each_sent AS (SELECT doc_id, unnest(sents) AS s, generate_subscripts(sents, 1) - 1 AS pos FROM articles),
scored_sent AS (SELECT doc_id, pos, {_suspicion('s')} AS score FROM each_sent),
top_sent AS (SELECT doc_id, pos::INTEGER AS pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos)::INTEGER AS rank FROM scored_sent WHERE score >= 0.35 QUALIFY rank <= 5),
n_sus AS (SELECT a.doc_id, count(t.doc_id) AS n_suspicious FROM articles a LEFT JOIN top_sent t ON a.doc_id = t.doc_id GROUP BY a.doc_id)"""
SUSPICIOUS = f"WITH {S.ARTICLES}, {_SUSPICIOUS} SELECT * FROM top_sent"


def _sourced(spark, sf_dir) -> DataFrame:
    a = articles(spark, sf_dir).withColumns({"host": F.concat("source", F.lit(".example")), "author": F.when(F.col("doc_id") % 3 == 0, "A. Writer"), "published": F.when(F.col("doc_id") % 2 == 0, "2024-01-01")})
    return R.with_reputation(a, "host", R.registry(spark, SOURCES))


def _ruled(spark, sf_dir) -> DataFrame:
    return I.rules(I.count_suspicious(I.sentiment(_sourced(spark, sf_dir), LEX), LEX), LEX)


_names = [(n, i, b or ("Trusted" if t >= 80 else "Medium" if t >= 55 else "Suspicious"), t) for i, (d, al, b, t, *_) in enumerate(SOURCES) for n in (d, *al)]
_REG = f"""reg(name, place, badge, trust) AS (VALUES {', '.join(f"('{n}', {i}, '{b}', {t})" for n, i, b, t in _names)}),
best AS (SELECT a.doc_id, arg_min(badge, place) AS badge, arg_min(trust, place) AS trust FROM articles a JOIN reg ON (a.source || '.example' = name OR ends_with(a.source || '.example', '.' || name)) GROUP BY a.doc_id),
sourced AS (SELECT f.*, source || '.example' AS host, badge, trust, n_suspicious, f.doc_id % 3 = 0 AS has_author, f.doc_id % 2 = 0 AS has_date
            FROM felt f LEFT JOIN best USING (doc_id) JOIN n_sus USING (doc_id))"""
_dens = f"(({S.count_of('text', '[!?]')} + 2 * {S.count_of('text', '[!?]{2,}')}) / greatest(len(tokens), 1)::DOUBLE)"
_emo, _sens = S.present("lower_text", LEX.emotional), S.present("lower_text", LEX.sensational)
_odd = f"(coalesce(badge, '') <> 'Trusted' AND (regexp_matches(host, '(?i)\\b(?:{'|'.join(L.SUSPICIOUS_HOST_WORDS)})\\b') OR regexp_matches(host, '(?i)\\.({'|'.join(L.SUSPICIOUS_TLDS)})$')))"
_RULES = f"""ruled0 AS MATERIALIZED (SELECT *,
  least(1.0::DOUBLE, {S.present('lower(trim(title))', LEX.clickbait)} / 2.0::DOUBLE) AS r_clickbait_title,
  CASE WHEN {S.uppercase_ratio('text')} >= 0.28 THEN 1.0::DOUBLE WHEN {S.uppercase_ratio('text')} >= 0.18 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS r_excessive_capitalization,
  CASE WHEN {_dens} >= 0.14 THEN 1.0::DOUBLE WHEN {_dens} >= 0.08 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS r_excessive_punctuation,
  CASE WHEN {_emo} >= 6 THEN 1.0::DOUBLE WHEN {_emo} >= 3 THEN 0.55::DOUBLE WHEN {_emo} > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS r_emotional_language,
  CASE WHEN {_sens} >= 4 THEN 1.0::DOUBLE WHEN {_sens} >= 2 THEN 0.65::DOUBLE WHEN {_sens} > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS r_sensational_phrases,
  CASE WHEN badge = 'Suspicious' THEN 0.98::DOUBLE WHEN {_odd} THEN 0.92::DOUBLE WHEN badge = 'Medium' THEN 0.35::DOUBLE WHEN coalesce(badge, '') <> 'Trusted' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS r_suspicious_domain,
  CASE WHEN len(tokens) < 120 THEN 0.95::DOUBLE WHEN len(tokens) < 220 THEN 0.55::DOUBLE WHEN len(tokens) > 2600 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS r_article_length,
  CASE WHEN has_author THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS r_missing_author,
  CASE WHEN has_date THEN 0.0::DOUBLE ELSE 0.65::DOUBLE END AS r_missing_publication_date FROM sourced),
ruled AS MATERIALIZED (SELECT *, {S.round_('(' + ' + '.join(f'r_{k} * {w}::DOUBLE' for k, w in L.RULE_WEIGHTS.items()) + f') / {sum(L.RULE_WEIGHTS.values())!r}::DOUBLE', 4)} AS rule_risk FROM ruled0)"""
_UPTO_RULES = f"WITH {S.ARTICLES}, {_SENTIMENT}, {_SUSPICIOUS}, {_REG}, {_RULES}"


def rule_risk(spark, sf_dir):
    return _ruled(spark, sf_dir).select("doc_id", *[f"r_{k}" for k in L.RULE_WEIGHTS], "rule_risk", "n_suspicious")


RULE_RISK = f"{_UPTO_RULES} SELECT doc_id, {', '.join(f'r_{k}' for k in L.RULE_WEIGHTS)}, rule_risk, n_suspicious::INTEGER AS n_suspicious FROM ruled"


def heuristic_predict(spark, sf_dir):
    h = I.heuristic(_sourced(spark, sf_dir), lex=LEX)
    return h.select("doc_id", "margin", "h_label", "h_score", "p_real", "p_fake", "p_uncertain")


_comb = "lower(concat_ws(' ', title, text))"
_HEUR = f"""heur0 AS MATERIALIZED (SELECT *, {S.present(_comb, LEX.real)} + CASE WHEN badge = 'Trusted' THEN 2 ELSE 0 END - {S.present(_comb, LEX.fake)} AS margin,
  len(list_filter(string_split({S.collapse(_comb)}, ' '), lambda w: w <> '')) AS nw FROM ruled),
heur1 AS (SELECT *, nw >= 45 AND abs(margin) >= 2 AS decided, CASE WHEN nw >= 45 AND abs(margin) >= 2 THEN least(0.89::DOUBLE, (60 + abs(margin) * 8) / 100.0::DOUBLE) ELSE 0.55::DOUBLE END AS h_score FROM heur0),
heur2 AS (SELECT *, CASE WHEN NOT decided OR h_score < 0.72 THEN 'UNCERTAIN' WHEN margin > 0 THEN 'REAL' ELSE 'FAKE' END AS h_label FROM heur1),
heur AS (SELECT *, CASE h_label WHEN 'REAL' THEN h_score WHEN 'FAKE' THEN {S.round_('1 - h_score', 4)} ELSE 0.4::DOUBLE END AS p_real,
  CASE h_label WHEN 'FAKE' THEN h_score WHEN 'REAL' THEN {S.round_('1 - h_score', 4)} ELSE 0.4::DOUBLE END AS p_fake,
  CASE h_label WHEN 'UNCERTAIN' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS p_uncertain FROM heur2)"""
HEURISTIC = f"{_UPTO_RULES}, {_HEUR} SELECT doc_id, margin, h_label, h_score, p_real, p_fake, p_uncertain FROM heur"


def fuse_probabilities(spark, sf_dir):
    f = I.fuse(I.heuristic(_ruled(spark, sf_dir), lex=LEX))
    return f.select("doc_id", "f_real", "f_fake", "f_uncertain", "label", "confidence", "credibility", B.risk_level(F.col("label"), F.col("confidence")).alias("risk"))


_w = 0.68 / (0.68 + 0.32)
_uns = S.clamp("0.45::DOUBLE * (1 - abs(2 * fk - 1)) + 0.35::DOUBLE * abs(ml - rule_risk) + 0.2::DOUBLE * (greatest(0.0::DOUBLE, 0.72::DOUBLE - greatest(fk, 1 - fk)) / 0.72::DOUBLE)")
_FUSE = f"""fu0 AS MATERIALIZED (SELECT *, CASE WHEN p_fake + p_real > 0 THEN p_fake / (p_fake + p_real) ELSE 0.5::DOUBLE END AS ml FROM heur),
fu1 AS MATERIALIZED (SELECT *, {S.clamp(f'ml * {_w!r}::DOUBLE + rule_risk * {1 - _w!r}::DOUBLE')} AS fk FROM fu0),
fu2 AS MATERIALIZED (SELECT *, CASE WHEN n_suspicious >= 3 AND {_uns} < 0.32 THEN 0.32::DOUBLE ELSE {_uns} END AS un FROM fu1),
fu3 AS MATERIALIZED (SELECT *, (1 - fk) * (1 - un) AS rr, fk * (1 - un) AS ff FROM fu2),
fu4 AS MATERIALIZED (SELECT *, {S.round_('rr / (rr + ff + un)', 4)} AS f_real, {S.round_('ff / (rr + ff + un)', 4)} AS f_fake, {S.round_('un / (rr + ff + un)', 4)} AS f_uncertain, {S.whole('(1 - fk) * 100')} AS credibility FROM fu3),
fused AS (SELECT *, greatest(f_real, f_fake, f_uncertain) AS confidence,
  CASE WHEN greatest(f_real, f_fake, f_uncertain) < 0.72 THEN 'UNCERTAIN' WHEN f_real = greatest(f_real, f_fake, f_uncertain) THEN 'REAL' WHEN f_fake = greatest(f_real, f_fake, f_uncertain) THEN 'FAKE' ELSE 'UNCERTAIN' END AS label FROM fu4)"""
FUSE = f"""{_UPTO_RULES}, {_HEUR}, {_FUSE}
SELECT doc_id, f_real, f_fake, f_uncertain, label, confidence, credibility,
  CASE label WHEN 'FAKE' THEN CASE WHEN confidence >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'REAL' THEN CASE WHEN confidence >= 0.8 THEN 'LOW' ELSE 'MEDIUM' END ELSE CASE WHEN confidence < 0.55 THEN 'HIGH' ELSE 'MEDIUM' END END AS risk
FROM fused"""


def final_label(spark, sf_dir):
    f = I.fuse(I.heuristic(_ruled(spark, sf_dir), lex=LEX))
    return f.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("credibility").alias("credibility_sum"))


FINAL_LABEL = f"{_UPTO_RULES}, {_HEUR}, {_FUSE} SELECT lang, label, count(*) AS n, sum(credibility)::BIGINT AS credibility_sum FROM fused GROUP BY ALL"


def writing_style(spark, sf_dir):
    a = I.readability(I.readability_counts(_ruled(spark, sf_dir)))
    return I.writing_style(a, LEX).select("doc_id", "style", "style_share")


def _occ(words) -> str:
    return "(" + " + ".join(S.occurrences("lower_text", w) for w in words) + ")"


_STYLE = f"""st0 AS (SELECT u.*, {_occ(LEX.opinionated)} AS opinion, {_occ(LEX.analytical)} AS analysis, {_occ(LEX.conversational)} AS talk,
  {S.occurrences('lower_text', 'i|we|our|my|us')} AS person, {S.count_of('text', '[?]')} AS asks, {S.count_of('text', '"')} // 2 AS quotes,
  {S.count_of('text', '\\b\\d+(?:\\.\\d+)?\\b')} AS numbers, r_clickbait_title + r_excessive_punctuation + r_emotional_language + r_sensational_phrases AS loud,
  {S.present('lower(title)', LEX.clickbait)} AS baits, {S.round_('greatest(len(list_filter(u.tokens, lambda w: regexp_matches(w, \'[a-zA-Z]\'))), 1)::DOUBLE / greatest(len(u.sents), 1)::DOUBLE', 1)} AS sentence_length FROM ruled u),
st1 AS (SELECT doc_id, [
  {{'value': {S.round_("quotes * 0.18::DOUBLE + analysis * 0.12::DOUBLE + numbers * 0.06::DOUBLE + CASE WHEN sentiment = 'neutral' THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n_suspicious > 0 THEN 0.0::DOUBLE ELSE 0.12::DOUBLE END", 6)}, 'place': 0, 'style': 'Straight News'}},
  {{'value': {S.round_('analysis * 0.18::DOUBLE + numbers * 0.08::DOUBLE + sentence_length / 90 + quotes * 0.04::DOUBLE', 6)}, 'place': -1, 'style': 'Analytical'}},
  {{'value': {S.round_('opinion * 0.18::DOUBLE + person * 0.1::DOUBLE + abs(sentiment_score) * 0.5::DOUBLE', 6)}, 'place': -2, 'style': 'Opinionated'}},
  {{'value': {S.round_('talk * 0.16::DOUBLE + asks * 0.18::DOUBLE + person * 0.08::DOUBLE', 6)}, 'place': -3, 'style': 'Conversational'}},
  {{'value': {S.round_('loud * 0.55::DOUBLE + n_suspicious * 0.18::DOUBLE + baits * 0.3::DOUBLE', 6)}, 'place': -4, 'style': 'Sensational'}}] AS v FROM st0)"""
_total = "(v[1].value + v[2].value + v[3].value + v[4].value + v[5].value)"
WRITING_STYLE = f"""{_UPTO_RULES}, {_STYLE}
SELECT doc_id, list_max(v).style AS style, {S.round_(f'list_max(v).value / CASE WHEN {_total} = 0 THEN 1.0::DOUBLE ELSE {_total} END', 3)} AS style_share FROM st1"""


def _trusted(spark, sf_dir) -> DataFrame:
    a = I.heuristic(_ruled(spark, sf_dir), lex=LEX).withColumns({"n_claims": F.lit(3), "n_supported": F.col("doc_id") % 3, "n_contradicted": F.col("doc_id") % 2, "n_trusted": F.col("doc_id") % 4, "evidence_confidence": (F.col("doc_id") % 10) / 10})
    return T.reasons(T.trust_score(a))


def trust_score(spark, sf_dir):
    return _trusted(spark, sf_dir).select("doc_id", *[f"s_{k}" for k in L.TRUST_WEIGHTS], "trust_score", "trust_level", F.array_join("trust_signals", "|").alias("trust_signals"), F.md5(T.trust_explanation().cast("binary")).alias("explanation_md5"))


_wc = f"len(list_filter(string_split({S.collapse('text')}, ' '), lambda w: w <> ''))"
_pc = lambda u: f"least(100, greatest(0, {S.whole(f'({u}) * 100')}))::INTEGER"
_base = "CASE WHEN trust IS NOT NULL THEN trust / 100.0::DOUBLE WHEN badge = 'Trusted' THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END"
_asl = "(wc / greatest(len(sents), 1)::DOUBLE)"
_struct = "CASE WHEN len(sents) >= 4 THEN 1.0::DOUBLE WHEN len(sents) = 3 THEN 0.82::DOUBLE WHEN len(sents) = 2 THEN 0.58::DOUBLE ELSE 0.35::DOUBLE END"
_simple = "list_filter(string_split(" + S.collapse(f"regexp_replace(lower({S.collapse('text')}), '[^a-z0-9\\s]', ' ', 'g')") + ", ' '), lambda w: length(w) >= 3)"
_div = f"(CASE WHEN len({_simple}) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct({_simple})) / len({_simple})::DOUBLE END)"
_noise = f"least(1.0::DOUBLE, 0.18::DOUBLE * {S.count_of('text', '[!?]{2,}')} + 1.7::DOUBLE * {S.uppercase_ratio('text')} + 0.12::DOUBLE * n_suspicious)"
_wq = S.clamp(f"0.35::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - abs({_asl} - 22) / 18)) + 0.2::DOUBLE * ({_struct}) + 0.2::DOUBLE * {S.clamp(f'({_div} - 0.28::DOUBLE) / 0.3::DOUBLE')} + 0.25::DOUBLE * (1 - {_noise})")
_tenths = {k: round(w * 10) for k, w in L.TRUST_WEIGHTS.items()}
_odd_host = "r_suspicious_domain >= 0.72"
_said = {k: (S.lit(good), S.lit(bad)) for k, (good, bad) in L.TRUST_TEXTS.items()} | {
    "domain_reputation": (
        f"CASE WHEN trust IS NOT NULL AND badge = 'Trusted' THEN 'Reliable domain' WHEN trust IS NOT NULL AND badge = 'Medium' THEN 'Domain has mixed but known reputation signals' WHEN trust IS NOT NULL THEN 'The domain appears in the suspicious-source registry' WHEN {_odd_host} THEN 'Domain reputation looks acceptable.' ELSE 'Domain reputation is acceptable.' END",
        f"CASE WHEN trust IS NOT NULL AND badge = 'Suspicious' THEN 'The domain is listed as suspicious in the source reputation registry.' WHEN trust IS NOT NULL AND badge = 'Medium' THEN 'The domain has mixed or medium reputation signals.' WHEN trust IS NOT NULL THEN 'Domain reputation is not strong enough to build high trust.' WHEN {_odd_host} THEN 'The domain looks suspicious or low-reputation.' ELSE 'The domain is not clearly established as reliable.' END",
    ),
    "source_reliability": (
        "CASE WHEN badge = 'Trusted' AND n_tr > 1 AND n_sup >= n_con THEN 'Reliable domain with multiple trusted sources' WHEN n_tr > 1 AND n_sup >= n_con THEN 'Multiple trusted sources support the article' WHEN n_tr >= 1 AND n_sup >= n_con THEN 'Trusted source support is available' WHEN badge = 'Trusted' THEN 'Reliable domain' WHEN badge = 'Medium' THEN 'Source reliability is mixed' WHEN badge = 'Suspicious' THEN 'The source has a weak reliability record' ELSE 'Source reliability is acceptable' END",
        "CASE WHEN badge = 'Suspicious' THEN 'The source appears in the suspicious-source registry and should be verified carefully.' WHEN n_con > n_sup THEN 'Trusted-source support is contradicted by other reporting.' WHEN n_tr = 0 THEN 'Trusted-source support is weak or unavailable.' ELSE 'Trusted-source support is limited.' END",
    ),
}
_sig = ", ".join(f"{{'id': '{k}', 'score': s_{k}, 'up': s_{k} * {w}, 'down': (100 - s_{k}) * {w}, 'place': {-i}, 'good': {_said[k][0]}, 'bad': {_said[k][1]}}}" for i, (k, w) in enumerate(_tenths.items()))
_top = lambda key, text, cond: f"list_transform(list_sort(list_transform(list_filter(sig, lambda s: {cond}), lambda s: {{'k': s.{key}, 'p': s.place, 'i': s.id, 't': s.{text}}}), 'DESC'), lambda s: {{'i': s.i, 't': s.t}})"


def trust_sql(rows: str) -> str:
    """From a relation with the rules' columns, p_real, p_fake and n_cl, n_sup, n_con, n_tr, ev_conf: CTEs up to ``t4``."""
    rel = S.clamp(f"0.62::DOUBLE * ({_base}) + 0.22::DOUBLE * (n_sup / greatest(n_cl, 1)::DOUBLE) + least(0.08::DOUBLE * n_tr, 0.18::DOUBLE) + 0.18::DOUBLE * ev_conf - 0.35::DOUBLE * (n_con / greatest(n_cl, 1)::DOUBLE)")
    return f"""t0 AS MATERIALIZED (SELECT *, {_wc} AS wc FROM {rows}),
t1 AS MATERIALIZED (SELECT *, {_pc(f"CASE WHEN p_real + p_fake > 0 THEN {S.round_('p_real / (p_real + p_fake)', 4)} ELSE 0.5::DOUBLE END")} AS s_ml_probability,
  {_pc("CASE WHEN trust IS NOT NULL THEN trust / 100.0::DOUBLE WHEN r_suspicious_domain >= 0.72 THEN 0.16::DOUBLE ELSE 0.56::DOUBLE END")} AS s_domain_reputation,
  {_pc(rel)} AS s_source_reliability, {_pc('1 - greatest(r_emotional_language, emotional_intensity)')} AS s_emotional_language, {_pc('1 - r_clickbait_title')} AS s_clickbait_detection,
  {_pc('1 - r_sensational_phrases')} AS s_sensational_language,
  {_pc("CASE WHEN wc > 2600 THEN 0.58::DOUBLE WHEN wc > 1800 THEN 0.72::DOUBLE WHEN wc >= 220 THEN 1.0::DOUBLE WHEN wc >= 160 THEN 0.78::DOUBLE WHEN wc >= 90 THEN 0.5::DOUBLE ELSE 0.28::DOUBLE END")} AS s_article_length,
  {_pc(_wq)} AS s_writing_quality, CASE WHEN has_author THEN 100 ELSE 28 END AS s_author_presence, CASE WHEN has_date THEN 100 ELSE 34 END AS s_publication_date FROM t0),
t2 AS MATERIALIZED (SELECT *, {S.whole('(' + ' + '.join(f's_{k} * {w}' for k, w in _tenths.items()) + f') / {sum(_tenths.values())}.0::DOUBLE')}::INTEGER AS trust_score, [{_sig}] AS sig FROM t1),
t3 AS MATERIALIZED (SELECT *, {_top('up', 'good', 's.score >= 70')} AS good, {_top('down', 'bad', 's.score < 50')} AS bad FROM t2),
t4 AS MATERIALIZED (SELECT *, CASE WHEN trust_score >= 75 THEN 'High credibility' WHEN trust_score >= 55 THEN 'Moderate credibility' ELSE 'Low credibility' END AS trust_level,
  CASE WHEN len(CASE WHEN trust_score >= 75 THEN good[1:4] WHEN trust_score <= 45 THEN bad[1:4] ELSE [] END) > 0 THEN CASE WHEN trust_score >= 75 THEN good[1:4] ELSE bad[1:4] END ELSE list_concat(good[1:2], bad[1:2]) END AS said FROM t3)"""


TRUST_EXPLANATION = "'Trust Score ' || trust_score || '/100 indicates ' || lower(trust_level) || '. ' || CASE WHEN len(said) > 0 THEN 'Reasons: ' || array_to_string(list_transform(said, lambda s: s.t), '; ') || '.' ELSE 'No strong trust signals were identified.' END"
TRUST = f"""{_UPTO_RULES}, {_HEUR},
ev AS (SELECT *, 3 AS n_cl, doc_id % 3 AS n_sup, doc_id % 2 AS n_con, doc_id % 4 AS n_tr, (doc_id % 10) / 10.0::DOUBLE AS ev_conf FROM heur),
{trust_sql('ev')}
SELECT doc_id, {', '.join(f's_{k}' for k in L.TRUST_WEIGHTS)}, trust_score, trust_level, array_to_string(list_transform(said, lambda s: s.i), '|') AS trust_signals, md5({TRUST_EXPLANATION}) AS explanation_md5
FROM t4"""

QUERIES = {f.__name__: f for f in (token_stats, readability_docs, readability_by_lang, sentiment_score, lexicon_hits, language_detect, language_confusion, emotion_profile, top_keywords_per_doc, key_phrases, keyword_metadata, topic_scores, entities, top_entities, suspicious_sentences, rule_risk, heuristic_predict, fuse_probabilities, final_label, writing_style, trust_score)}
ORACLES = {
    "token_stats": TOKEN_STATS,
    "readability_docs": READABILITY_DOCS,
    "readability_by_lang": READABILITY_BY_LANG,
    "sentiment_score": SENTIMENT_SCORE,
    "lexicon_hits": LEXICON_HITS,
    "language_detect": LANGUAGE_DETECT,
    "language_confusion": LANGUAGE_CONFUSION,
    "emotion_profile": EMOTION_PROFILE,
    "top_keywords_per_doc": TOP_KEYWORDS,
    "key_phrases": KEY_PHRASES,
    "keyword_metadata": KEYWORD_METADATA,
    "topic_scores": TOPIC_SCORES,
    "entities": ENTITIES,
    "top_entities": TOP_ENTITIES,
    "suspicious_sentences": SUSPICIOUS,
    "rule_risk": RULE_RISK,
    "heuristic_predict": HEURISTIC,
    "fuse_probabilities": FUSE,
    "final_label": FINAL_LABEL,
    "writing_style": WRITING_STYLE,
    "trust_score": TRUST,
}
