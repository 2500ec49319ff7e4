"""Queries over claims, evidence and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import labels as B
from factloom.functions import lexicons as L
from factloom.functions import text as X
from factloom.operators import evidence as E
from factloom.operators import html as H
from factloom.operators import reputation as R

from . import sqltext as S
from .text_queries import LEX, articles, read

PAGES = [
    ("thther.example.org", [], "Suspicious", 12, "Unknown", "Nowhere", "Low"),
    ("example.org", ["example.net"], "Trusted", 90, "Center", "Nowhere", "High"),
    ("blog.tionble.example.com", ["m.ththth.example.net"], "", 60, "Center", "Nowhere", "Mixed"),
]


def claims(spark, sf_dir) -> DataFrame:
    return E.main_claims(articles(spark, sf_dir), lex=LEX)


_points = f"""len(list_filter(hw, lambda k: contains(lower(s), k))) * 35 + {S.present('lower(s)', LEX.claim_verbs)} * 25
  + {S.count_of('s', '\\b\\d+(?:\\.\\d+)?\\b')} * 20 + least({S.count_of('s', '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2}\\b')}, 3) * 12 - CASE WHEN length(s) > 260 THEN 10 ELSE 0 END"""


def _kw_array(x: str, n: int) -> str:
    return f"(list_transform(list_sort(list_transform(list_filter(list_distinct({x}), lambda w: w <> ''), lambda w: {{'n': -len(list_filter({x}, lambda o: o = w)), 'p': list_position({x}, w), 'w': w}})), lambda t: t.w))[1:{n}]"


_CLAIMS = f"""hws AS MATERIALIZED (SELECT doc_id, title, sents, {S.keyword_words('title')} AS kws FROM articles),
hwk AS MATERIALIZED (SELECT doc_id, title, sents, {_kw_array('kws', 8)} AS hw FROM hws),
cs AS (SELECT doc_id, title, hw, unnest(sents) AS s, generate_subscripts(sents, 1) AS pos FROM hwk),
cp AS MATERIALIZED (SELECT *, {_points} AS points FROM cs WHERE length(s) BETWEEN 55 AND 260),
cb AS (SELECT doc_id, title, trim(s) AS claim, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, pos) AS n FROM cp WHERE points > 35 QUALIFY n <= 3),
ca AS (SELECT doc_id, title, claim, min(n) AS n FROM (SELECT * FROM cb UNION ALL SELECT doc_id, title, trim(title), 0 FROM hwk) WHERE claim <> '' GROUP BY ALL),
claims AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INTEGER AS claim_no, claim, title FROM ca QUALIFY claim_no <= 3)"""
CLAIMS = f"WITH {S.ARTICLES}, {_CLAIMS} SELECT * FROM claims"


def _corpus(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", X.headline(F.col("text")).alias("title"), "text")


def evidence_matches(spark, sf_dir):
    m = E.match_evidence(claims(spark, sf_dir), _corpus(spark, sf_dir), lex=LEX)
    return m.select("doc_id", "claim_no", "item_id", "similarity", "stance", "rank")


_kws = lambda x: S.keyword_words(x)
_MATCH = f"""bench AS MATERIALIZED (SELECT item_id, title, text, lower(concat_ws(' ', title, text)) AS item_text, {S.similarity_tokens('title')} AS tt, {S.similarity_tokens("concat_ws(' ', title, substring(text, 1, 900))")} AS tc,
  {_kws("concat_ws(' ', title, text)")} AS tkw FROM (SELECT item_id, text, {S.title('text')} AS title FROM benchmark)),
bk AS MATERIALIZED (SELECT *, {_kw_array('tkw', 12)} AS tk FROM bench),
cq AS MATERIALIZED (SELECT *, {S.similarity_tokens('title')} AS ct, {S.similarity_tokens('claim')} AS cc, {_kws("concat_ws(' ', title, claim)")} AS ckw, lower(concat_ws(' ', title, claim)) AS query FROM claims),
ck AS MATERIALIZED (SELECT *, {_kw_array('ckw', 10)} AS kk FROM cq),
px AS MATERIALIZED (SELECT c.doc_id, c.claim_no, b.item_id, b.title AS item_title, c.query, b.item_text, {S.jaccard('c.ct', 'b.tt')} AS jt, {S.jaccard('c.cc', 'b.tc')} AS jc,
  CASE WHEN len(kk) > 0 THEN len(list_intersect(kk, tk)) / len(kk)::DOUBLE ELSE 0.0::DOUBLE END AS ov FROM ck c, bk b),
ps1 AS MATERIALIZED (SELECT *, {S.round_('jt * 0.32::DOUBLE + jc * 0.48::DOUBLE + ov * 0.2::DOUBLE', 4)} AS similarity FROM px),
pst AS MATERIALIZED (SELECT *, {S.contained('query', LEX.contradictions)} AS aq, {S.contained('item_text', LEX.contradictions)} AS ag, {S.contained('item_text', LEX.supports)} AS su FROM ps1 WHERE similarity >= 0.16),
matches AS MATERIALIZED (SELECT *, CASE WHEN ag > su AND aq = 0 THEN 'CONTRADICT' WHEN aq > 0 AND su > ag THEN 'CONTRADICT' WHEN su > ag THEN 'SUPPORT' WHEN (jc >= 0.38 OR jt >= 0.72) AND ag = 0 THEN 'SUPPORT' ELSE 'RELATED' END AS stance,
  row_number() OVER (PARTITION BY doc_id, claim_no ORDER BY similarity DESC, item_id)::INTEGER AS rank FROM pst QUALIFY rank <= 8)"""
MATCHES = f"WITH {S.ARTICLES}, {_CLAIMS}, {_MATCH} SELECT doc_id, claim_no, item_id, similarity, stance, rank FROM matches"


def claim_verdicts(spark, sf_dir):
    c, t = claims(spark, sf_dir), _corpus(spark, sf_dir)
    return E.claim_verdicts(c, E.match_evidence(c, t, lex=LEX), t)


_VERDICTS = f"""kept AS MATERIALIZED (SELECT * FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id, claim_no, lower(item_title), stance ORDER BY rank) = 1) QUALIFY row_number() OVER (PARTITION BY doc_id, claim_no ORDER BY rank) <= 5),
cper AS (SELECT doc_id, claim_no, count(*) AS n, count(*) FILTER (stance = 'SUPPORT') AS n_support, count(*) FILTER (stance = 'CONTRADICT') AS n_contradict, count(*) FILTER (stance = 'RELATED') AS n_related,
  sum({S.whole('similarity * 10000')})::BIGINT AS ss FROM kept GROUP BY ALL),
cv0 AS MATERIALIZED (SELECT c.doc_id, c.claim_no, coalesce(n, 0) AS n, coalesce(n_support, 0) AS n_support, coalesce(n_contradict, 0) AS n_contradict, coalesce(n_related, 0) AS n_related, coalesce(ss, 0) AS ss FROM claims c LEFT JOIN cper p USING (doc_id, claim_no)),
cv1 AS MATERIALIZED (SELECT *, ss / greatest(n, 1)::DOUBLE / 10000 AS mean, greatest(n_support, n_contradict, n_related) / greatest(n, 1)::DOUBLE AS dom FROM cv0),
cv2 AS MATERIALIZED (SELECT *, {S.round_('mean', 4)} AS mean_similarity, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {S.round_('0.65::DOUBLE * mean + 0.2::DOUBLE * least(n / 4.0::DOUBLE, 1.0::DOUBLE) + 0.15::DOUBLE * dom', 4)} END AS confidence FROM cv1),
verdicts AS MATERIALIZED (SELECT doc_id, claim_no, n, n_support, n_contradict, n_related, mean_similarity, confidence,
  CASE WHEN n > 0 AND n_contradict > n_support AND confidence >= 0.34 THEN 'CONTRADICTED' WHEN n > 0 AND n_support > n_contradict AND confidence >= 0.34 THEN 'SUPPORTED' ELSE 'UNVERIFIED' END AS verdict FROM cv2)"""
VERDICTS = f"WITH {S.ARTICLES}, {_CLAIMS}, {_MATCH}, {_VERDICTS} SELECT * FROM verdicts"


def evidence_rollup(spark, sf_dir):
    up = E.roll_up(claim_verdicts(spark, sf_dir))
    base = F.col("doc_id") % 101
    return up.withColumn("adjusted", E.adjusted_credibility(base, F.col("evidence_credibility"), F.col("evidence_confidence"), F.col("n_evidence")))


ROLLUP = f"""WITH {S.ARTICLES}, {_CLAIMS}, {_MATCH}, {_VERDICTS},
per AS MATERIALIZED (SELECT doc_id, count(*) AS n_claims, count(*) FILTER (verdict = 'SUPPORTED') AS n_supported, count(*) FILTER (verdict = 'CONTRADICTED') AS n_contradicted, sum(n)::BIGINT AS n_evidence,
  sum(n_support)::BIGINT AS s, sum(n_contradict)::BIGINT AS c, sum(n_related)::BIGINT AS r, sum({S.whole('confidence * 10000')})::BIGINT AS cf FROM verdicts GROUP BY doc_id),
p2 AS MATERIALIZED (SELECT *, CASE WHEN s + c + r > 0 THEN {S.whole('100 * (s + r / 2.0::DOUBLE) / (s + c + r / 2.0::DOUBLE)')} ELSE 50 END AS evidence_credibility, {S.round_('cf / n_claims::DOUBLE / 10000', 4)} AS evidence_confidence FROM per)
SELECT doc_id, n_claims, n_supported, n_contradicted, n_evidence, evidence_credibility, evidence_confidence,
  CASE WHEN n_contradicted > n_supported THEN 'CONTRADICTS' WHEN n_supported > n_contradicted THEN 'SUPPORTS' WHEN n_supported > 0 THEN 'MIXED' ELSE 'UNVERIFIED' END AS overall,
  CASE WHEN n_evidence > 0 THEN {S.whole(f"(doc_id % 101) * (1 - {S.round_('0.18::DOUBLE + 0.32::DOUBLE * evidence_confidence', 3)}) + evidence_credibility * {S.round_('0.18::DOUBLE + 0.32::DOUBLE * evidence_confidence', 3)}")} ELSE doc_id % 101 END AS adjusted
FROM p2"""


# ---------------------------------------------------------------- pages


def extract_pages(spark, sf_dir):
    x = H.extract_articles(read(spark, sf_dir, "pages"))
    return x.select("page_id", "title", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "has_article", "readable", "partial")


def _decode(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _strip_html(x: str) -> str:
    bare = x
    for t in ("script", "style", "noscript"):
        bare = f"regexp_replace({bare}, '(?is)<{t}.*?</{t}>', ' ', 'g')"
    return S.collapse(_decode(f"regexp_replace({bare}, '(?s)<[^>]+>', ' ', 'g')"))


def _strip_blocks(x: str) -> str:
    for t in L.NON_ARTICLE_BLOCKS:
        x = f"regexp_replace({x}, '(?is)<{t}.*?</{t}>', ' ', 'g')"
    return x


def _article_text(x: str) -> str:
    plain = f"regexp_replace({_decode(x)}, '(?i)\\b(?:advertisement|sponsored content|sign up for our newsletter)\\b', ' ', 'g')"
    return S.collapse(f"regexp_replace({plain}, '(?i)\\b(?:function|return|var|let|const)\\s*\\(', ' ', 'g')")


def _script(x: str) -> str:
    return f"({S.contained(f'lower({x})', L.SCRIPT_SIGNALS)} >= 2 OR (length({x}) - length(translate({x}, '{{}};=<>', ''))) / greatest(length({x}), 1)::DOUBLE > 0.08)"


def _boiler(x: str) -> str:
    return f"""(length({x}) < 55 OR length({x}) > 1800 OR NOT (regexp_matches({x}, '[.!?]["'')\\]]?$') OR len(regexp_split_to_array({x}, '\\s+')) >= 18)
      OR regexp_matches(lower({x}), '^(?:{'|'.join(L.BOILERPLATE_STARTS)})\\b') OR regexp_matches(lower({x}), '\\b(?:{'|'.join(L.BOILERPLATE_ANYWHERE)})\\b') OR {_script(x)})"""


def _score(x: str, priority: int) -> str:
    ads = f"regexp_matches({x}, '(?i)advertisement|subscribe|newsletter|cookie|privacy|terms|all rights reserved')"
    words = f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
    return f"{priority} + least(length({x}), 6000) + {S.count_of(x, '[.!?]')} * 80 + {words} * 4 - CASE WHEN {_script(x)} THEN 10000 ELSE 0 END - CASE WHEN {ads} THEN 500 ELSE 0 END"


def _pars(tag: str, src: str) -> str:
    return f"""{tag}0 AS MATERIALIZED (SELECT page_id, {_strip_blocks(src)} AS h FROM pg),
{tag}1 AS MATERIALIZED (SELECT page_id, list_transform(regexp_extract_all(h, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: {_article_text(_strip_html('p'))}) AS ps FROM {tag}0),
{tag}2 AS MATERIALIZED (SELECT page_id, list_transform(ps, lambda p: lower(p)) AS low, ps FROM {tag}1),
{tag} AS MATERIALIZED (SELECT page_id, array_to_string(list_filter(ps, lambda p, i: p <> '' AND list_position(low, lower(p)) = i AND NOT {_boiler('p')}), ' ') AS t FROM {tag}2)"""


_CAND = f"""pg AS MATERIALIZED (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '(?is)(<article.*?</article>)', 1) AS art FROM pages),
{_pars('pa', 'art')}, {_pars('pp', 'html')},
pl0 AS MATERIALIZED (SELECT page_id, {_article_text(_strip_html(_strip_blocks('html')))} AS t0 FROM pg),
pl AS MATERIALIZED (SELECT page_id, CASE WHEN length(t0) >= 45 AND NOT {_boiler('t0')} THEN t0 ELSE '' END AS t FROM pl0),
cand AS MATERIALIZED (SELECT page_id, {_article_text('pa.t')} AS t1, {_article_text('pp.t')} AS t2, {_article_text('pl.t')} AS t3 FROM pa JOIN pp USING (page_id) JOIN pl USING (page_id)),
scored AS MATERIALIZED (SELECT page_id, list_filter([
  CASE WHEN length(t1) >= 80 AND NOT {_script('t1')} THEN {{'score': {_score('t1', 2500)}, 'i': -1, 'text': t1}} END,
  CASE WHEN length(t2) >= 80 AND NOT {_script('t2')} THEN {{'score': {_score('t2', 1800)}, 'i': -2, 'text': t2}} END,
  CASE WHEN length(t3) >= 80 AND NOT {_script('t3')} THEN {{'score': {_score('t3', 700)}, 'i': -4, 'text': t3}} END], lambda s: s IS NOT NULL) AS c FROM cand),
picked AS MATERIALIZED (SELECT page_id, substring(coalesce(list_max(c).text, ''), 1, 12000) AS text FROM scored),
ext AS MATERIALIZED (SELECT g.page_id, url, substring({S.collapse(_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, 1, 220) AS title, text, art <> '' AS has_article,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS nw FROM pg g JOIN picked USING (page_id))"""
EXTRACT = f"""WITH {_CAND} SELECT page_id, title, md5(text) AS text_md5, length(text)::INTEGER AS n_chars, has_article, length(text) >= 120 AND nw >= 18 AND NOT {_script('text')} AS readable, nw < 45 AS partial FROM ext"""


def page_quality_gate(spark, sf_dir):
    x = H.extract_articles(read(spark, sf_dir, "pages"))
    return x.groupBy("has_article", "readable", "partial", "listing").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


_list = S.contained("lower(concat_ws(' ', title, text))", L.LISTING_SIGNALS)
_home = "len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')) <= 1"
GATE = f"""WITH {_CAND} SELECT has_article, length(text) >= 120 AND nw >= 18 AND NOT {_script('text')} AS readable, nw < 45 AS partial,
  ({_home} AND {_list} >= 2) OR (NOT has_article AND {_home} AND {_list} >= 1) AS listing, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM ext GROUP BY ALL"""


def _hosted(spark, sf_dir) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", B.domain(F.col("url")).alias("host"))
    return R.with_reputation(pages, "host", R.registry(spark, PAGES))


_pnames = [(n, i, d, b or ("Trusted" if t >= 80 else "Medium" if t >= 55 else "Suspicious"), t) for i, (d, al, b, t, *_) in enumerate(PAGES) for n in (d, *al)]
_HOSTED = f"""reg(name, place, domain, badge, trust) AS (VALUES {', '.join(f"('{n}', {i}, '{d}', '{b}', {t})" for n, i, d, b, t in _pnames)}),
hp AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages),
hr AS (SELECT page_id, arg_min(domain, place) AS domain, arg_min(badge, place) AS badge, arg_min(trust, place) AS trust FROM hp JOIN reg ON host = name OR ends_with(host, '.' || name) GROUP BY page_id),
hosted AS (SELECT hp.page_id, host, domain, badge, trust FROM hp LEFT JOIN hr USING (page_id))"""


def source_reputation(spark, sf_dir):
    return _hosted(spark, sf_dir).select("page_id", "host", "domain", F.coalesce("badge", F.lit("Unknown")).alias("badge"), F.coalesce("trust", F.lit(50)).alias("trust"))


REPUTATION = f"WITH {_HOSTED} SELECT page_id, host, domain, coalesce(badge, 'Unknown') AS badge, coalesce(trust, 50) AS trust FROM hosted"


def top_domains(spark, sf_dir):
    rows = _hosted(spark, sf_dir).withColumns({"trust_score": F.coalesce("trust", F.col("page_id") % 101), "pos": F.col("page_id"), "badge": F.coalesce("badge", F.lit("Unknown"))})
    return R.domain_usage(rows)


TOP_DOMAINS = f"""WITH {_HOSTED}, f AS (SELECT page_id, host, coalesce(badge, 'Unknown') AS badge, coalesce(trust, page_id % 101) AS ts FROM hosted WHERE host <> '')
SELECT host, count(*) AS n, {S.whole('coalesce(avg(ts) FILTER (ts > 0), 0.0::DOUBLE)')} AS trust, arg_max(badge, page_id) AS badge FROM f GROUP BY host ORDER BY n DESC, trust DESC, host LIMIT 8"""

QUERIES = {f.__name__: f for f in (claims, evidence_matches, claim_verdicts, evidence_rollup, extract_pages, page_quality_gate, source_reputation, top_domains)}
ORACLES = {"claims": CLAIMS, "evidence_matches": MATCHES, "claim_verdicts": VERDICTS, "evidence_rollup": ROLLUP, "extract_pages": EXTRACT, "page_quality_gate": GATE, "source_reputation": REPUTATION, "top_domains": TOP_DOMAINS}
