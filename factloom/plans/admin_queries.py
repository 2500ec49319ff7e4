"""Queries over users, previews, notifications and probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import admin as A

from . import claim_queries as C
from . import sqltext as S
from .text_queries import read


def _users(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    role = F.element_at(F.array(F.lit("Admin"), F.lit("Analyst"), F.lit("Viewer")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select(F.col("c_name").alias("name"), F.concat("c_name", F.lit("@Example.org")).alias("email"), role.alias("role"), F.when(F.col("c_acctbal") > 0, "Active").otherwise("Suspended").alias("status"), A.password_hash(F.col("c_name")).alias("password_hash"))


_USERS = "users AS (SELECT c_name AS name, c_name || '@Example.org' AS email, (['Admin', 'Analyst', 'Viewer'])[c_custkey % 3 + 1] AS role, CASE WHEN c_acctbal > 0 THEN 'Active' ELSE 'Suspended' END AS status, sha256(c_name) AS password_hash FROM customer)"


def admin_overview(spark, sf_dir):
    articles = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "FAKE").otherwise("REAL").alias("label"))
    return A.overview(_users(spark, sf_dir), articles, read(spark, sf_dir, "labels"), read(spark, sf_dir, "events"))


ADMIN_OVERVIEW = f"""WITH {_USERS} SELECT count(*) AS users, count(*) FILTER (status = 'Active') AS active_users, count(*) FILTER (role = 'Admin') AS admins, count(*) FILTER (role = 'Analyst') AS analysts,
  (SELECT count(*) FROM documents) AS articles, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS real_articles, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS fake_articles, (SELECT count(*) FROM labels) AS analyses, (SELECT count(*) FROM events) AS log_entries,
  'Unavailable' AS best_model, 'Unavailable' AS model_version, 'unknown' AS model_status FROM users"""


def user_directory(spark, sf_dir):
    """All users without secrets, and the password hash's check apart."""
    u = _users(spark, sf_dir)
    return A.public(u).join(u.select("email", F.substring("password_hash", 1, 12).alias("hash_head")), "email")


def user_lookup(spark, sf_dir):
    first = read(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0]
    return A.user_by_email(_users(spark, sf_dir), f" {first.upper()}@EXAMPLE.ORG ")


def dataset_preview(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", X.headline(F.col("text")).alias("title"), "text")
    return A.dataset_preview(d, "doc_id").select("doc_id", "preview", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


_long = "list_filter(" + S.sentences("text") + ", lambda s: length(s) > 35)"
PREVIEW = f"""WITH first AS (SELECT doc_id, {S.title('text')} AS title, text FROM documents ORDER BY doc_id LIMIT 12), p AS (SELECT *, {_long} AS longs FROM first)
SELECT doc_id, substring(coalesce(text, ''), 1, 180) AS preview, md5(CASE WHEN len(longs) > 0 THEN substring({S.collapse("array_to_string(longs[1:3], ' ')")}, 1, 420)
  ELSE CASE WHEN substring({S.collapse("title || '. ' || text")}, 1, 280) = '' THEN 'No summary available.' ELSE substring({S.collapse("title || '. ' || text")}, 1, 280) END END) AS summary_md5 FROM p"""


def trust_resolution(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    scores = [F.col("doc_id") % k - off for k, off in ((3, 1), (5, 2), (7, 3), (11, 5), (13, 0))]
    return d.select("doc_id", A.first_positive(*scores).alias("trust"))


TRUST_RESOLUTION = "SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN doc_id % {k} - {off} > 0 THEN doc_id % {k} - {off} END" for k, off in ((3, 1), (5, 2), (7, 3), (11, 5), (13, 0))) + ", 0)::DOUBLE AS trust FROM documents"


def probability_maps(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumns({"r": F.col("doc_id") % 7 / 5, "f": F.col("doc_id") % 4 / 4 * (F.col("doc_id") % 2)})
    m = A.probability_map(F.create_map(F.lit("true"), "r", F.lit(" Fake "), "f", F.lit("odd"), F.col("doc_id") % 3 / 4))
    return d.select("doc_id", m.alias("m")).select("doc_id", "m.*", A.binary_map(F.col("m")).alias("b")).select("doc_id", "REAL", "FAKE", "UNCERTAIN", F.col("b.REAL").alias("binary_real"), F.col("b.FAKE").alias("binary_fake"))


PROBABILITY_MAPS = f"""WITH m AS (SELECT doc_id, least(doc_id % 7 / 5.0::DOUBLE, 1.0::DOUBLE) AS r, doc_id % 4 / 4.0::DOUBLE * (doc_id % 2) AS f, doc_id % 3 / 4.0::DOUBLE AS u FROM documents)
SELECT doc_id, r AS "REAL", f AS "FAKE", u AS "UNCERTAIN", CASE WHEN r <= 0 AND f <= 0 THEN 0.5::DOUBLE ELSE {S.round_('r / (r + f)', 4)} END AS binary_real, CASE WHEN r <= 0 AND f <= 0 THEN 0.5::DOUBLE ELSE {S.round_('f / (r + f)', 4)} END AS binary_fake FROM m"""


def notifications(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("REAL").alias("label"), (F.col("doc_id") % 101).alias("confidence"))
    return A.notifications(d.withColumn("title", F.col("text"))).select("doc_id", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), "unread")


NOTIFICATIONS = """SELECT doc_id, 'Article analyzed' AS title, md5('REAL result saved for "' || substring(text, 1, 80) || '" at ' || (doc_id % 101) || '% confidence.') AS text_md5, true AS unread FROM documents"""


def claim_explanations(spark, sf_dir):
    return C.claim_verdicts(spark, sf_dir).select("doc_id", "claim_no", A.claim_explanation().alias("explanation"))


_sure = S.whole("confidence * 100")
CLAIM_EXPLANATIONS = f"""{C.VERDICTS.removesuffix('SELECT * FROM verdicts')}
SELECT doc_id, claim_no, CASE verdict WHEN 'SUPPORTED' THEN 'Trusted coverage aligns with this claim. ' || n_support || ' supporting article(s) were found with ' || {_sure} || '% confidence and no stronger contradictory signal.'
  WHEN 'CONTRADICTED' THEN 'Trusted reporting challenges this claim. ' || n_contradict || ' contradicting article(s) outweighed ' || n_support || ' supporting article(s), producing ' || {_sure} || '% confidence in the contradiction signal.'
  ELSE CASE WHEN n_support + n_contradict + n_related = 0 THEN 'Unable to verify this claim using trusted sources.' ELSE 'Trusted sources covered related material, but the evidence was not strong enough to clearly support or contradict this claim. Evidence confidence is ' || {_sure} || '%.' END END AS explanation FROM verdicts"""

QUERIES = {f.__name__: f for f in (admin_overview, user_directory, user_lookup, dataset_preview, trust_resolution, probability_maps, notifications, claim_explanations)}
ORACLES = {
    "admin_overview": ADMIN_OVERVIEW,
    "user_directory": f"WITH {_USERS} SELECT name, email, role, status, substring(password_hash, 1, 12) AS hash_head FROM users",
    "user_lookup": f"WITH {_USERS} SELECT * FROM users WHERE name = (SELECT min(c_name) FROM customer)",
    "dataset_preview": PREVIEW,
    "trust_resolution": TRUST_RESOLUTION,
    "probability_maps": PROBABILITY_MAPS,
    "notifications": NOTIFICATIONS,
    "claim_explanations": CLAIM_EXPLANATIONS,
}
