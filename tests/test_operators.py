import datetime as dt
import json
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.functions import text as X
from factloom.operators import analysis as A
from factloom.operators import dashboard as D
from factloom.operators import evidence as E
from factloom.operators import export as EX
from factloom.operators import html as H
from factloom.operators import intelligence as I
from factloom.operators import ml as M
from factloom.operators import reputation as R
from factloom.operators import search as Q
from factloom.operators import store as ST
from factloom.operators import trust as T
from factloom.plans import data_queries
from factloom.sources import datasets as DS
from factloom.streaming import logs

SOUND = "Officials said the report was published. " + "According to the study, the confirmed data covers the region. " * 20
LOUD = "SHOCKING!! This hoax is a conspiracy and a miracle, without evidence!! " + "Outrage and fear and chaos spread in panic!! " * 3


@pytest.fixture(scope="module")
def ruled(spark):
    rows = [(1, "Report published", SOUND, "https://www.reuters.com/a", "Ann", "2024-01-01"), (2, "You won't believe this secret", LOUD, "https://truth.xyz/b", "", ""), (3, "", "", "", None, None)]
    df = spark.createDataFrame(rows, "doc_id int, title string, text string, url string, author string, published string")
    df = I.prepare(df).withColumn("host", R.page_host())
    df = R.with_reputation(df, "host", R.registry(spark))
    return I.rules(I.count_suspicious(I.sentiment(df))).cache()


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_reputation_first_entry_wins(spark):
    entries = [("b.com", ["x.a.com"], "", 60, "", "", ""), ("a.com", [], "", 90, "", "", ""), ("", [], "", 1, "", "", "")]
    hosts = spark.createDataFrame([("x.a.com",), ("y.a.com",), ("ba.com",), ("",)], "h string")
    got = {r.h: (r.domain, r.badge) for r in R.with_reputation(hosts, "h", R.registry(spark, entries)).collect()}
    assert got == {"x.a.com": ("b.com", "Medium"), "y.a.com": ("a.com", "Trusted"), "ba.com": (None, None), "": (None, None)}


def test_rules(ruled):
    got = by_id(ruled, "badge", "r_clickbait_title", "r_emotional_language", "r_sensational_phrases", "r_suspicious_domain", "r_missing_author")
    assert got[1] == ("Trusted", 0.0, 0.0, 0.0, 0.0, 0.0)
    assert got[2] == (None, 1.0, 0.55, 1.0, 0.92, 0.7)
    assert got[3][4] == 0.0


def test_probabilities_and_trust(ruled):
    fused = by_id(I.fuse(I.heuristic(ruled)), "f_real", "f_fake", "f_uncertain", "label", "h_label")
    for real, fake, unsure, _, _ in fused.values():
        assert abs(real + fake + unsure - 1) < 1e-3
    assert fused[1][4] == "REAL" and fused[3][3] == "UNCERTAIN"
    evidence = {c: F.lit(0) for c in ("n_claims", "n_supported", "n_contradicted", "n_trusted", "evidence_confidence")}
    trust = by_id(T.reasons(T.trust_score(I.heuristic(ruled.withColumns(evidence)))), "trust_score", "trust_level", "trust_reasons")
    assert trust[1][0] > trust[2][0] and 0 <= trust[2][0] <= 100
    assert all(len(x[2]) <= 4 for x in trust.values())


def test_emotions_entities_topics(spark):
    text = "John Smith of Harvard University met Mary Jones in London on May 5, 2024. Fear and panic and hope."
    df = I.prepare(spark.createDataFrame([(1, "Election policy", text)], "doc_id int, title string, text string"))
    e = I.entities(df).first()
    assert e.organizations == ["Harvard University"] and e.people == ["John Smith", "Mary Jones"] and e.locations == ["London"] and e.dates == ["May 5, 2024"]
    m = I.emotions(df).first()
    assert (m.emotion, m.second_emotion) == ("fear", "joy")
    assert I.topics(df).first().topic == "politics"
    assert by_id(I.topics(df.withColumns({"title": F.lit(""), "text": F.lit("")})), "topic", "topic_confidence")[1] == ("general", 0.35)


def test_keywords_are_stable_under_repartition(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha gamma beta delta 1234 the with")], "doc_id int, text string")
    for n in (1, 5):
        got = I.keywords(df.repartition(n)).orderBy("rank").collect()
        assert [(r.term, r.n) for r in got] == [("alpha", 2), ("beta", 2), ("gamma", 1), ("delta", 1)]


def test_keyword_array_agrees_with_table(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha gamma beta delta")], "doc_id int, text string")
    assert df.select(I.keyword_array(F.col("text"), 3)).first()[0] == ["alpha", "beta", "gamma"]


def test_evidence(spark):
    claims = spark.createDataFrame([(1, 1, "the bridge collapsed in the northern city", "bridge collapsed")], "doc_id int, claim_no int, claim string, title string")
    corpus = spark.createDataFrame([(7, "bridge collapsed", "officials confirmed the bridge collapsed in the northern city"), (8, "bridge collapse denied", "the hoax about the bridge collapsed in the northern city was debunked"), (9, "cooking", "soup and bread")], "item_id int, title string, text string")
    m = E.match_evidence(claims, corpus)
    assert {r.item_id: r.stance for r in m.collect()} == {7: "SUPPORT", 8: "CONTRADICT"}
    v = E.claim_verdicts(claims, m, corpus).first()
    assert (v.n, v.n_support, v.n_contradict, v.verdict) == (2, 1, 1, "UNVERIFIED")
    up = E.roll_up(E.claim_verdicts(claims, m, corpus)).first()
    assert (up.overall, up.evidence_credibility) == ("UNVERIFIED", 50)


PAGE = """<html><head><title>Old &amp; new</title><meta property="og:title" content="Big news"><meta name="pubdate" content="2024-03-04">
<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "headline": "From graph", "author": [{"name": "A B"}, {"name": "C D"}], "datePublished": "2024-01-02"}]}</script><script type="application/ld+json">{broken</script></head>
<body><nav>menu</nav><article><p>%s</p><p>%s</p><p>Subscribe to our list for more of this and that, every day of the week, it is free.</p></article></body></html>""" % (("A long first sentence that tells what happened in the town on that day. " * 2,) * 2)


def test_html(spark):
    pages = spark.createDataFrame([(1, "https://x.org/a/b", PAGE), (2, "https://x.org/", ""), (3, None, None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in H.extract_articles(pages).collect()}
    assert got[1].title == "From graph" and got[1].author == "A B, C D" and got[1].published == "2024-01-02"
    assert got[1].text.count("A long first sentence") == 2 and "Subscribe" not in got[1].text
    assert got[2].text == "" and not got[2].readable and got[3].text == ""


ENTITIES = {
    "It&#8217;s &#x2014; &#233;&amp;lt;": "It\u2019s \u2014 \u00e9<",
    "&#38;#65; &#65;": "&#65; A",
    "&#38;#x41;": "A",
    "&#128512;": chr(128512 % 65536),
    "&#0065;&nbsp;&quot;&apos;&#39;&gt;&middot;": "A \"''>&middot;",
    "no reference & none; &#; &#x;": "no reference & none; &#; &#x;",
}


def test_entities_are_decoded_by_code_point(spark):
    rows = spark.createDataFrame([(k,) for k in ENTITIES], "x string")
    assert {r.x: r.y for r in rows.select("x", X.decode_entities(F.col("x")).alias("y")).collect()} == ENTITIES


FOLDED = {"\u015bni\u0107 \ufb01n \uff21\uff42 \u00bd \u2122": "snic fin Ab 12 TM", "Z\u00fcrich \u00df \u6f22": "Zurich  ", "e\u0301 \u1d400": "e 0"}


def test_compatibility_forms_are_folded(spark):
    rows = [(k,) for k in FOLDED] + [("".join(chr(c) for c in range(a, a + 400)),) for a in (0x80, 0x1E00, 0x2000, 0x2100, 0x3200, 0xFB00, 0xFF00)]
    for r in spark.createDataFrame(rows, "x string").select("x", X.fold_ascii(F.col("x")).alias("y")).collect():
        assert r.y == unicodedata.normalize("NFKD", r.x).encode("ascii", "ignore").decode()


def test_meta_dates_and_json_ld(spark):
    block = lambda x: f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'
    pages = {
        "order": ('<meta name="date" content="d"><meta property="article:modified_time" content="m"><meta name="publish-date" content="p">', ("", "", "", "m")),
        "parsely": ('<meta name="parsely-pub-date" content="2024">', ("", "", "", "2024")),
        "fallbacks": (block({"@type": "NewsArticle", "name": "N &amp; M", "description": "D", "author": {"alternateName": "Alt"}, "dateModified": "2020"}), ("N & M", "D", "Alt", "2020")),
        "graph in array": (block([{"@type": "WebPage"}, {"@graph": [{"@type": ["Thing", "Article"], "headline": "G", "articleBody": "B", "author": ["A", {"name": "C"}, [{"name": "E"}], "F"]}]}]), ("G", "B", "A, C, E", "")),
        "other types": (block({"@type": "BlogPosting", "headline": "no"}) + block("{broken") + block({"@type": "ReportageNewsArticle", "headline": "yes", "datePublished": "2021"}), ("yes", "", "", "2021")),
        "nothing": ("<p>plain</p>", ("", "", "", "")),
    }
    rows = spark.createDataFrame([(k, h) for k, (h, _) in pages.items()], "k string, html string")
    got = rows.select("k", H.json_ld(F.col("html")).alias("ld"), H.published_at(F.col("html")).alias("meta")).collect()
    for r in got:
        assert (r.ld.title, r.ld.text, r.ld.author, r.ld.published or r.meta) == pages[r.k][1], r.k


def test_dashboard_spines(spark):
    rows = [(1, "REAL", 0, 0, "h", "Trusted", dt.datetime(2024, 1, 29)), (2, "FAKE", 20, 50, "h", "", dt.datetime(2024, 1, 30)), (3, "what", 100, 70, "", "", None)]
    a = spark.createDataFrame(rows, "id int, label string, confidence int, trust_score int, host string, badge string, ts timestamp_ntz")
    assert [r.n for r in D.label_distribution(a).orderBy("place").collect()] == [1, 1, 1]
    assert [r.n for r in D.confidence_histogram(a).orderBy("place").collect()] == [2, 0, 0, 0, 1]
    for unit, n in (("day", 14), ("week", 8), ("month", 6)):
        s = D.series(a, dt.date(2024, 1, 30), unit, n).collect()
        assert len(s) == n and sum(r.total for r in s) == 2
    assert D.overview(a).first().mean_trust == 60
    empty = a.where("false")
    assert D.overview(empty).first().total == 0 and D.series(empty, dt.date(2024, 1, 30), "day", 3).count() == 3


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, p string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 2, "w"), ("c", 1, "q")], "k string, v int, p string")
    assert {r.k: r.p for r in ST.upsert(old, new, ["k"], "v").collect()} == {"a": "z", "b": "y", "c": "q"}
    assert {r.k for r in ST.delete_keys(old, new.where("k = 'a'"), ["k"]).collect()} == {"b"}
    assert {r.k: r.p for r in ST.update_where(old, F.col("k") == "a", {"p": F.lit("new")}).collect()} == {"a": "new", "b": "y"}
    d = ST.details(old, ["k"])
    assert json.loads(d.where("k = 'a'").first().details) == {"v": 1, "p": "x"}
    assert ST.spread(d, "details", "v int, k string").where("k = 'b'").first().v == 5
    c = ST.conform_analyses(spark.createDataFrame([("1", "fake", "0.4"), ("2", "true", "250")], "id string, verdict string, confidence string")).orderBy("id").collect()
    assert [(r.label, r.confidence, r.risk) for r in c] == [("FAKE", 0, "MEDIUM"), ("REAL", 100, "LOW")]


def test_whole_analyses_have_one_shape(spark):
    rows = [("A1", " T ", "fake", "81.6", None, "70", ["k"], {"REAL": 0.2}, "2024-01-02T03:04:05Z"), (None, None, "odd", None, "0.4", "x", None, None, None)]
    df = spark.createDataFrame(rows, "id string, title string, prediction string, confidence string, confidenceScore string, trustScore string, keywords array<string>, probabilities map<string,double>, analyzed_at string")
    one, two = sorted(ST.normal_analyses(df, "2024-05-06 07:08").collect(), key=lambda r: r.id != "A1")
    assert len(one) == 64
    assert (one.title, one.label, one.confidence, one.confidence_score, one.risk_level, one.trust_score, one.trust_level, one.keywords, one.date) == ("T", "FAKE", 82, 0.82, "HIGH", 70.0, "Moderate credibility", ["k"], "2024-01-02 03:04")
    assert json.loads(one.probabilities) == {"REAL": 0.2} and one.main_claims == [] and one.evidence is None
    assert (two.title, two.label, two.confidence, two.risk_level, two.trust_level, two.keywords, two.date) == ("Untitled Article", "UNCERTAIN", 40, "HIGH", "Low credibility", [], "2024-05-06 07:08") and two.id.startswith("AN-")


def test_search_and_validation(spark):
    df = spark.createDataFrame([(1, "REAL", "A b.c", ["x", "y"]), (2, "FAKE", "abc", [])], "id int, label string, text string, tags array<string>")
    assert [r.id for r in Q.search(df, ["text", "tags"], "B.C").collect()] == [1]
    assert [r.id for r in Q.search(df, ["text"], "", "false").collect()] == [2]
    assert Q.search(df, ["text"], "", "nonsense").count() == 0
    v = spark.createDataFrame([("notaurl", "short"), ("", "x" * 50)], "url string, text string")
    assert [len(r.errors) for r in Q.validated(v).collect()] == [1, 0]


def test_export(spark):
    df = spark.createDataFrame([(1, 'a "q", b', ["x", "y"])], "id int, t string, tags array<string>")
    assert EX.csv_lines(df, ["id", "t", "tags"]).first().line == '1,"a ""q"", b",x | y'


def test_datasets(spark, tmp_path):
    fake, true = tmp_path / "fake.csv", tmp_path / "true.csv"
    fake.write_text('title,text,subject,date\n"T, one","Body ""x""\nline two",news,d\n', encoding="utf-8-sig")
    true.write_text("title,text\nT2,Body2\n")
    got = {r.label: (r.title, r.text, r.source) for r in DS.read_articles(spark, str(fake), str(true)).collect()}
    assert got == {"FAKE": ("T, one", 'Body "x"\nline two', "Kaggle Fake and Real News | news | d"), "REAL": ("T2", "Body2", "Kaggle Fake and Real News")}
    with pytest.raises(ValueError):
        DS.read_csv(spark, str(true), ("title", "nope"))
    liar = tmp_path / "liar.tsv"
    liar.write_text("1.json\tpants-fire\tA claim. More\tsubj\tBob\tjob\tst\tgop\t0\t0\t0\t0\t0\ta speech\n2.json\todd\tx\n3.json\ttrue\tShort row\n")
    rows = DS.read_liar(spark, str(liar)).collect()
    assert [(r.label, r.title, r.source, r.dataset_type) for r in rows] == [("FAKE", "A claim.", "LIAR Dataset | Bob | gop | a speech", "claim"), ("REAL", "Short row", "LIAR Dataset", "claim")]
    fever = tmp_path / "fever.jsonl"
    lines = [
        {"claim": "C1", "label": "SUPPORTS", "evidence": [[[1, 2, "Wiki_Page", 0]]]},
        {"claim": "C2", "label": "REFUTES", "source": "S"},
        {"claim": "C3", "label": "x"},
        {"claim": "C4", "label": " nei ", "evidence": [[[1, 2, None, 0], {"title": "First"}], {"page": "Second"}]},
        {"claim": "C5", "label": "NOT ENOUGH INFO", "evidence": [{"page": "", "title": "T5"}, [[1, 2, "Later", 0]]]},
        {"claim": "C6", "label": "NEI", "evidence": [[[None, None, None, None]]]},
        {"claim": "", "label": "NEI", "evidence": "odd"},
    ]
    fever.write_text("\n\n".join(json.dumps(x) for x in lines) + "\n")
    want = {("C1", "REAL", "FEVER | Wiki_Page"), ("C2", "FAKE", "FEVER | S"), ("C4", "UNCERTAIN", "FEVER | First"), ("C5", "UNCERTAIN", "FEVER | T5"), ("C6", "UNCERTAIN", "FEVER"), ("", "UNCERTAIN", "FEVER")}
    rows = DS.read_fever(spark, str(fever)).collect()
    assert {(r.text, r.label, r.source) for r in rows} == want
    assert {r.title for r in rows if not r.text} == {"Untitled Record"} and {r.dataset_type for r in rows} == {"claim_verification"}
    both = DS.conform(spark.createDataFrame([("Same  text", "T", "true", "", "", 1), ("same text!", "t", "fake", "s", "", 2), ("", "", "fake", "s", "", 3), ("x", "y", "bad", "", "", 4)], "text string, title string, label string, source string, dataset_type string, pos int"))
    merged = DS.merge([both], "pos")
    assert [(r.pos, r.label, r.source) for r in merged.collect()] == [(1, "REAL", "Unknown source")]
    assert DS.deduplicate(merged, "pos").count() == merged.count()
    p = DS.profile(both, "pos").first()
    assert (p.n_rows, p.blank_texts, p.duplicates, p.warn_small) == (4, 1, 1, True)


def test_dataset_reports(spark):
    rows = [("the cat and the dog", "T", "REAL", 1), ("The cat, and the dog", "t", "REAL", 2), ("", "T3", "FAKE", 3), ("un deux", "", "FAKE", 4)]
    df = DS.conform(spark.createDataFrame([(x, t, k, "s", "claim", i) for x, t, k, i in rows], "text string, title string, label string, source string, dataset_type string, pos int"))
    r = DS.report(df, "pos", "small").first()
    assert (r.rows_before_cleaning, r.rows_after_cleaning, r.empty_text_rows, r.empty_title_rows, r.duplicate_rows) == (4, 2, 1, 1, 1)
    assert r.warnings == ["Removed 1 row(s) with empty text.", "Removed 1 duplicate row(s).", "small contains 2 cleaned row(s), which is below the recommended minimum of 50.", "More than 20% of rows could not be confidently identified as English."]
    d = {(x.stage, x.distribution, x.value): x.n for x in DS.distributions(df, "pos").collect()}
    assert d["before", "label", "FAKE"] == 2 and d["after", "label", "REAL"] == 1 and d["after", "dataset_type", "claim"] == 2 and d["after", "language", "unknown"] == 1
    final, said = DS.merge_report({"a": df, "b": None}, "pos", {"b": ["b.csv"]})
    assert final.count() == 2 and said["missing_datasets"] == ["b"] and said["datasets"]["b"]["expected_files"] == ["b.csv"] and said["final_dataset"]["rows_after_cleaning"] == 2
    assert DS.merge_report({"b": None}, "pos")[1]["status"] == "missing_datasets"
    assert spark.range(1).select(DS.combined_text(F.lit("A b"), F.lit("a B c")).alias("x"), DS.combined_text(F.lit("T"), F.lit("x")).alias("y")).first() == ("a B c", "T x")


def test_pages_and_totals(spark):
    df = spark.range(23)
    rows, info = Q.page_of(df, [F.col("id")], 3, 10)
    assert [r.id for r in rows.collect()] == [20, 21, 22] and info == {"page": 3, "size": 10, "total": 23, "pages": 3}
    assert {r.total for r in Q.with_total(df.limit(5)).collect()} == {5} and Q.page_of(df.limit(0), [F.col("id")], 1)[1]["pages"] == 1


def test_patterns_by_words_are_those_by_expressions(spark):
    texts = ["Shocking cover-up: coverup, cover up", "you wont believe; you won't believe", "secretary", "watch_this watch", "they don't want you to know", "must  see must see", ""]
    rows = spark.createDataFrame([(t.lower(),) for t in texts], "x string")
    for patterns in (L.CLICKBAIT, L.SENSATIONAL, L.EMOTIONAL, L.UNSUPPORTED, L.FAKE_PATTERNS, L.REAL_PATTERNS, L.CORPUS.sensational):
        for r in rows.select("x", X.patterns_present(F.col("x"), patterns).alias("n"), X.any_present(F.col("x"), patterns).alias("a")).collect():
            n = sum(bool(re.search(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])", r.x)) for p in patterns)
            assert (r.n, r.a) == (n, n > 0), (r.x, patterns)


def test_syllables_of_many_words_at_once(spark):
    words = ["the", "table", "hmmm", "tree", "Straße", "it's", "bubble-gum", "ée", "little", "a1b2", "queue", "rhythm", "SHE", "whole"]
    rows = spark.createDataFrame([(words[i : i + 5],) for i in range(10)], "ws array<string>")
    for r in rows.select(X.syllables_in(F.col("ws")).alias("n"), F.aggregate("ws", F.lit(0), lambda a, w: a + X.syllables(w)).alias("m")).collect():
        assert r.n == r.m


def test_split_has_no_row_twice(spark):
    rows = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(500)], "doc_id long, label string")
    got = M.split(rows, buckets=7).collect()
    assert len(got) == 500 and sum(r.in_train for r in got if r.label == "a") == 320 and sum(r.in_train for r in got if r.label == "b") == 80
    assert {r.doc_id for r in got if r.in_train} == {r.doc_id for r in M.split(rows.repartition(5), buckets=4096).collect() if r.in_train}


def test_life_cycle(spark, tmp_path):
    words = {"REAL": ["study", "report", "official"], "FAKE": ["hoax", "secret", "panic"]}
    rows = [(i, k, [words[k][i % 3], words[k][(i + 1) % 3], "news"]) for i in range(60) for k in [("REAL", "FAKE")[i % 2]]]
    records = M.split(spark.createDataFrame(rows, "doc_id long, label string, words array<string>"))
    cells = M.compare(records, ["FAKE", "REAL"])
    table = {r.id: r for r in M.comparison(cells, ["FAKE", "REAL"]).collect()}
    assert all(r.accuracy == 1.0 and r.n == 12 for r in table.values()) and [k for k, r in table.items() if r.best] == ["multinomial_naive_bayes"]
    payload = M.training_payload(cells, ["FAKE", "REAL"], "2026-01-02T03:04:05Z", {"total": 60, "train": 48, "test": 12})
    assert payload["report"]["confusion_matrix"] == {"FAKE": {"FAKE": 6, "REAL": 0}, "REAL": {"FAKE": 0, "REAL": 6}} and payload["card"]["model_version"] == "multinomial_naive_bayes-20260102-030405"
    report = {r.label: r for r in M.class_report(spark.createDataFrame([("FAKE", "FAKE", 3), ("FAKE", "REAL", 1), ("REAL", "REAL", 4)], "label string, predicted string, n long"), ["FAKE", "REAL"]).collect()}
    assert report["FAKE"].recall == 0.75 and report["REAL"].precision == 0.8 and report["weighted avg"].support == 8 and report["macro avg"].precision == 0.9
    train = records.where("in_train")
    idf = M.fit_tfidf(train)
    model = M.naive_bayes_weights(M.weigh(train, idf), train)
    M.save_naive_bayes(model, idf, str(tmp_path / "nb"))
    again, idf2 = M.load_naive_bayes(spark, str(tmp_path / "nb"))
    said = M.best_label(M.naive_bayes_scores(M.weigh(records, idf2), records, again))
    assert records.join(said, "doc_id").where("label <> predicted").count() == 0
    with pytest.raises(ValueError):
        M.compare(records.limit(5), ["FAKE", "REAL"])


def test_analysis_and_exports(spark):
    text = "Officials confirmed on Monday that the city council approved a budget of 20 million dollars for schools. " * 12
    rows = [(1, "City council approves budget", text, "reuters.com", "", "A. Writer", "2024-01-02"), (2, "SHOCKING hoax EXPOSED!!!", "You won't believe this secret hoax!!! Panic and chaos, terrifying betrayal!! " * 6, "", "http://newspunch.com/x", "", ""), (3, "t", "short", "", "", "", ""), (4, None, "function( window. webpack push( {};{};{};" * 5, None, None, None, None)]
    articles = A.requests(spark.createDataFrame(rows, "doc_id int, title string, text string, source string, url string, author string, published string"))
    assert {r.doc_id: r.error is None for r in articles.collect()} == {1: True, 2: True, 3: False, 4: False}
    corpus = spark.createDataFrame([(1, "City council approves budget for schools", text, "apnews.com")], "item_id int, title string, text string, source string")
    got = A.analyze(articles, corpus, R.registry(spark)).cache()
    r = {x.doc_id: x for x in got.collect()}
    assert set(r) == {1, 2} and r[1].trust_score > r[2].trust_score and r[1].badge == "Trusted" and r[2].badge == "Suspicious"
    assert r[1].n_evidence > 0 and r[1].trusted_sources == ["apnews.com"] and r[2].n_evidence == 0
    assert r[1].recommendation.endswith("Review the evidence report before sharing the article.") and "Detected language: English" in r[1].explanation
    assert r[2].trust_explanation.startswith(f"Trust Score {r[2].trust_score}/100 indicates {r[2].trust_level.lower()}. Reasons: ")
    history = EX.history_columns(got, "2024-02-01 00:00")
    assert history.columns[1:] == list(EX.HISTORY_COLUMNS.values()) and len(EX.HISTORY_COLUMNS) == 35 and len(EX.ANALYSIS_COLUMNS) == 50
    assert EX.csv_lines(history, list(EX.HISTORY_COLUMNS.values())).count() == 2
    assert EX.analysis_columns(got, "2024-02-01 00:00").columns[1:] == list(EX.ANALYSIS_COLUMNS.values())
    report = EX.history_report(history, "2024-02-01 00:00", "Brand")
    assert report["summary"]["total"] == 2 and len(report["sections"]) == 4 and report["summary"]["evidence_backed"] == 1
    packed = json.loads(EX.analysis_report(got, "2024-02-01 00:00").where("doc_id = 1").first().report)
    assert packed["highlights"]["trustScore"] == r[1].trust_score and packed["analysis"]["title"] == "City council approves budget"
    assert A.analyze(articles.where("false"), corpus, R.registry(spark)).count() == 0


def test_classifiers(spark):
    rows = [(i, "FAKE" if i % 2 else "REAL", "scandal rumour gossip claim".split() if i % 2 else "report study official data".split()) for i in range(40)]
    df = M.split(spark.createDataFrame(rows, "doc_id int, label string, words array<string>"))
    assert df.where("in_train").count() == 32
    train, test = df.where("in_train"), df.where("NOT in_train")
    predicted = test.join(M.naive_bayes_predict(test, M.naive_bayes_counts(train), train), "doc_id")
    m = M.metrics(M.confusion(predicted), ["FAKE", "REAL"]).first()
    assert (m.n, m.accuracy, m.f1) == (8, 1.0, 1.0)
    w = M.tfidf(df).groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).agg(F.max("s"), F.min("s")).first()
    assert abs(w[0] - 1) < 1e-9 and abs(w[1] - 1) < 1e-9
    s = spark.range(1).select(M.softmax(F.array(F.lit(1.0), F.lit(1.0)))).first()[0]
    assert s == [0.5, 0.5]
    assert M.version("nb", "2026-07-06T20:14:01Z") == "nb-20260706-201401"


def test_stemmed_vocabulary_reads_every_language(spark, tmp_path):
    texts = [("The studies were published, 2024 reports https://x.example/running", "en"), ("Les études publiées étaient répétées", "fr"), ("Die Straßen führten über Brücken", "de"), ("Los niños publicaban estudios", "es"), ("Published studies of rows without language", None), (None, "en"), (None, None), ("", "fr")]
    spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for t, _ in texts:
        plain = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
        for w in re.sub(r"[^a-z0-9\s]", " ", re.sub(r"https?://\S+", " ", plain)).split():
            stem = M.Porter().stem(w)
            if len(w) >= 3 and w not in M.STOP and not w.isdigit() and len(stem) >= 3 and stem not in M.STOP:
                want[stem] += 1
    got = data_queries.stemmed_vocabulary(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.stem: r.n for r in got} == want


def test_stems_are_made_of_counted_words(spark):
    """Stems were made of an expression with nested lambdas, out of which Spark doesn't take Python, so that the query failed."""
    rows = [(1, "The studies were published, published 2024 https://x.example/running"), (2, None), (3, ""), (4, "The of 7 buses ously"), (5, "Die Straßen führten"), (6, "studying thes")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.stem_counts(df, F.col("text"))
    assert got.dtypes == [("stem", "string"), ("n", "bigint")]
    assert {r.stem: r.n for r in got.collect()} == {"studi": 2, "publish": 2, "buse": 1, "ousli": 1, "die": 1, "straen": 1, "fuhrten": 1}
    assert [r.s for r in spark.createDataFrame([(["thes", "buses", "ies"],), ([],)], "w array<string>").select(M.stem(F.col("w"), 3, ["the"]).alias("s")).collect()] == [["buse"], []]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.coalesce(1).write.parquet(str(source / "x"))
    stream = logs.read_events(spark, str(source / "x"), "*.parquet")
    logs.append(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
    logs.keep_newest(stream, str(tmp_path / "new"), str(tmp_path / "c2"), 25).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "new" / "0"))
    assert kept.count() == 25 and kept.agg(F.max("ts")).first()[0] == rows.select(F.max(F.col("ts").cast("timestamp"))).first()[0]
    q = logs.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == rows.count()


def test_lexicons_are_whole():
    assert len(L.REGISTRY) == 22 and len(L.STOP_WORDS) == 49 and len(L.CONTENT_STOP_WORDS) == 55
