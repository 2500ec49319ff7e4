"""Costly expressions and tables are computed once: plans are read, nothing is timed."""

import re
import unicodedata

from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.functions import text as X
from factloom.operators import evidence as E
from factloom.operators import intelligence as I
from factloom.operators import ml as M
from factloom.plans import data_queries as D
from factloom.sources import datasets as DS

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keyword_array_makes_its_words_once(spark):
    """They were made anew for each distinct word of the text."""
    df = spark.createDataFrame([("red green red blue1 blue1 red",), (None,), ("",)], "t string")
    out = df.select(I.keyword_array(F.col("t"), 2).alias("k"))
    assert plan(out).count("https?") == 1
    assert [r.k for r in out.collect()] == [["blue1", "green"], [], []]


def test_sentences_are_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "One. Two!"), (2, None), (3, "")], "doc_id long, text string").withColumn("title", F.lit("a title"))
    for out in (I.suspicious_sentences(I.prepare(docs)), I.keywords(docs), I.key_phrases(I.prepare(docs))):
        assert not [line for line in plan(out).splitlines() if re.search(r"Filter \(*size\(", line)]  # a plain explode asks for the size first
        assert {r.doc_id for r in out.collect()} <= {1}


def test_grams_are_made_once(spark):
    docs = spark.createDataFrame([(1, "x", ["aaa", "bbb"]), (2, "y", []), (3, "y", None)], "doc_id long, label string, words array<string>")
    assert plan(M.naive_bayes_counts(docs).select("n")).count("zip_with") == plan(docs.select(F.explode_outer(M.grams("words")))).count("zip_with") * plan(M.naive_bayes_counts(docs).select("n")).count("Generate")
    assert {r.term for r in M.naive_bayes_counts(docs).collect()} == {"aaa", "bbb", "aaa bbb"}
    assert M.fit_tfidf(docs, 1).count() == 3


def test_claims_matches_and_training_rows_are_written(spark):
    """What reads them several times reads a table, not the texts."""
    text = "The first sentence of this article is about 12 red houses and 14 trees in Old Town. Another is short."
    docs = I.prepare(spark.createDataFrame([(1, "Red houses in Old Town", text)], "doc_id long, title string, text string"))
    claims = E.main_claims(docs)
    found = E.match_evidence(claims, spark.createDataFrame([(7, "Red houses in Old Town", text)], "item_id long, title string, text string"))
    assert all("LogicalRDD" not in plan(df) and "regexp" not in plan(df) for df in (claims, found, D._training(spark, DIR)))
    assert found.count() == claims.count() >= 1


def test_sentences_words_are_made_once_for_all_lists(spark):
    """Each list of words lowered and split every sentence anew."""
    df = I.prepare(spark.createDataFrame([("He said that is so. FROM the idiot!! Plain.",), (None,)], "text string"))
    out = I.count_suspicious(df, L.CORPUS)
    made = out.select(F.size(F.filter("sents", lambda s: I._suspicious(s, L.CORPUS))))._jdf.queryExecution().analyzed().expressions().toString()
    assert made.count("lower(") == 1
    assert [r.n_suspicious for r in out.collect()] == [2, 0]


def test_words_are_folded_together(spark):
    """Every word was lowered by itself, and white space was matched against ten ranges for each letter."""
    df = spark.createDataFrame([("\u039f\u0394\u039f\u03a3 X\u3000Y\u00a0 Z\tW  \u0130s ",)], "text string")
    out = df.select(X.tokens(F.col("text")).alias("t"), X.collapse(F.col("text")).alias("c"))
    assert "lambda lower" not in plan(out).replace("lambdafunction(", "lambda ") and r"[\s" not in plan(out.select("c"))
    assert out.first() == (["\u03bf\u03b4\u03bf\u03c2", "x", "y", "z", "w", "i\u0307s"], "\u039f\u0394\u039f\u03a3 X Y Z W \u0130s")


def test_folding_holds_no_map_of_literals(spark):
    """A map of 445 pairs was planned and rewritten by every rule."""
    texts = ["\u00c4pfel & \ufb01ne \u00bd stra\u00dfe \u4e2d", "".join(map(chr, range(0xC0, 0x180))), "plain", None, "http://\u00e9.x y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = df.select(X.normal_text(F.col("text")).alias("t"))
    assert not re.search(r"\bmap\(", out._jdf.queryExecution().analyzed().expressions().toString())
    want = [re.sub("[^a-z0-9]+", " ", re.sub(r"https?://\S+", " ", unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower())).strip() for t in texts]
    assert [r.t for r in out.collect()] == want


def test_occurrences_of_lists_are_those_of_their_words(spark):
    df = spark.createDataFrame([("we can't do it, we do_it; do it",), ("",)], "x string")
    phrases = ["we", "do", "can't", "do it", "we"]
    one = sum((X.occurrences(F.col("x"), p) for p in phrases), F.lit(0))
    assert [tuple(r) for r in df.select(one, X.occurrences_of(F.col("x"), phrases, X.ascii_words(F.col("x")))).collect()] == [(9, 9), (0, 0)]


def test_claims_score_a_sentence_once(spark, monkeypatch):
    """A filter on the points was pushed below them, so that each sentence was scored twice, and all that passed it met a window."""
    seen = []
    monkeypatch.setattr(E, "written", lambda df, tag: seen.append(df) or df)
    text = " ".join(f"Sentence number {i} is about {i * 7} red houses in the Old Town of Rome." for i in range(9))
    docs = I.prepare(spark.createDataFrame([(1, "Red houses in Old Town", text), (1, "Red houses in Old Town", text), (2, None, None)], "doc_id long, title string, text string"))
    out = E.main_claims(docs)
    assert plan(seen[0]).count("(?=[A-Z])") == 1
    assert [(r.doc_id, r.claim_no, r.claim[:17]) for r in out.orderBy("doc_id", "claim_no").collect()] == [(1, 1, "Red houses in Old"), (1, 2, "Sentence number 0"), (1, 3, "Sentence number 1")]


def test_passes_over_few_rows_take_few_tasks(spark):
    """Each task of each pass sends a gradient as long as the vocabulary, whatever few rows it has; vectors were cached, terms weighed anew for each reader."""
    rows = spark.range(40).repartition(9)
    assert M.gathered(rows, 40).rdd.getNumPartitions() == 1 and M.gathered(rows, 40).count() == 40
    assert M.gathered(rows, 3 * M.PASS_ENTRIES).rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    docs = spark.createDataFrame([(1, ["aaa", "bbb"]), (2, ["aaa", "bbb", "aaa"]), (3, []), (4, None)], "doc_id long, words array<string>")
    idf = M.fit_tfidf(docs, 2)
    got = {r.doc_id: r.features for r in M.vectors(M.weigh(docs, idf), idf, docs.select("doc_id"))[0].collect()}
    place = {r.term: r.place for r in M.places(idf).collect()}
    want = {(r.doc_id, place[r.term]): r.weight for r in M.weigh(docs, idf).collect()}
    assert {(d, int(i)): float(v[int(i)]) for d, v in got.items() for i in v.indices} == want and {v.size for v in got.values()} == {3}


def test_records_move_as_digests(spark):
    """Texts went through the join with the labels and through the deduplication's shuffle, once for each part of a merge, and were collapsed two times."""
    narrow = D.records(spark, DIR)
    assert not {"text", "title"} & set(narrow.columns)
    assert plan(narrow.select("_key")).count(r"[\t-\r]") == 1
    for query in (D.dedupe_exact, D.merge_datasets, D.dataset_profile):
        moved = re.findall(r"Exchange.*", query(spark, DIR)._jdf.queryExecution().executedPlan().toString())
        assert moved and not re.search(r"\b(text|title)#", " ".join(moved))


def test_digested_records_give_what_whole_ones_give(spark):
    rows = [("a b", "T", "REAL", 1), ("A  b!", "t", "FAKE", 2), ("", "T", "FAKE", 3), (" ", "", "REAL", 4), ("the and of", "x", "odd", 5), ("the and of", "x", None, 6), ("the and of", "X", "UNCERTAIN", 7)]
    whole = DS.conform(spark.createDataFrame([(x, t, k, "s", "claim", i) for x, t, k, i in rows], "text string, title string, label string, source string, dataset_type string, pos int"))
    narrow = DS.digested(whole)
    assert DS.profile(narrow, "pos").first() == DS.profile(whole, "pos").first()
    for f in (lambda df: DS.deduplicate(df, "pos"), lambda df: DS.merge([df.where("pos < 3"), df.where("pos > 2")], "pos")):
        want = sorted((r.pos, r.label, r.source) for r in f(whole).collect())
        assert sorted((r.pos, r.label, r.source) for r in f(narrow).collect()) == want and len(want) >= 2
