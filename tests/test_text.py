from pyspark.sql import functions as F

from factloom.functions import labels as B
from factloom.functions import text as X
from factloom.operators.ml import Porter


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(column(F.col("x"))).collect()]


def test_tokens_keep_letters_apostrophes_and_hyphens(spark):
    assert values(spark, X.tokens, "Don't STOP — the co-op, élu! https://a.b/c 42%") == [["don't", "stop", "the", "co-op", "élu", "42"]]
    assert values(spark, X.tokens, "", None, "   ") == [[], [], []]


def test_sentences(spark):
    assert values(spark, X.sentences, "One two.  Three! Four?\nFive") == [["One two.", "Three!", "Four?", "Five"]]


def test_rounding_is_half_up(spark):
    row = spark.range(1).select(X.js_round(F.lit(-2.5)), X.js_round(F.lit(2.5)), X.js_round(F.lit(0.12345), 3)).first()
    assert tuple(row) == (-2, 3, 0.123)


def test_word_boundaries_are_ascii(spark):
    assert values(spark, lambda c: X.occurrences(F.lower(c), "lu"), "élu lu", "lu_ lu") == [2, 1]


def test_syllables(spark):
    assert values(spark, X.syllables, "cat", "table", "make", "reading", "", "the", "queue") == [1, 2, 1, 2, 0, 1, 1]


def test_entities_decode_twice(spark):
    assert values(spark, X.decode_entities, "&amp;lt;b&gt; &quot;a&#39;s &#65;&#x42;") == ["<b> \"a's AB"]


def test_normal_text_folds_accents(spark):
    assert values(spark, X.normal_text, "Élan ñandú — https://x.y z, É!") == ["elan nandu z e"]


def test_labels(spark):
    assert values(spark, B.result_label, "true", "False", "satire", None) == ["REAL", "FAKE", "UNCERTAIN", "UNCERTAIN"]
    assert values(spark, B.training_label, "SUPPORTS", "refuted", "half-true", "other") == ["REAL", "FAKE", "UNCERTAIN", None]
    assert values(spark, B.article_label, "fake", "", "x") == ["FAKE", "REAL", "REAL"]


def test_hosts(spark):
    assert values(spark, B.domain, "https://www.BBC.com/a", "reuters.com", "two words", "", None) == ["bbc.com", "reuters.com", "", "", ""]
    assert values(spark, B.suspicious_host, "daily-truth.com", "example.com", "a.xyz") == [True, False, True]


def test_script_and_dates(spark):
    assert values(spark, X.looks_like_script, "window.x = function(y) {};", "A plain sentence about headers.") == [True, False]
    assert values(spark, X.date_candidates, "On 2024-01-02 and March 3, 2024 or 4/5/2024, 2024-01-02.") == [["2024-01-02", "March 3, 2024", "4/5/2024"]]


def test_porter():
    stem = Porter().stem
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "adoption": "adopt", "controlling": "control", "rate": "rate", "cease": "ceas"}
    assert {w: stem(w) for w in pairs} == pairs
