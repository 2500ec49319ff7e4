"""Models as tables, their registry, inference, retraining; candidate pairs of evidence."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import evidence as E
from factloom.operators import ml as M
from factloom.operators import models as MO

LABELS = ["FAKE", "REAL"]


def rows(n, labels, seed=3):
    r = random.Random(seed)
    own = {k: [f"{k.lower()}{j}" for j in range(12)] for k in labels}
    both = [f"word{j}" for j in range(40)]
    return [(i, labels[i % len(labels)], [r.choice(own[labels[i % len(labels)]] if r.random() < 0.3 else both) for _ in range(r.choice([6, 30, 40]))]) for i in range(n)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(rows(90, LABELS), "doc_id long, label string, words array<string>").repartition(3).cache()


def plain_weights(words, idf):
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    raw = {t: (1 + math.log(grams.count(t))) * idf[t] for t in set(grams) if t in idf}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {t: v / norm for t, v in raw.items()}


@pytest.mark.parametrize("kind", list(M.CANDIDATES))
def test_candidates_round_trip_and_score_as_plain_python(spark, records, tmp_path, kind):
    model = MO.fit(kind, records, LABELS)
    root = str(tmp_path / "models")
    assert MO.publish(model, root, "2024-02-03T04:05:06Z") == f"{kind}-20240203-040506"
    loaded = MO.load(spark, root)
    assert loaded.card["model_id"] == kind and loaded.link == model.link
    idf = {r.term: r.idf for r in loaded.idf.collect()}
    heads = [r.asDict() for r in loaded.labels.collect()]
    terms = {(r.part, r.label, r.term): r.coefficient for r in loaded.terms.collect()}
    got = {r.doc_id: r for r in MO.infer(records, loaded).collect()}
    assert len(got) == records.count()
    right = 0
    for r in records.collect():
        w = plain_weights(r.words, idf)
        mean = dict.fromkeys(LABELS, 0.0)
        parts = {h["part"] for h in heads}
        for part in parts:
            score = {h["label"]: h["offset"] + h["scale"] * sum(x * (h["unseen"] + terms.get((part, h["label"], t), 0.0)) for t, x in w.items()) for h in heads if h["part"] == part}
            p = {k: math.exp(v) if loaded.link == "softmax" else 1 / (1 + math.exp(-v)) for k, v in score.items()}
            for k in p:
                mean[k] += p[k] / sum(p.values()) / len(parts)
        q = got[r.doc_id]
        assert all(abs(q.probabilities[k] - mean[k]) < 1e-4 for k in LABELS)
        best = max(mean, key=mean.get)
        assert q.predicted_label == best
        sure = len(r.words) >= 25 and mean[best] >= 0.72 and abs(mean["REAL"] - mean["FAKE"]) >= 0.06
        assert q.label == (best if sure else "UNCERTAIN") and (q.warning == "") == sure
        assert q.n_tokens == len(r.words) and 0 < len(q.keywords) <= 8
        weights = [k.weight for k in q.keywords]
        assert weights == sorted(weights, reverse=True)
        right += best == r.label
    assert right >= 80


def test_linear_tables_equal_the_fitted_model(spark, records):
    """The table's scores are those of the solver's own transform."""
    from pyspark.ml.functions import vector_to_array

    idf = M.fit_tfidf(records)
    model = MO.fit("logistic_regression", records, LABELS)
    vectors, _ = M.vectors(M.weigh(records, idf), idf, records.withColumn("y", (F.col("label") == "REAL").cast("double")).select("doc_id", "label", "y"))
    own = M.linear_model("lr", M.balanced(vectors)).transform(vectors).select("doc_id", vector_to_array("probability")[1].alias("p"))
    table = MO.probabilities(M.weigh(records, model.idf), records, model).where("label = 'REAL'")
    worst = own.join(table, "doc_id").agg(F.max(F.abs(F.col("p") - F.col("probability")))).first()[0]
    assert worst < 1e-6


def test_three_labels_are_calibrated(spark):
    labels = ["FAKE", "REAL", "UNCERTAIN"]
    three = spark.createDataFrame(rows(120, labels), "doc_id long, label string, words array<string>")
    for kind in ("linear_svm", "multinomial_naive_bayes"):
        out = MO.infer(three, MO.fit(kind, three, labels)).join(three.select("doc_id", F.col("label").alias("truth")), "doc_id").collect()
        assert all(abs(sum(r.probabilities.values()) - 1) < 1e-3 for r in out)
        assert sum(r.predicted_label == r.truth for r in out) > 95
        assert all(r.warning in ("", MO.AMBIGUOUS, MO.TOO_SHORT, MO.TOO_CLOSE, MO.BELOW.format(percent=72)) for r in out)
        assert all(r.warning == MO.AMBIGUOUS for r in out if r.predicted_label == "UNCERTAIN" and r.n_tokens >= 25)


def test_registry_falls_back_and_stays_on_the_old_version(spark, records, tmp_path):
    root = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        MO.load(spark, root)
    model = MO.fit("multinomial_naive_bayes", records, LABELS)
    first = MO.publish(model, root, "2024-01-01T00:00:00Z")
    second = MO.publish(model, root, "2024-01-02T00:00:00Z")
    third = MO.publish(model, root, "2024-01-03T00:00:00Z", current=False)
    assert MO.load(spark, root).card["model_version"] == second
    assert MO.load(spark, root, third).card["model_version"] == third
    (tmp_path / "models" / "versions" / second / "terms").rename(tmp_path / "lost")
    assert MO.load(spark, root).card["model_version"] == first
    MO.choose(spark, root, third)
    assert MO.load(spark, root).card["model_version"] == third


def test_texts_without_known_terms(spark, records):
    model = MO.fit("multinomial_naive_bayes", records, LABELS)
    odd = spark.createDataFrame([(1, []), (2, ["zz", "yy", "zz"]), (3, ["zz"] * 30)], "doc_id long, words array<string>")
    got = {r.doc_id: r for r in MO.infer(odd, model).collect()}
    assert got[1].keywords == [] and got[1].label == "UNCERTAIN" and got[1].warning == MO.TOO_SHORT
    assert [(k.term, k.weight, k.direction) for k in got[2].keywords] == [("zz", 0.85, "supports"), ("yy", 0.78, "supports")]
    assert got[3].n_tokens == 30 and got[3].warning in (MO.BELOW.format(percent=72), MO.TOO_CLOSE)
    assert MO.infer(odd.where("false"), model).count() == 0


def test_retrain_publishes_all_and_evaluate_only_nothing(spark, records, tmp_path):
    root = tmp_path / "models"
    kinds = ("multinomial_naive_bayes", "logistic_regression")
    report = MO.retrain(records, LABELS, str(root), "2024-01-01T00:00:00Z", kinds=kinds, evaluate_only=True)
    assert report["published"] == {} and not root.exists() and set(report["models"]) == set(kinds)
    done = MO.retrain(records, LABELS, str(root), "2024-01-01T00:00:00Z", kinds=kinds)
    assert done["report"] == report["report"] and set(done["published"]) == set(kinds)
    held = MO.load(spark, str(root))
    assert held.card["model_id"] == done["best"] and held.card["metrics"]["f1"] == done["models"][done["best"]]["f1"]
    with pytest.raises(ValueError):
        MO.retrain(records.limit(5), LABELS, str(root), "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_sided_filter_loses_no_pair(spark, seed):
    """Random token sets with frequent and rare tokens: all pairs with a similarity at its floor are candidates, and few others."""
    r = random.Random(seed)
    frequent, rare = [f"f{k}" for k in range(8)], [f"r{k}" for k in range(150)]
    draw = lambda n: {r.choice(frequent if r.random() < 0.4 else rare) for _ in range(n)}
    claims = {i: {"t": draw(r.randint(0, 8)), "c": draw(r.randint(1, 20)), "k": draw(r.randint(0, 10))} for i in range(60)}
    items = {i: {"t": draw(r.randint(0, 8)), "c": draw(r.randint(1, 60)), "k": draw(r.randint(0, 12))} for i in range(80)}
    floors = {"t": 0.3, "c": 0.25, "k": 0.2}
    flat = lambda sets: [(i, k, x) for i, by in sets.items() for k, s in by.items() for x in s]
    left = spark.createDataFrame(flat(claims), "doc_id long, kind string, token string").withColumn("claim_no", F.lit(1))
    right = spark.createDataFrame(flat(items), "item_id long, kind string, token string")
    got = {(x.doc_id, x.item_id) for x in E.candidate_pairs(left, right, "doc_id", floors).collect()}

    def over(a, b, kind):
        both = len(a & b)
        return both and both / (len(a) if kind == "k" else len(a | b)) >= floors[kind]

    want = {(i, j) for i, a in claims.items() for j, b in items.items() if any(over(a[k], b[k], k) for k in "tck")}
    assert want and want <= got
    shares = sum(any(claims[i][k] & items[j][k] for k in "tck") for i in claims for j in items)
    assert len(got) < shares


def test_floors_that_lose_pairs_are_refused(spark):
    with pytest.raises(ValueError):
        E.match_evidence(spark.range(0), spark.range(0), floors={"t": 0.5, "c": 0.5, "k": 0.5})
