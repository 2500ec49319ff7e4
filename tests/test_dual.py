"""The solver over rows against dense arrays."""

import numpy as np
import pytest

from factloom.operators import dual as DU
from factloom.operators import ml as M
from tests.test_linear import N, TERMS, data


@pytest.mark.parametrize(("kind", "penalised"), [("log", False), ("squared_hinge", True)])
def test_margins_are_where_the_gradient_is_nought(spark, monkeypatch, kind, penalised):
    """Two parts that learn from other rows, and one from none; margins of all rows; small blocks, sums made by executors."""
    monkeypatch.setattr(DU, "BLOCK", 25)
    x, label = data(1, 2)
    y = np.where(label == 1, 1.0, -1.0)
    costs = np.array([*[np.where(np.arange(N) % 3 == p, 0.0, 1.0 + (label == 0)) for p in (0, 1)], np.zeros(N)])
    entries = spark.createDataFrame([(f"t{j}", i, float(x[i, j])) for i in range(N) for j in range(TERMS) if x[i, j]], "term string, place long, weight double").repartition(3)
    gram = DU.Gram(entries, N, entries.count())
    a = np.random.default_rng(0).normal(size=(4, N))
    assert gram.blocks.count() > 1 and np.abs(gram.product(a) - a @ x @ x.T).max() < 1e-9
    margins, left = DU.solve(gram, np.arange(N), y, costs, kind, penalised, tolerance=1e-6)
    assert max(left[:2]) <= 1e-6 and not margins[2].any()
    for p in (0, 1):
        n, z = (costs[p] > 0).sum(), y * margins[p]
        slopes = costs[p] / n * y * (-1 / (1 + np.exp(z)) if kind == "log" else -2 * np.maximum(1 - z, 0))
        rest = margins[p] + n * (x @ x.T @ slopes)  # where the gradient is nought, the intercept is left
        assert np.ptp(rest) < 1e-2 and abs(slopes.sum() + (rest.mean() / n if penalised else 0)) < 1e-4


def test_two_labels_need_no_vector_as_long_as_the_vocabulary(spark, monkeypatch):
    """Each candidate was fitted with one coefficient a term on the driver."""
    monkeypatch.setattr(M, "vectors", None)
    words = {"REAL": ["study", "report", "official"], "FAKE": ["hoax", "secret", "panic"]}
    rows = [(i, k, [words[k][i % 3], words[k][(i + 1) % 3], "news"] if i < 55 else []) for i in range(60) for k in [("REAL", "FAKE")[i % 2]]]
    cells = M.compare(M.split(spark.createDataFrame(rows, "doc_id long, label string, words array<string>")), ["FAKE", "REAL"], kinds=("logistic_regression", "linear_svm"))
    for c in cells.values():
        got = c.collect()
        assert sum(r.n for r in got) == 12 and sum(r.n for r in got if r.label == r.predicted) >= 10
