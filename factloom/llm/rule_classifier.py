"""Quality classifier: a sparse ensemble of rules.

A bounded sample of labelled rows (at most ``FIT_ROWS``, chosen by a hash of the
id) grows boosted trees over text statistics.  Each path of a tree is
a conjunction of conditions, a rule.  A lasso logistic regression weighs the
rules, most of which get no weight; those left are compiled to one Spark column
expression, so documents are scored without Python workers and without moving.

Labels, language, source and id are no inputs of a score.  Defined results: a
null text counts as empty and is scored by the rules it meets; null labels are
passed over; with no labels, or one class, every score is the smoothed share of
class 1 (0.5 without labels); repeated rows each get a row; an empty table gives
an empty result; other columns stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of_id, materialise, text_or_empty
from .text_stats import text_stats

#: Rows that the fit reads at most: the sample's bound.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
PENALTY, STEPS = 0.0005, 400
THRESHOLD = 0.3


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / greatest({b}, 1)"


#: The statistics (SQL) that rules are made of.
FEATURES: dict[str, str] = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": _ratio("word_chars", "n_words"),
    "line_words": _ratio("n_words", "n_lines"),
    "distinct": _ratio("n_distinct", "n_words"),
    "symbols": _ratio("n_symbols", "word_chars"),
    "capitals": _ratio("n_upper", "word_chars"),
    "digits": _ratio("n_digits", "word_chars"),
    "marks": _ratio("n_marks", "n_words"),
    "shouts": _ratio("n_shouts", "n_words"),
    "bars": _ratio("n_bars", "n_words"),
    "dup_lines": _ratio("n_dup_lines", "n_lines"),
    "repeats": _ratio("n_repeat_words", "n_words"),
}


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, at most, bound): feature <= bound, or > bound."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, bound in self.terms:
            c = F.col(name)
            out = out & (c <= bound if at_most else c > bound)
        return out


@dataclass
class Model:
    base: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        z = F.lit(self.base)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, depth: int, terms: tuple, out: list, step: np.ndarray) -> None:
    """Newton trees on binned features; ``out`` gets every path, ``step`` the leaves' values."""
    g, h = residual[rows].sum(), weight[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for f in range(x.shape[1]):
            n = len(edges[f])
            if not n:
                continue
            gs = np.cumsum(np.bincount(x[rows, f], residual[rows], n + 1))[:-1]
            hs = np.cumsum(np.bincount(x[rows, f], weight[rows], n + 1))[:-1]
            ns = np.cumsum(np.bincount(x[rows, f], minlength=n + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < 5) | (len(rows) - ns < 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    if terms:
        out.append(terms)
    if best[1] is None:
        step[rows] = g / (h + 1)
        return
    _, f, k = best
    left = x[rows, f] <= k
    for side, at_most in ((rows[left], True), (rows[~left], False)):
        _grow(x, residual, weight, edges, side, depth - 1, (*terms, (f, at_most, float(edges[f][k]))), out, step)


def _simplified(terms: tuple, names: list[str]) -> Rule:
    bounds: dict[tuple, float] = {}
    for f, at_most, bound in terms:
        old = bounds.get((f, at_most), bound)
        bounds[f, at_most] = min(old, bound) if at_most else max(old, bound)
    return Rule(tuple((names[f], at_most, b) for (f, at_most), b in sorted(bounds.items())))


def fit(features: np.ndarray, labels: np.ndarray, names: list[str]) -> Model:
    """Trees, rules, lasso; deterministic."""
    n, y = len(labels), labels.astype(float)
    share = (y.sum() + 1) / (n + 2)
    base = math.log(share / (1 - share))
    if n < 20 or y.min() == y.max():
        return Model(base, [])
    edges = [np.unique(np.quantile(features[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(features.shape[1])]
    binned = np.stack([np.searchsorted(e, features[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rng = np.random.default_rng(5)
    z, paths = np.full(n, base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(n)
        rows = np.flatnonzero(rng.random(n) < 0.7)
        grown: list[tuple] = []
        _grow(binned, y - p, p * (1 - p), edges, rows, DEPTH, (), grown, step)
        paths += grown
        z = z + RATE * step
    rules = list(dict.fromkeys(_simplified(t, names) for t in paths))
    at = {name: i for i, name in enumerate(names)}
    seen = np.ones((n, len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for name, at_most, bound in rule.terms:
            v = features[:, at[name]]
            seen[:, j] *= (v <= bound) if at_most else (v > bound)
    distinct = {seen[:, j].tobytes(): j for j in reversed(range(len(rules)))}
    keep = sorted(j for j in distinct.values() if 0 < seen[:, j].sum() < n)
    rules, seen = [rules[j] for j in keep], seen[:, keep]
    weights, bias = _lasso(seen, y, base)
    return Model(bias, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4])


def _lasso(x: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the constant isn't penalised."""
    n, m = x.shape
    x = np.concatenate([x, np.ones((n, 1), np.float32)], axis=1)
    v = np.ones(m + 1, np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(np.linalg.norm(x.T @ (x @ v)) * 1.05)
    w = np.zeros(m + 1)
    w[-1] = bias
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ ahead.astype(np.float32))))
        new = ahead - rate * (x.T @ (p - y.astype(np.float32))).astype(float) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * PENALTY, 0)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:-1], float(w[-1])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    raw = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    stats = raw.select("doc_id", *text_stats("_text")).select("*", "st.*").drop("st")
    return stats.select("doc_id", *[F.expr(c).alias(name) for name, c in FEATURES.items()])


def fit_ids(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, quality: about twice the labelled rows that the fit takes, none of them held out; where an id has several, the lowest counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(bucket_of_id() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, 2 * rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= share * 1_000_000)


def train(features: DataFrame, near: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Of the rows of ``near`` (``fit_ids``), those first by a hash."""
    sample = features.join(near, "doc_id").orderBy(F.xxhash64(F.lit(9), F.col("doc_id")), "doc_id", *FEATURES).limit(rows)
    got = sample.select("quality", *FEATURES).collect()
    values = np.array([r[1:] for r in got], float).reshape(-1, len(FEATURES))
    return fit(values, np.array([r[0] for r in got], int), list(FEATURES))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    features = materialise(feature_table(docs), "features")
    model = train(features, fit_ids(labels, rows), rows)
    scored = features.select("doc_id", (bucket_of_id() == 0).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns; texts don't move.

    Statistics are computed for the rows of the fit first, a bounded number, and
    for all rows in the one pass that scores them.
    """
    near = F.broadcast(materialise(fit_ids(labels, rows), "fit"))  # some 2 * FIT_ROWS ids
    model = train(feature_table(docs.join(near.select("doc_id"), "doc_id", "left_semi")), near, rows)
    raw = docs.select(F.struct(*docs.columns).alias("_row"), text_or_empty("text").alias("_text"))
    stats = raw.select("_row", *text_stats("_text")).select("*", "st.*").drop("st")
    scored = stats.select("_row", *[F.expr(c).alias(name) for name, c in FEATURES.items()]).where(model.score() >= threshold)
    return scored.select("_row.*")
