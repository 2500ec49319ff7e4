"""The solver over tables against a plain one on dense arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import linear as LI

N, TERMS = 60, 9


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Many small passes: one task a stage, plans as they are."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def data(seed, outs):
    r = random.Random(seed)
    x = np.zeros((N, TERMS))
    label = np.zeros(N, dtype=int)
    for i in range(N):
        label[i] = r.randrange(outs)
        if i % 20 == 7:
            continue  # a document without terms
        for j in {r.randrange(TERMS) for _ in range(4)} | ({label[i]} if r.random() < 0.6 else set()):
            x[i, j] = r.uniform(0.2, 1)
    return x, label


def tables(spark, x, goals, outs):
    points = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(N) for j in range(TERMS) if x[i, j]], "doc_id long, term string, weight double")
    columns = ", ".join(f"y{k} double, c{k} double" for k in range(outs))
    return points.repartition(3), spark.createDataFrame(goals, f"part int, doc_id long, {columns}")


def plain(x, y, c, kind, penalised, ridge):
    """Minimise over (TERMS + 1, outs) by gradient steps with halving, long enough to settle."""
    outs, rows = y.shape[1], int((c.max(axis=1) > 0).sum())
    one = np.hstack([x, np.ones((N, 1))])
    keep = np.ones((TERMS + 1, 1))
    keep[-1] = penalised

    def both(w):
        z = one @ w
        if kind == "softmax":
            top = z.max(axis=1, keepdims=True)
            p = np.exp(z - top)
            total = p.sum(axis=1, keepdims=True)
            value, slope = (c[:, 0] * (top[:, 0] + np.log(total[:, 0]) - (y * z).sum(axis=1))).sum(), c[:, :1] * (p / total - y)
        elif kind == "log":
            value, slope = (c * np.logaddexp(0, -y * z)).sum(), -c * y / (1 + np.exp(y * z))
        else:
            gap = np.maximum(1 - y * z, 0)
            value, slope = (c * gap**2).sum(), -2 * c * y * gap
        return value / rows + ridge / 2 * (keep * w * w).sum(), one.T @ slope / rows + ridge * keep * w

    w = np.zeros((TERMS + 1, outs))
    value, slope = both(w)
    for _ in range(20000):
        step = 2.0
        while step > 1e-12:
            new, fresh = both(w - step * slope)
            if new <= value - 0.4 * step * (slope**2).sum():
                break
            step /= 2
        else:
            break
        w, value, slope = w - step * slope, new, fresh
        if np.abs(slope).max() < 1e-9:
            break
    return w


def as_array(found, part, outs):
    w = np.zeros((TERMS + 1, outs))
    for r in found.terms.where(F.col("part") == part).collect():
        w[int(r.term[1:]), r.out] = r.coefficient
    for k in range(outs):
        w[-1, k] = found.intercepts[part, k]
    return w


@pytest.mark.parametrize(("kind", "penalised"), [("log", False), ("squared_hinge", True)])
def test_parts_equal_the_plain_solver(spark, monkeypatch, kind, penalised):
    """Two parts that learn from other rows are solved at once; frequent terms are salted."""
    monkeypatch.setattr(LI, "SPLIT", 10)
    x, label = data(1, 2)
    y = np.where(label == 1, 1.0, -1.0).reshape(-1, 1)
    costs = [np.where(np.arange(N) % 3 == p, 0.0, 1.0 + (label == 0)).reshape(-1, 1) for p in (0, 1)]
    goals = [(p, i, float(y[i, 0]), float(costs[p][i, 0])) for p in (0, 1) for i in range(N)]
    found = LI.solve(*tables(spark, x, goals, 1), kind, ridge=0.05, penalise_intercept=penalised, tolerance=1e-4)
    assert max(found.left.values()) <= 1e-4 and found.passes < 40
    margins = {(r.part, r.doc_id): r.m0 for r in found.margins.collect()}
    assert len(margins) == 2 * N
    for p in (0, 1):
        want = plain(x, y, costs[p], kind, penalised, 0.05)
        assert np.abs(as_array(found, p, 1) - want).max() < 1e-3
        z = x @ want[:-1, 0] + want[-1, 0]
        assert max(abs(margins[p, i] - z[i]) for i in range(N)) < 1e-3  # rows not learnt from too


def test_three_outputs_equal_the_plain_solver(spark):
    kind = "softmax"
    x, label = data(2, 3)
    y = np.where(label[:, None] == np.arange(3), 1.0, 0.0)
    c = np.ones((N, 3))
    goals = [(4, i, *[float(v) for k in range(3) for v in (y[i, k], c[i, k])]) for i in range(N)]
    found = LI.solve(*tables(spark, x, goals, 3), kind, 3, ridge=0.05, penalise_intercept=True, tolerance=1e-4)
    assert np.abs(as_array(found, 4, 3) - plain(x, y, c, kind, True, 0.05)).max() < 1e-3


def test_empty_and_one_sided_goals(spark):
    x, label = data(3, 2)
    points, goals = tables(spark, x, [(0, i, 1.0, 0.0) for i in range(N)], 1)
    none = LI.solve(points, goals, "log")
    assert none.terms.count() == 0 and none.intercepts == {} and none.margins.count() == 0
    bare = LI.solve(points.where("false"), goals.withColumn("c0", F.lit(1.0)).withColumn("y0", F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(-1.0)), "log", tolerance=1e-6)
    assert bare.terms.count() == 0 and abs(bare.intercepts[0, 0] - np.log(0.5)) < 1e-5  # the log odds of 20 and 40 rows


def test_sigmoids_equal_plain_newton_steps(spark):
    """Part 0 overlaps, part 1 is parted by its margins (the drawn-in targets keep it finite), part 2 has one kind of row."""
    r = random.Random(4)
    rows = [(0, r.gauss(1.0 if y else -0.5, 1.5), float(y)) for y in (0, 0, 1) for _ in range(30)]
    rows += [(1, 2.0 * y - 1 + r.random() / 2, float(y)) for y in (0, 1) for _ in range(15)] + [(2, 1.0, 1.0)]
    got = LI.sigmoids(spark.createDataFrame(rows, "part int, margin double, y double"))
    assert sorted(got) == [0, 1]
    for part, (a, b) in got.items():
        m, y = (np.array([x[k] for x in rows if x[0] == part]) for k in (1, 2))
        n1, n0 = y.sum(), (1 - y).sum()
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        p = 1 / (1 + np.exp(-(a * m + b)))
        assert a > 0 and max(abs(((p - t) * m).mean()), abs((p - t).mean())) < 1e-6  # where the gradient is nought
