"""Linear models whose coefficients are a table, fitted by limited-memory BFGS as joins and aggregates.

A problem ("part") has one linear score or more for each row (outputs 0, 1, ...);
many parts, such as the folds of a calibration, are solved in the same jobs.  Minimised is

    ridge / 2 * |w|^2 + mean over the part's rows of cost * loss

State is one table (part, out, term, w, gradient, last steps and differences of
gradients).  A pass is one sparse product for the direction's margins, one
aggregate that tries all step lengths on margins alone, and one sparse product
for the gradient.  The driver holds inner products and intercepts: a few numbers
a part, none that grows with the vocabulary.  Each pass writes its state to the
shared folder, so a lost executor repeats one pass at most.

A frequent term's rows are dealt to salts, so no task joins a term whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import ml as M

HISTORY, PASSES, TOLERANCE = 5, 60, 1e-2
#: Rows of one term that a task may join.
SPLIT = 1 << 20
STEPS = [4.0, 2.0, 1.0, 0.5, 0.25, 0.0625, 2.0**-8, 2.0**-12]


@dataclass
class Solution:
    """terms (part, out, term, coefficient), intercepts by (part, out), margins (part, key, m0, ...), passes and the gradient's share left by part."""

    terms: DataFrame
    intercepts: dict[tuple[int, int], float]
    margins: DataFrame
    passes: int
    left: dict[int, float]


def _softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def _softmax(z: list[Column]) -> tuple[Column, list[Column]]:
    """ln of the sum of powers, and the shares."""
    top = z[0] if len(z) == 1 else F.greatest(*z)
    powers = [F.exp(x - top) for x in z]
    total = sum(powers[1:], powers[0])
    return top + F.log(total), [p / total for p in powers]


def _loss(kind: str, y: list[Column], c: list[Column], z: list[Column]) -> Column:
    if kind == "softmax":
        return c[0] * (_softmax(z)[0] - sum((a * b for a, b in zip(y, z)), F.lit(0.0)))
    each = {"log": lambda a: _softplus(-a), "squared_hinge": lambda a: F.pow(F.greatest(1 - a, F.lit(0.0)), 2)}[kind]
    return sum((w * each(a * b) for w, a, b in zip(c, y, z)), F.lit(0.0))


def _slopes(kind: str, y: list[Column], c: list[Column], z: list[Column]) -> list[Column]:
    """Derivatives of the loss by each margin."""
    if kind == "softmax":
        return [c[0] * (p - a) for p, a in zip(_softmax(z)[1], y)]
    each = {"log": lambda a: 1 / (1 + F.exp(a)), "squared_hinge": lambda a: 2 * F.greatest(1 - a, F.lit(0.0))}[kind]
    return [-w * a * each(a * b) for w, a, b in zip(c, y, z)]


def _numbers(df: DataFrame, columns: dict[str, dict[int, float]]) -> DataFrame:
    """``df`` with a few numbers of its part.  They come as a table, not as literals, so that every pass runs the same compiled plan."""
    parts = sorted({p for by in columns.values() for p in by})
    numbers = {name: pa.array([float(by[p]) for p in parts], pa.float64()) for name, by in columns.items()}
    table = df.sparkSession.createDataFrame(pa.table({"part": pa.array(parts, pa.int32())} | numbers))  # a local relation: read without a job
    return df.join(F.broadcast(table), "part")  # one row a part


def _direction(inner: list[list[float]], history: int) -> list[float]:
    """Coefficients of the descent direction over the basis (steps, differences, gradient), newest pair first, from its inner products alone."""
    g = 2 * history
    delta = [0.0] * (g + 1)
    delta[g] = -1.0
    dot = lambda j: sum(d * inner[k][j] for k, d in enumerate(delta))
    pairs = [i for i in range(history) if inner[i][history + i] > 1e-300]
    alpha = {}
    for i in pairs:
        alpha[i] = dot(i) / inner[i][history + i]
        delta[history + i] -= alpha[i]
    if pairs:
        first = pairs[0]
        scale = inner[first][history + first] / inner[history + first][history + first]
        delta = [d * scale for d in delta]
    for i in reversed(pairs):
        beta = dot(history + i) / inner[i][history + i]
        delta[i] += alpha[i] - beta
    return delta


def solve(points: DataFrame, goals: DataFrame, loss: str, outs: int = 1, key: str = "doc_id", penalty: float = 1.0, ridge: float | None = None, penalise_intercept: bool = False, history: int = HISTORY, passes: int = PASSES, tolerance: float = TOLERANCE) -> Solution:
    """Fit every part of ``goals`` on ``points``.

    ``points``: key, term, weight.  ``goals``: part, key (once a part), y0, y1, ...
    and c0, c1, ...; rows with costs of 0 are not learnt from but get margins.
    ``loss``: 'log' or 'squared_hinge' (y is 1 or -1, outputs apart), or 'softmax'
    (y is 1 for the row's output, else 0; its cost is c0).  ``ridge`` is ``penalty``
    / rows of the part unless given.  Ends when each part's gradient has shrunk
    to ``tolerance`` of the first, or after ``passes``.  Documents without terms
    score their intercept; parts without rows to learn from are not in the result.
    """
    span = range(outs)
    y, c, m, d, r = ([f"{name}{k}" for k in span] for name in "ycmdr")
    cols = lambda names: [F.col(n) for n in names]
    salts = points.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("salts"))
    salts = M.written(salts, "salts")
    hot = salts.where("salts > 1")
    salted = points.join(hot, "term", "left").select(key, "term", "weight", F.when(F.col("salts") > 1, F.pmod(F.xxhash64(key), F.col("salts"))).otherwise(0).cast("int").alias("salt"))
    points = M.written(salted, "points")
    learn = F.greatest(*cols(c), F.lit(0.0)) > 0
    counts = {x.part: x.n for x in goals.where(learn).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    margins = goals.where(F.col("part").isin(parts)).select(F.col("part").cast("int"), key, *[F.col(x).cast("double") for x in y + c], *[F.lit(0.0).alias(x) for x in m])
    if not parts:
        return Solution(points.limit(0).select(F.lit(0).alias("part"), F.lit(0).alias("out"), "term", F.col("weight").alias("coefficient")), {}, margins.drop(*y, *c), 0, {})
    ridges = {p: penalty / counts[p] if ridge is None else ridge for p in parts}
    margins = M.written(_numbers(margins, {"mean": {p: 1.0 / counts[p] for p in parts}}), "margins")
    mean = F.col("mean")

    def gradient(rows: DataFrame) -> DataFrame:
        """part, out, term, loss: the mean loss's derivative by each coefficient."""
        slopes = rows.where(learn).select("part", key, *[(s * mean).alias(n) for s, n in zip(_slopes(loss, cols(y), cols(c), cols(m)), r)])
        sums = points.join(slopes, key).groupBy("part", "term").agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in r])
        return sums.select("part", "term", F.posexplode(F.array(*cols(r))).alias("out", "loss"))

    basis = [f"s{i}" for i in range(history)] + [f"v{i}" for i in range(history)] + ["g"]
    state = gradient(margins).select("part", "out", "term", F.lit(0.0).alias("w"), *[F.lit(0.0).alias(b) for b in basis[:-1]], F.col("loss").alias("g"))
    state = M.written(state, "state")
    # the intercepts' share of the state, of numbers on the driver
    own = {(p, k): {"w": 0.0, **dict.fromkeys(basis, 0.0)} for p in parts for k in span}
    first = margins.where(learn).groupBy("part").agg(*[F.sum(s * mean).alias(n) for s, n in zip(_slopes(loss, cols(y), cols(c), cols(m)), r)]).collect()
    for x in first:
        for k in span:
            own[x.part, k]["g"] = x[r[k]]
    names = ["w", *basis]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    start: dict[int, float] = {}
    left: dict[int, float] = {}
    done = 0
    for done in range(1, passes + 1):
        found = {x.part: x for x in state.groupBy("part").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).collect()}
        delta, squares = {}, {}
        for p in parts:
            table = {(a, b): (found[p][f"{a}_{b}"] if p in found else 0.0) for a, b in pairs}
            whole = {(a, b): v + sum(own[p, k][a] * own[p, k][b] for k in span) for (a, b), v in table.items()}
            both = lambda t, a, b: t[a, b] if (a, b) in t else t[b, a]
            delta[p] = _direction([[both(whole, a, b) for b in basis] for a in basis], history)
            kept = whole if penalise_intercept else table
            squares[p] = (kept["w", "w"], sum(v * kept["w", b] for v, b in zip(delta[p], basis)), sum(v * u * both(kept, a, b) for v, a in zip(delta[p], basis) for u, b in zip(delta[p], basis)))
            norm = math.sqrt(whole["g", "g"])
            left[p] = norm / start.setdefault(p, max(norm, 1e-300))
        if max(left.values()) <= tolerance:
            done -= 1
            break
        for (p, _), x in own.items():
            x["d"] = sum(v * x[b] for v, b in zip(delta[p], basis))
        told = {f"e{i}": {p: delta[p][i] for p in parts} for i in range(len(basis))}
        ahead = sum((F.col(f"e{i}") * F.col(b) for i, b in enumerate(basis)), F.lit(0.0))
        moved = _numbers(state, told).select("part", "out", "term", ahead.alias("d")).join(salts, "term").select("part", "out", "term", "d", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        gain = points.join(moved, ["term", "salt"]).groupBy("part", key).agg(*[F.sum(F.when(F.col("out") == k, F.col("weight") * F.col("d"))).alias(d[k]) for k in span])
        rows = _numbers(margins.join(gain, ["part", key], "left"), {f"o{k}": {p: own[p, k]["d"] for p in parts} for k in span})
        rows = M.written(rows.select("part", key, *y, *c, *m, *[(F.coalesce(d[k], F.lit(0.0)) + F.col(f"o{k}")).alias(d[k]) for k in span], "mean"), "margins")
        ends = lambda t: [F.col(a) + t * F.col(b) for a, b in zip(m, d)]
        tried = [0.0, *STEPS]
        sums = []
        for i, t in enumerate(tried):
            sums.append(F.sum(_loss(loss, cols(y), cols(c), ends(t)) * mean).alias(f"l{i}"))
            sums += [F.sum(v * mean).alias(f"b{i}_{k}") for k, v in enumerate(_slopes(loss, cols(y), cols(c), ends(t)))]
        seen = {x.part: x for x in rows.where(learn).groupBy("part").agg(*sums).collect()}
        step = {}
        for p in parts:
            ww, wd, dd = squares[p]
            value = [seen[p][f"l{i}"] + ridges[p] / 2 * (ww + 2 * t * wd + t * t * dd) for i, t in enumerate(tried)]
            best = min(range(len(tried)), key=lambda i: (value[i], i))
            step[p] = tried[best]
            for k in span:
                x = own[p, k]
                fresh = seen[p][f"b{best}_{k}"] + (ridges[p] * (x["w"] + step[p] * x["d"]) if penalise_intercept else 0.0)
                shifted = {f"{n}{i}": x[f"{n}{i - 1}"] for n in "sv" for i in range(1, history)}
                own[p, k] = x | shifted | {"w": x["w"] + step[p] * x["d"], "s0": step[p] * x["d"], "v0": fresh - x["g"], "g": fresh}
        if not any(step.values()):  # no length lowers any part: as exact as the numbers are
            break
        margins = _numbers(rows, {"step": step}).select("part", key, *y, *c, *[(F.col(a) + F.col("step") * F.col(b)).alias(a) for a, b in zip(m, d)], "mean")
        moved = _numbers(state, told | {"step": step, "ridge": ridges}).withColumn("_s", F.col("step") * ahead).withColumn("_w", F.col("w") + F.col("_s"))
        fresh = moved.join(gradient(margins), ["part", "out", "term"]).withColumn("_g", F.col("loss") + F.col("ridge") * F.col("_w"))
        older = [F.col(f"{n}{i - 1}").alias(f"{n}{i}") for n in "sv" for i in range(1, history)]
        state = M.written(fresh.select("part", "out", "term", F.col("_w").alias("w"), F.col("_s").alias("s0"), (F.col("_g") - F.col("g")).alias("v0"), *older, F.col("_g").alias("g")), "state")
    terms = state.where("w <> 0").select("part", "out", "term", F.col("w").alias("coefficient"))
    return Solution(terms, {at: x["w"] for at, x in own.items()}, margins.select("part", key, *m), done, left)


def sigmoids(margins: DataFrame, passes: int = 40, tolerance: float = 1e-7) -> dict[int, tuple[float, float]]:
    """slope and offset by part of the sigmoid that fits (part, margin, y in 0, 1) best: Newton's steps on sums.

    Targets are drawn in to (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), as a margin's
    sign can be certain on few rows.  Parts with one kind of y are left out.
    """
    sizes = {r.part: (r.n1, r.n0) for r in margins.groupBy("part").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).collect()}
    sizes = {p: n for p, n in sizes.items() if min(n) > 0}
    if not sizes:
        return {}
    draw = {"high": {p: (n1 + 1) / (n1 + 2) for p, (n1, n0) in sizes.items()}, "low": {p: 1 / (n0 + 2) for p, (n1, n0) in sizes.items()}}
    rows = _numbers(margins, draw).select("part", "margin", F.when(F.col("y") > 0, F.col("high")).otherwise(F.col("low")).alias("t"))
    rows = M.written(rows, "sigmoids")
    at = {p: (0.0, math.log((n1 + 1) / (n0 + 1))) for p, (n1, n0) in sizes.items()}
    lengths = [1.0, 0.5, 0.25, 0.0625, 2.0**-8]
    score = F.col("a") * F.col("margin") + F.col("b")
    share = 1 / (1 + F.exp(-score))
    slope, curve = share - F.col("t"), share * (1 - share)
    cost = lambda z: F.sum(_softplus(z) - F.col("t") * z)
    for _ in range(passes):
        here = _numbers(rows, {"a": {p: v[0] for p, v in at.items()}, "b": {p: v[1] for p, v in at.items()}})
        x = F.col("margin")
        sums = {r.part: r for r in here.groupBy("part").agg(F.sum(slope * x).alias("ga"), F.sum(slope).alias("gb"), F.sum(curve * x * x).alias("aa"), F.sum(curve * x).alias("ab"), F.sum(curve).alias("bb")).collect()}
        turn = {}
        for p, r in sums.items():
            aa, bb = r.aa + 1e-12, r.bb + 1e-12
            whole = max(aa * bb - r.ab * r.ab, 1e-300)
            turn[p] = (-(bb * r.ga - r.ab * r.gb) / whole, -(aa * r.gb - r.ab * r.ga) / whole)
        if max(max(abs(r.ga), abs(r.gb)) / sum(sizes[p]) for p, r in sums.items()) <= tolerance:
            break
        ahead = _numbers(here, {"da": {p: v[0] for p, v in turn.items()}, "db": {p: v[1] for p, v in turn.items()}})
        tried = [0.0, *lengths]
        seen = ahead.groupBy("part").agg(*[cost(score + t * (F.col("da") * x + F.col("db"))).alias(f"l{i}") for i, t in enumerate(tried)]).collect()
        step = {r.part: tried[min(range(len(tried)), key=lambda i: (r[f"l{i}"], i))] for r in seen}
        if not any(step.values()):
            break
        at = {p: (a + step[p] * turn[p][0], b + step[p] * turn[p][1]) for p, (a, b) in at.items()}
    return at
