"""Pairs of similar sets inside groups whose sets are much alike, without comparing all pairs.

In such a group hashes tell little apart: members share a *core* C of elements,
here those that more than half of a sample hold (any set would do).  Let ``r(x)``
be what x holds beyond the core and ``m(x)`` what it lacks of it.  Two sets of a
similarity t share ``o >= a * (|x| + |y|)`` elements, ``a = t / (1 + t)``, and then
one of these holds:

1. they share an element beyond the core;
2. they lack the same element of the core;
3. neither, and so ``o = |C| - |m(x)| - |m(y)|``.  With ``g(x) = |m(x)| + a|x|``
   that says ``g(x) + g(y) <= |C|``, so the member h of the least g reaches the
   similarity with both, and pairs with h link all of them.

In any order of the elements that ends with the core's, the first that two similar
sets share is among the first ``|x| - ceil(t|x|) + 1`` of x, so for 1 only those
count; for 2 the first ``|m(x)| - max(1, floor(|m(x)| - |x|(1/t - t))) + 1`` missing
ones do, and only in sets that could reach the similarity by the core alone.

Members that such a feature brings together are compared in one task if they, times
those of them outside the group's largest component, are at most ``LIGHT`` squared.
More are a group of their own, with its own core, about half as
large at most, and so on.  Only links between components count: features that
only the group's largest component has are left out, groups of the same members
are taken once, and groups within one component not at all.

No pair is lost but by the sketch.  Group keys may be hot: joins on them are
salted, and everything else meets by (group, feature) or by node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

LIGHT = 256
SALTS = 16
#: Members that name the core of a group.
SAMPLE = 63
#: Features of the smaller components by which a group's other features are chosen before they meet, at most.
WANTED = 100_000


def _spread(left: DataFrame, few: DataFrame, on: str = "g", by: str = "id", how: str = "inner") -> DataFrame:
    """Join with a side of one row a group; a hot group's rows are dealt to several tasks."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copied = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copied, [on, "_salt"], how).drop("_salt")


_ME = ["id", "n", "s1", "s2", "component"]


_NONE = "CAST(array() AS ARRAY<BIGINT>)"


def _features(groups: DataFrame, sets: DataFrame, percent: int, level: int) -> DataFrame:
    """g, me, w (g(x)), size of the core, features (hashes of elements held or lacked), minor (outside the largest component)."""
    held = groups.join(sets, "id")
    drawn = W.partitionBy("g").orderBy(F.xxhash64("id", F.lit(level)), "id")
    sample = held.withColumn("k", F.row_number().over(drawn)).where(F.col("k") <= SAMPLE)
    shares = sample.groupBy("g").agg(F.count(F.lit(1)).alias("drawn"))
    counts = sample.select("g", F.explode("e").alias("s")).groupBy("g", "s").agg(F.count(F.lit(1)).alias("f")).join(shares, "g").where("2 * f > drawn")
    by_part = groups.groupBy("g", "component").agg(F.count(F.lit(1)).alias("c"))
    # a core holds at most twice the mean number of elements of the sample's members
    cores = by_part.groupBy("g").agg(F.max(F.struct("c", "component")).alias("main")).join(counts.groupBy("g").agg(F.array_sort(F.collect_list("s")).alias("core")), "g", "left")
    cores = materialise(cores.select("g", "main.component", F.coalesce("core", F.expr(_NONE)).alias("core")).withColumnRenamed("component", "main"), "cores")
    t = percent / 100
    full = _spread(held, cores).withColumns({"beyond": F.array_except("e", "core"), "lacked": F.array_except("core", "e")})
    first = f"size(lacked) - greatest(1, CAST(floor(size(lacked) - n * {1 / t - t}D) AS INT)) + 1"
    lacks = f"CASE WHEN size(lacked) > 0 AND 100 * (size(core) - size(lacked)) >= {percent} * n THEN slice(lacked, 1, {first}) ELSE slice(lacked, 1, 0) END"
    features = F.expr(f"concat(slice(beyond, 1, CAST(n - (n * {percent} + 99) DIV 100 + 1 AS INT)), transform({lacks}, x -> ~x))")
    full = full.select("g", F.struct(*_ME).alias("me"), F.expr(f"size(lacked) + n * {t / (1 + t)}D").alias("w"), F.size("core").alias("core"), features.alias("features"), (F.col("component") != F.col("main")).alias("minor"), F.expr("concat(beyond, transform(lacked, x -> ~x))").alias("apart"))
    full = materialise(full, "features")
    wanted = full.where("minor").select("g", F.explode("features").alias("x")).distinct()
    few = wanted.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= WANTED).select("g")
    lists = wanted.join(few, "g").groupBy("g").agg(F.collect_list("x").alias("wanted"))
    # the other members' features matter where they meet those; with more than WANTED the counts of _level tell
    return _spread(full, lists, by="me", how="left").withColumn("features", F.expr("CASE WHEN minor OR wanted IS NULL THEN features ELSE array_intersect(features, wanted) END")).drop("wanted")


def _compare(percent: int, apart: int):
    """Links among the members of each feature, read as sorted rows: members outside the largest component against all.

    Two members differ in just the elements in which one of them differs from the
    core, so their differences to it stand for the whole sets.
    """

    def links(rows: pd.DataFrame):
        ids, sizes, comps = (rows[c].to_numpy() for c in ("id", "n", "component"))
        bits = np.stack([rows["s1"].to_numpy(), rows["s2"].to_numpy()], axis=1).view(np.uint64)
        differ, sets = rows["apart"].to_numpy(), {}
        values, place = np.unique(comps, return_inverse=True)
        parent = list(range(len(values)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def of(i: int) -> set:
            if i not in sets:
                sets[i] = set(differ[i].tolist())
            return sets[i]

        for i in np.flatnonzero(rows["minor"].to_numpy()).tolist():
            near = (place != place[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            near &= np.bitwise_count(bits ^ bits[i]).sum(axis=1) <= apart
            for j in np.flatnonzero(near).tolist():
                x, y = root(place[i]), root(place[j])
                if x != y:
                    a, b = of(i), of(j)
                    both = (int(sizes[i]) + int(sizes[j]) - len(a) - len(b)) // 2 + len(a & b)
                    if 100 * both >= percent * (int(sizes[i]) + int(sizes[j]) - both):
                        parent[x] = y
                        yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def run(frames):
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["g"] == pdf["g"].iloc[-1]) & (pdf["x"] == pdf["x"].iloc[-1])
            rest = pdf[last]
            found = [p for _, members in pdf[~last].groupby(["g", "x"], sort=False) for p in links(members)]
            yield pd.DataFrame(found, columns=["a", "b"])
        if rest is not None and len(rest):
            yield pd.DataFrame(list(links(rest)), columns=["a", "b"])

    return run


def _level(groups: DataFrame, sets: DataFrame, percent: int, apart: int, light: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Links of these groups, and the groups that frequent features make."""
    nodes = materialise(_features(groups, sets, percent, level), "features")
    hubs = nodes.groupBy("g").agg(F.min(F.struct("w", "me", "apart")).alias("h"))
    both = "((me.n + h.me.n - size(apart) - size(h.apart)) DIV 2 + size(array_intersect(apart, h.apart)))"
    stars = _spread(nodes, hubs, by="me").where("w + h.w <= core + 1e-6 AND me.component <> h.me.component").where(f"100 * {both} >= {percent} * (me.n + h.me.n - {both})")
    stars = stars.select(F.expr("least(me.id, h.me.id)").alias("a"), F.expr("greatest(me.id, h.me.id)").alias("b"))
    posted = materialise(nodes.select("g", "me.*", "minor", "apart", F.explode("features").alias("x")), "posted")
    key = ["g", "x"]
    told = posted.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.count_if("minor").alias("k"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("d1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("d2"))
    told = materialise(told.where("c1 <> c2"), "postings")
    # features of the same members are one
    once = told.groupBy("c", "k", "d1", "d2").agg(F.min(F.struct(*key)).alias("at")).select("at.*", (F.col("c") * F.col("k") <= light * light).alias("few"))
    few = posted.join(once.where("few").drop("few"), key)
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = few.repartition(n, *key).sortWithinPartitions(*key, "id").mapInPandas(_compare(percent, apart), "a long, b long")
    inner = posted.join(once.where("NOT few").drop("few"), key).select(F.xxhash64(*key).alias("g"), *_ME)
    return materialise(stars.unionByName(linked).distinct(), "near"), materialise(inner, "groups")


def pairs(groups: DataFrame, sets: DataFrame, percent: int, apart: int, light: int | None = None) -> DataFrame | None:
    """a, b: links that connect all similar members of each group (g, id, n, s1, s2, component); ``sets`` are (id, e: its sorted elements)."""
    out, light, level = None, light or LIGHT, 0
    groups = materialise(groups.select("g", *_ME), "groups")
    while not groups.isEmpty():
        found, groups = _level(groups, sets, percent, apart, light, level)
        level += 1
        out = found if out is None else out.unionByName(found)
    return None if out is None else out.distinct()
