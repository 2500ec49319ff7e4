"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full sets.

Each document's set of word shingles gets ``TREES * DEPTH`` minimum hashes.
Documents of equal sets become one node first.  A tree orders the nodes by its
hashes; nodes that agree in the first few of them (``least_depth``) form a
region.  The depth adapts to the region: one of more than ``CROWD`` nodes is
split by the tree's next hash, and by the one after, beyond the tree's own by
those of the next tree, and if sets are so alike that no hash tells them apart,
by the node's number, so no task meets more than about ``CROWD`` of them at
once.  In sorted order, the neighbours with the longest common prefix stand side
by side: a node is a candidate with its predecessor and with its region's first
node, and the first nodes of the parts of a region with that of the whole.
Sizes and a 128-bit sketch drop pairs that can't reach the similarity.
Candidates are confirmed on full sets, a few for each node at first: pairs whose
ends have since been connected need no test.  What is left, pairs of one region
that no order brought together and that lie in different components, is
compared within the regions that hold more than one component, by sketches and
then by full sets.  Of these comparisons only links leave the task.  Pairs in different
parts of a crowded region are found at last, in families of such regions, by
what sets hold beyond the family's core or lack of it (``crowded``).

Two sets of just the similarity asked for share no region of the least depth
with a probability of at most ``MISSED``, and are dropped by the sketch at 5.5
standard deviations (about 1e-7); no link between sets that share a region is
lost otherwise, crowded or not.

Groups of copies take part as one node.  A leader that many candidates name is
dealt to several tasks.  Components come from alternating large and small star
steps, each a join and an aggregate; no links reach the driver.

Defined results: null text, or text without words, has an empty set and is
linked with nothing; fewer words than a shingle are one shingle; repeated rows
of one id and text each get a row; the rows of an id that has several texts
belong to one component, whatever the texts; a null id is kept only if no other
id has its set, with its own (null) component; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import crowded
from .common import materialise, release, settings

SHINGLE, PERCENT = 5, 85
TREES, DEPTH = 16, 8
#: Probability that two sets of the similarity share no region of the least depth, at most.
MISSED = 2e-5
CROWD = 256
LEADER_ROWS = 256
BROADCAST_REGIONS = 100_000
#: Bits that tell which rows' texts are likely to be compared (16 MB).
MARK_BITS = 1 << 27
#: Tables that grow with the documents are broadcast only while they are small: at a middling size Spark would build several at once on the driver.
NARROW = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_RNG = np.random.default_rng(2024)
_FACTORS = _RNG.integers(0, 1 << 63, SHINGLE + 11, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTE = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MEMO_WORDS = 300_000


def least_depth(percent: int) -> int:
    """The deepest prefix that some tree still shares but for a probability of ``MISSED``."""
    return max([1, *(d for d in range(1, DEPTH) if (1 - (percent / 100) ** d) ** TREES <= MISSED)])


def sketch_apart(percent: int) -> int:
    """Bits of 128 in which sketches of sets of the similarity differ, at most."""
    p = (1 - percent / 100) / 2
    return math.ceil(128 * p + 5.5 * math.sqrt(128 * p * (1 - p)))


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > _MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode().translate(_FOLD).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = max(1, n - size + 1)
    width = min(n, size)
    x = np.full(m, width, np.uint64)
    for j in range(width):
        x += h[j : j + m] * _FACTORS[j]
    return np.unique(_mix(x))


def _signature(found: np.ndarray) -> np.ndarray:
    out = np.full(len(_PERMUTE), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(found), 4096):
        np.minimum(out, (found[i : i + 4096, None] * _PERMUTE).min(axis=0), out=out)
    return _mix(out)


_SKETCHED = "doc_id long, row long, n long, d1 long, d2 long, s1 long, s2 long, trees array<long>, deep array<long>, deeper array<long>"


def _packed(values: np.ndarray) -> np.ndarray:
    """The first 16 bits of each of four columns, in their order."""
    out = np.zeros(len(values), np.uint64)
    for j in range(4):
        out = (out << np.uint64(16)) | (values[:, j] >> np.uint64(48))
    return out.view(np.int64)


def _sketch(least: int):
    """Set size, set digest, sketch, and for each tree the hash of its first ``least`` values and the eight that follow."""

    def run(frames):
        hashes = _Hashes()
        for pdf in frames:
            rows = []
            for doc, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"]):
                found = shingle_set(text, hashes)
                n = len(found)
                doc = None if doc is None or doc != doc else int(doc)
                if not n:
                    rows.append((doc, row, 0, 0, 0, 0, 0, [], [], []))
                    continue
                digest = (found.sum(dtype=np.uint64), _mix(found).sum(dtype=np.uint64))
                sig = _signature(found)
                bits = np.packbits((sig & np.uint64(1)).astype(bool)).view(np.int64)
                by_tree = sig.reshape(TREES, DEPTH)
                low = (by_tree[:, :least] * _FACTORS[:least]).sum(axis=1, dtype=np.uint64)
                low = _mix(low + np.arange(TREES, dtype=np.uint64))
                after = np.concatenate([by_tree, np.roll(by_tree, -1, axis=0)], axis=1)[:, least : least + 8]
                rows.append((doc, row, n, *(int(x.astype(np.int64)) for x in digest), int(bits[0]), int(bits[1]), low.astype(np.int64).tolist(), _packed(after[:, :4]).tolist(), _packed(after[:, 4:]).tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "row", "n", "d1", "d2", "s1", "s2", "trees", "deep", "deeper"]).astype({"doc_id": "Int64"})

    return run


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))


def _possible(a: str, b: str, percent: int) -> Column:
    small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (F.col(f"{a}.id") != F.col(f"{b}.id")) & (100 * small >= percent * large) & (_apart(a, b) <= sketch_apart(percent))


def _ends(a: str, b: str) -> list[Column]:
    return [F.least(F.col(f"{a}.id"), F.col(f"{b}.id")).alias("a"), F.greatest(F.col(f"{a}.id"), F.col(f"{b}.id")).alias("b")]


def _confirm(percent: int):
    def run(frames):
        hashes = _Hashes()
        leader, own = None, None
        for pdf in frames:
            rows = []
            for head, role, node, text in zip(pdf["leader"], pdf["role"], pdf["node"], pdf["text"]):
                if role == 0:
                    leader, own = head, shingle_set(text, hashes)
                elif head == leader:
                    found = shingle_set(text, hashes)
                    both = np.intersect1d(own, found, assume_unique=True).size
                    rows.append((head, node, 100 * both >= percent * (own.size + found.size - both)))
            yield pd.DataFrame(rows, columns=["a", "b", "linked"])

    return run


def _elements(frames):
    """id and sorted hashes of its shingles."""
    hashes = _Hashes()
    for pdf in frames:
        yield pd.DataFrame({"id": pdf["node"], "e": [np.sort(shingle_set(t, hashes).view(np.int64)) for t in pdf["text"]]})


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b, linked for each pair: leaders' and members' texts meet by leader, hot leaders in several tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_ROWS).alias("parts"))
    dealt = materialise(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt")
    heads = dealt.select("a", "part").distinct().withColumn("node", F.col("a")).withColumn("role", F.lit(0))
    members = dealt.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("role"))
    rows = heads.unionByName(members).join(texts, "node").select(F.col("a").alias("leader"), "part", "role", "node", "text")
    spark = pairs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "leader", "part").sortWithinPartitions("leader", "part", "role", "node")
    found = materialise(rows.select("leader", "role", "node", "text").mapInPandas(_confirm(percent), "a long, b long, linked boolean"), "confirmed")
    release(dealt)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reached): stars left by alternating star steps."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())

    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # every edge points down now: b is the larger end
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        before_now, now = now, materialise(small, "edges")
        release(before_now)
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))


_LINK = "a long, b long"


def _residual(percent: int):
    """Links between different components of one region.

    All nodes stand against those outside the region's main component: sizes and
    sketches first, then full sets, unless the two have been connected meanwhile.
    A pair that shares several regions is compared in the first of them.  Only
    links leave, not pairs.
    """
    hashes, most = _Hashes(), sketch_apart(percent)

    def compare(rows: pd.DataFrame):
        ids, sizes, comps = (rows[c].to_numpy() for c in ("id", "n", "component"))
        texts, region = rows["text"].to_numpy(), rows["key"].iloc[0]
        keys = np.stack(rows["regions"].to_numpy())
        bits = np.stack([rows["s1"].to_numpy(), rows["s2"].to_numpy()], axis=1).view(np.uint64)
        values, place, counts = np.unique(comps, return_inverse=True, return_counts=True)
        parent = list(range(len(values)))
        sets: dict[int, np.ndarray] = {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i], hashes)
            return sets[i]

        for i in np.flatnonzero(place != counts.argmax()).tolist():
            near = np.bitwise_count(bits ^ bits[i]).sum(axis=1) <= most
            near &= (place != place[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            at = np.flatnonzero(near)
            same = (keys[at] == keys[i]) & (keys[i] != 0)
            for j in at[keys[i][same.argmax(axis=1)] == region].tolist():
                x, y = root(place[i]), root(place[j])
                if x != y:
                    both = np.intersect1d(of(i), of(j), assume_unique=True).size
                    if 100 * both >= percent * (of(i).size + of(j).size - both):
                        parent[x] = y
                        yield (min(ids[i], ids[j]), max(ids[i], ids[j]))

    def run(frames):
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["key"].iloc[-1]
            rest = pdf[pdf["key"] == last]
            found = [p for _, region in pdf[pdf["key"] != last].groupby("key", sort=False) for p in compare(region)]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
        if rest is not None and len(rest):
            found = list(compare(rest))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def regions(rows: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """``rows`` (key, deep, deeper, tree, id, n, s1, s2) with ``region``: the key, or in crowded regions a longer prefix.

    Rows of regions that aren't crowded don't take part in the splitting.
    Tables written here, which the result reads, are added to ``scratch``.
    """
    scratch = [] if scratch is None else scratch

    def hint(few: DataFrame) -> DataFrame:
        return F.broadcast(few) if few.count() <= BROADCAST_REGIONS else few

    crowded = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD), "crowded")
    if crowded.isEmpty():
        scratch.append(crowded)
        return rows.withColumn("region", F.col("key"))
    first = hint(crowded.select("key", F.lit(True).alias("split")))
    marked = rows.join(first, "key", "left")
    plain = marked.where("split IS NULL").drop("split").withColumn("region", F.col("key"))
    prefix = lambda c, k: F.shiftrightunsigned(F.col(c), 64 - 16 * k)
    paths = [F.xxhash64("key", F.lit(k), prefix("deep", k)) for k in range(1, 5)] + [F.xxhash64("key", F.lit(4 + k), F.col("deep"), prefix("deeper", k)) for k in range(1, 5)]
    split = materialise(marked.where("split").drop("split").withColumn("paths", F.array(*paths)), "split")
    counts = split.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("c"))
    many = materialise(counts.where(F.col("c") > CROWD), "many")
    # which of a row's eight prefixes are crowded, met in one join
    own = ["tree", "id"]
    each = split.select(*own, F.posexplode("paths").alias("k", "path")).join(hint(many), "path")
    marks = each.groupBy(*own).agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("mask"), F.max(F.when(F.col("k") == 7, F.col("c"))).alias("c7"))
    marks = materialise(marks, "marks")
    split_marked = split.join(marks, own, "left")
    free = lambda k: F.coalesce("mask", F.lit(0)).bitwiseAND(1 << k) == 0
    # the first prefix that few share; where the longest is still crowded, parts of it by the node's number
    parts = F.ceil(F.col("c7") / CROWD)
    region = F.coalesce(*[F.when(free(k), F.col("paths")[k]) for k in range(8)], F.xxhash64(F.col("paths")[7], F.pmod(F.xxhash64("id"), parts)))
    scratch += [crowded, split, many, marks]
    return plain.unionByName(split_marked.withColumn("region", region).select(plain.columns))


def likely(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """``rows`` (doc_id, row, ...) without most of those that ``inside`` (_doc, _row) doesn't hold, so that few texts move to be joined with it.

    A bit for each hash of the pairs that are inside, in a broadcast of at most
    ``MARK_BITS`` bits; the join that follows settles which rows they are.
    """
    bits = 1 << min(MARK_BITS.bit_length() - 1, max(15, (32 * inside.count()).bit_length()))
    mark = lambda doc, row: F.pmod(F.xxhash64(doc, row), F.lit(bits))
    block, place = F.shiftright("mark", 15), F.col("mark").bitwiseAND(32767)
    marks = inside.select(mark("_doc", "_row").alias("mark")).groupBy(block.alias("block")).agg(F.bitmap_construct_agg(place).alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("mark", mark("doc_id", "row")).withColumn("block", block).join(F.broadcast(marks), "block")
    return marked.where(F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1).select(rows.columns)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    with settings(docs.sparkSession, NARROW):
        return _near_duplicates(docs, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    sketched = materialise(slim.mapInPandas(_sketch(least_depth(percent)), _SKETCHED), "sketches")
    # a node for each set, numbered once; the smallest (id, text) stands for it
    sets = sketched.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("x"))
    sets = materialise(sets.where("x IS NOT NULL").select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n", "x.*"), "sets")
    shown = sets.select("node", F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    nodes = sketched.join(shown, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n") == F.col("_n")))
    nodes = materialise(nodes.select(F.col("node").alias("id"), "n", "s1", "s2", "trees", "deep", "deeper").dropDuplicates(["id"]), "nodes")
    of = sets.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("n").alias("_n"), "node", F.col("doc_id").alias("_doc"))
    placed = sketched.select("doc_id", "n", "d1", "d2").join(of, (F.col("n") > 0) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n") == F.col("_n")), "left")
    placed = materialise(placed.select("doc_id", "n", "node"), "placed")
    release(sketched)
    rows = nodes.select("id", "n", "s1", "s2", F.posexplode(F.arrays_zip("trees", "deep", "deeper")).alias("tree", "t"))
    scratch: list[DataFrame] = []
    rows = regions(rows.select(F.col("t.trees").alias("key"), F.col("t.deep").alias("deep"), F.col("t.deeper").alias("deeper"), "tree", "id", "n", "s1", "s2"), scratch)

    order = W.partitionBy("region").orderBy("deep", "deeper", "id")
    me = F.struct("id", "n", "s1", "s2")
    met = rows.select("key", "region", "tree", me.alias("me"), F.lag(me).over(order).alias("before"), F.lead("id").over(order).alias("after"), F.min(me).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("first"))
    met = materialise(met.where("key <> region OR before IS NOT NULL OR after IS NOT NULL"), "regions")
    release(nodes, *scratch)
    near = met.where(F.col("before").isNotNull() & _possible("me", "before", percent)).select(*_ends("me", "before"))
    star = met.where(_possible("me", "first", percent)).select(*_ends("me", "first"))
    parts = met.where("key <> region").groupBy("key", "region").agg(F.min("first").alias("me"))
    tops = parts.groupBy("key").agg(F.min("me").alias("first"))
    across_parts = parts.join(tops, "key").where(_possible("me", "first", percent)).select(*_ends("me", "first"))
    pairs = materialise(near.unionByName(star).unionByName(across_parts).distinct(), "pairs")

    # rows that share an id are linked, whatever their texts
    shared = placed.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("x")).where(F.size("x") > 1)
    shared = shared.select("a", F.explode("x").alias("b")).where("a <> b")

    inside = met.select(F.col("me.id").alias("node")).distinct().join(sets, "node").select("node", F.col("doc_id").alias("_doc"), F.col("row").alias("_row"))
    inside = materialise(inside, "inside")
    held = likely(slim, inside).join(inside, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row"))).select("node", "text").dropDuplicates(["node"])
    texts = materialise(held, "texts")
    release(inside)

    tested = spark.createDataFrame([], "a long, b long")
    comps = components(shared)
    confirmed = []

    def across(found: DataFrame) -> DataFrame:
        """Pairs that were not tested and whose ends lie in different components."""
        at = lambda end: comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        open_ = found.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        return open_.select("a", "b").join(tested, ["a", "b"], "left_anti")

    def settle(chosen: DataFrame) -> None:
        nonlocal tested
        result = confirm(chosen, texts, percent)
        confirmed.append(result)
        tested = tested.unionByName(result.select("a", "b"))
        join_up(result.where("linked"))

    def join_up(links: DataFrame) -> None:
        nonlocal comps
        old = comps
        comps = components(old.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links.select("a", "b")))
        release(old)

    for step in range(3):
        left = materialise(across(pairs), "open")
        if left.isEmpty():
            release(left)
            break
        settle(left if step == 2 else left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        release(left)
    release(pairs, *confirmed)

    # pairs of a region that no order brought together
    by_tree = F.map_from_entries(F.collect_list(F.struct("tree", "region")))
    listed = met.groupBy(F.col("me.id").alias("id")).agg(by_tree.alias("x"))
    listed = listed.select("id", F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.col("x")[t], F.lit(0))).alias("regions"))
    here = met.select("region", "me.*").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = here.groupBy("region").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("region")
    open_ = here.join(mixed, "region").join(listed, "id").join(texts.withColumnRenamed("node", "id"), "id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    open_ = open_.repartition(n, "region").sortWithinPartitions("region", "id").select(F.col("region").alias("key"), "id", "n", "s1", "s2", "component", "regions", "text")
    rest = materialise(open_.mapInPandas(_residual(percent), _LINK).distinct(), "rest")
    if not rest.isEmpty():
        join_up(rest)
    release(rest)

    # crowded regions: families of them, by what their members share beyond a core or lack of it
    close = met.where("key <> region").select("key", "me.*").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = close.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("id").alias("a")).where("c1 <> c2").select("key", "a")
    close = materialise(close.join(several, "key"), "close")
    release(met)
    if not close.isEmpty():
        # one family takes the place of overlapping regions of several trees
        families = components(close.select("a", F.col("id").alias("b"))).withColumnRenamed("component", "g")
        overlapping = close
        close = close.drop("key", "a").dropDuplicates(["id"]).join(families, F.col("id") == F.col("node"), "left").withColumn("g", F.coalesce("g", "id"))
        close = materialise(close.select("g", "id", "n", "s1", "s2", "component"), "families")
        elements = texts.join(close.select(F.col("id").alias("node")), "node").mapInPandas(_elements, "id long, e array<long>")
        release(overlapping)
        elements = materialise(elements, "elements")
        release(texts)
        more = materialise(crowded.pairs(close, elements, percent, sketch_apart(percent)), "more")
        if not more.isEmpty():
            join_up(more)
        release(elements, more)
    else:
        release(texts)
    release(close)

    # nodes to the smallest id of their component
    grouped = sets.select("node", "doc_id").join(comps.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = grouped.join(least.hint("merge"), "component").select("node", "component_id")
    empty_too = placed.join(grouped.hint("merge"), "node", "left")
    component = F.coalesce("component_id", "doc_id")
    out = empty_too.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id")))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, that with the smallest id; of its rows, which may repeat or differ in their texts, the one with the least text hash.  Rows without an id stay."""
    near = near_duplicates(docs, percent)
    kept = near.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("_row")).where("doc_id IS NOT NULL").groupBy("doc_id", "_row").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("_row", "c")).alias("x")).select("doc_id", "x.*")
    kept = materialise(rows.join(kept, "doc_id").select(F.struct("doc_id", "_row").alias("k"), (F.col("c") > 1).alias("again")), "kept")
    release(near)
    # whole rows are one column, so that no name of theirs meets another
    whole = docs.select(F.struct("*").alias("r"))
    same = (F.col("r.doc_id") == F.col("k.doc_id")) & (F.xxhash64("r.text") == F.col("k._row"))
    out = whole.join(kept.where("NOT again"), same).select("r.*").unionByName(docs.where("doc_id IS NULL"))
    again = kept.where("again")
    if again.isEmpty():
        return out
    # only rows that are there several times are brought together
    one = whole.join(again, same).select("r", F.col("r.doc_id").alias("d")).dropDuplicates(["d"]).select("r.*")
    return out.unionByName(one)
