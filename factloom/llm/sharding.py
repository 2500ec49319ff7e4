"""Minimax contiguous partition of documents into shards, groups of equal texts kept whole.

Groups stand in the order of a 64-bit hash of their text.  The smallest shard
capacity for which a greedy walk needs at most ``n_shards`` shards is found by
binary search (``TRIED`` capacities at a time), and the cuts are made there.

The driver never sees the groups.  It holds the weights of at most 2^``FIRST``
prefixes of the hash, whatever the number of rows; these alone bound the
capacity from both sides.  A walk then needs more only where a cut falls inside
a prefix of several groups: Spark splits just those prefixes, for the next
``AHEAD`` cuts of each tried capacity, so a question returns at most about
TRIED * AHEAD^2 / 2 prefixes of 2^``BITS`` parts, and they are forgotten when
the next capacities are tried.

Everything runs as DataFrame expressions: one narrow table is written, each
question is one partial aggregate over it, and slots come from a window over
short runs plus an offset per run, so no shard passes through one task.

Defined results: a null text has no bytes (size 1, crc32 0) and stands with the
empty texts; repeated rows each get a slot of their own; a null id is sorted
first; an empty table gives an empty result; columns beside id and text are
neither read nor returned.  A group that outweighs the mean shard sets the
capacity; others may stand beside it as far as they fit.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, text_or_empty

FIRST, BITS = 16, 8
TRIED, AHEAD = 8, 8
_TOP = -(1 << 63)


@dataclass(frozen=True)
class Leaf:
    """Groups whose hashes share a prefix of ``width`` bits."""

    prefix: int
    width: int
    weight: int
    single: bool

    @property
    def begin(self) -> int:
        return self.prefix << (64 - self.width)


class Leaves:
    """Leaves in the order of the hash, and where each begins in the running sum of weights."""

    def __init__(self, leaves: list[Leaf]):
        self.all = sorted(leaves, key=lambda x: x.begin)
        self.starts, at = [], 0
        for x in self.all:
            self.starts.append(at)
            at += x.weight
        self.total = at
        self.heaviest = max((x.weight for x in self.all if x.single), default=0)

    def bound(self, shards: int, split: bool) -> int:
        """The smallest capacity if leaves of several groups can be cut anywhere (``split``), or nowhere."""
        low = max([-(-self.total // shards), self.heaviest, *(x.weight for x in self.all if not split)])
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            at = 0
            for _ in range(shards):
                k = bisect_right(self.starts, at + mid) - 1
                inside = at + mid < self.total and split and not self.all[k].single
                at = at + mid if inside or at + mid >= self.total else self.starts[k]
            low, high = (low, mid) if at >= self.total else (mid + 1, high)
        return low

    def walk(self, capacity: int, shards: int, ahead: int, exact: bool = False) -> tuple[bool | None, list[int], list[Leaf]]:
        """Whether ``shards`` of this capacity suffice (None: not known yet), the cuts (leaves) as far as they are certain, and the leaves to split to know more."""
        if capacity < self.heaviest:
            return False, [], []
        cuts: list[int] = []
        wanted: dict[Leaf, None] = {}
        a = b = 0  # the shard begins between these
        unknown = 0
        for n in range(shards):
            if a + capacity >= self.total and not (exact and wanted):
                return True, cuts, []
            if n == shards - 1:
                break
            if a + capacity >= self.total or unknown >= ahead:
                return None, cuts, list(wanted)
            i = bisect_right(self.starts, a + capacity) - 1
            j = min(bisect_right(self.starts, b + capacity), len(self.all)) - 1
            # certain places: a leaf's begin, or that of a leaf that can't be cut
            early = max(a, self.starts[i])
            late = self.starts[j] if self.all[j].single else min(b + capacity, self.total)
            if late != early or unknown:
                wanted |= dict.fromkeys(x for x in self.all[i : j + 1] if not x.single)
                unknown += 1
            else:
                cuts.append(i)
            a, b = early, late
        if b + capacity < self.total:
            return False, cuts, []
        return None, cuts, list(wanted)


def plan_cuts(slim: DataFrame, shards: int, first: int = FIRST, bits: int = BITS, asked: list[int] | None = None) -> tuple[list[int], int]:
    """Unsigned hash values at which shards 1, 2, ... begin, and the capacity.  ``asked`` gets the number of rows of each answer to the driver."""

    def weigh(width: int, parents: list[Leaf] | None) -> list[Leaf]:
        rows = slim
        if parents is not None:
            above = F.shiftrightunsigned("h", 64 - parents[0].width)
            rows = rows.where(above.isin([x.prefix for x in parents]))
        child = F.shiftrightunsigned("h", 64 - width) if width < 64 else F.col("h")
        out = rows.groupBy(child.alias("p")).agg(F.sum("size").alias("w"), (F.min("h") == F.max("h")).alias("one")).collect()
        if asked is not None:
            asked.append(len(out))
        return [Leaf(r.p & ((1 << 64) - 1), width, r.w, r.one) for r in out]

    def opened(leaves: Leaves, wanted: set[Leaf]) -> Leaves:
        found = [x for x in leaves.all if x not in wanted]
        for width in {x.width for x in wanted}:
            found += weigh(min(64, width + bits), [x for x in wanted if x.width == width])
        return Leaves(found)

    roots = Leaves(weigh(first, None))
    if not roots.all:
        return [], 0
    low, high = roots.bound(shards, True), roots.bound(shards, False)
    while low < high:
        leaves = roots
        tried = sorted({low + (high - low) * k // (TRIED + 1) for k in range(TRIED + 1)})
        while tried:
            open_, wanted = [], set()
            for capacity in tried:
                if not low <= capacity < high:
                    continue
                enough, _, more = leaves.walk(capacity, shards, AHEAD)
                if enough is None:
                    open_.append(capacity)
                    wanted.update(more)
                elif enough:
                    high = capacity
                else:
                    low = capacity + 1
            tried = [c for c in open_ if low <= c < high]
            if tried:
                leaves = opened(leaves, wanted)
    leaves = roots
    while True:
        enough, cuts, more = leaves.walk(high, shards, AHEAD, exact=True)
        if enough:
            return [leaves.all[i].begin for i in cuts], high
        leaves = opened(leaves, set(more))


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", run_rows: int = 2000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    text = text_or_empty(text_col)
    slim = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shards",
    )
    cuts, _ = plan_cuts(slim, n_shards)
    place = F.lit(0)
    for cut in cuts:
        place = place + (F.col("h").bitwiseXOR(F.lit(_TOP)) >= F.lit(cut - (1 << 63))).cast("int")
    runs = max(1, -(-slim.count() // (n_shards * run_rows)))
    placed = slim.select("doc_id", "size", "text_crc32", place.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(runs)).alias("run"))
    first = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("shard", "run", (F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).alias("first"))
    rank = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("rank", rank)
        .join(first, ["shard", "run"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
