"""Hard negatives for anchors, by a search over buckets of falling norm.

Vectors become integers (``floor(256 * x)``), so scores are exact.  All rows are
sorted by norm, largest first, and written so; a batch of them is a bucket with
a largest norm.  By Cauchy-Schwarz no row of a bucket scores more than the
anchor's norm times that, so an anchor's window skips a bucket whose bound lies
below the window's lower limit or below the running k-th score; whole row groups
under every limit of a block of anchors aren't read.

Anchors are taken in blocks of a bounded size (``BLOCK_BYTES``), each sent to
all tasks, so work grows with anchors times rows and nothing else is copied.  A
block is scanned twice: for each anchor's first rows of its own label, then for
the windows that these scores open.  The bucket of the largest norms is read
first, and its k-th scores limit what the other tasks read and return.  Each
task returns at most k rows for a window, of which Spark keeps the first k.

Defined results: rows with a null id, label or vector, or with a null, NaN or
infinite component take no part; missing components of a shorter vector count as
0, so an empty vector scores 0; rows with the anchor's id are no positives of
it; repeated rows are rows each, so a repeated anchor gives its rows twice and a
repeated row takes two ranks; ties go to the smaller id; a positive score of 0
takes negatives of score 0, a negative one none (its limits cross); integer
components are clamped to +-2**31, scores to 64 bits; an empty table, or one
without anchors, gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialise

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Bytes of one block of anchors as it is sent to the tasks, at 8 a component.
BLOCK_BYTES = 16 << 20
#: Windows whose scores are held at once in a task, times the rows of a batch.
CHUNK_CELLS = 4 << 20
#: Rows of a written file, and so of the tasks' inputs, at most.
FILE_ROWS = 100_000
CLAMP = 1 << 31

_FOUND = T.StructType([T.StructField("window", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", T.LongType())])


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shift: Column | None = None) -> DataFrame:
    """id, label, q (integer components), norm of the rows that take part, largest norms first in each file and over files."""
    at = f"CAST({vector_col} AS ARRAY<DOUBLE>)"
    sound = rows.where(f"`{id_col}` IS NOT NULL AND `{label_col}` IS NOT NULL AND `{vector_col}` IS NOT NULL").where(
        F.expr(f"NOT exists({at}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    )
    label = F.col(label_col).cast("long")
    whole = sound.select(
        F.col(id_col).cast("long").alias("id"),
        (label if shift is None else F.when(shift, (label + 1) % 10).otherwise(label)).alias("label"),
        F.expr(f"transform({at}, x -> CAST(greatest(-{CLAMP}D, least({CLAMP}D, floor(least(greatest(256 * x, -1e18D), 1e18D)))) AS BIGINT))").alias("q"),
    )
    whole = whole.withColumn("norm", F.sqrt(F.expr("aggregate(q, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)")))
    flat = materialise(whole, "vectors")
    files = max(1, -(-flat.count() // FILE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal norms are dealt by a hash of the id, so a vector that a third of the rows hold is no hot range
    dealt = flat.withColumn("deal", F.xxhash64("id")).repartitionByRange(files, F.col("norm").desc(), "deal")
    return materialise(dealt.sortWithinPartitions(F.col("norm").desc(), "deal").drop("deal"), "norms")


def _matrix(q: list, width: int) -> np.ndarray:
    out = np.zeros((len(q), width), np.float64)
    for i, x in enumerate(q):
        out[i, : min(len(x), width)] = x[:width]
    return out


def _scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products: in floating point where Cauchy-Schwarz keeps every partial sum exact, else in Python's integers."""
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Windows:
    """What is searched for: for each window its anchor, score limits, whether rows of the anchor's label count, and how many."""

    def __init__(self, q: list, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, first: int):
        self.width = max((len(x) for x in q), default=0)
        self.q = _matrix(q, self.width)
        self.norms = np.sqrt((self.q**2).sum(axis=1))
        self.ids, self.labels, self.anchor, self.low, self.high, self.same, self.first = ids, labels, anchor, low, high, same, first

    def least_norm(self) -> float:
        """No row of a smaller norm can enter a window."""
        limits = self.low / np.maximum(self.norms[self.anchor], 1e-9)
        return float(max(0.0, np.where(self.low <= 0, 0.0, limits).min(initial=np.inf)) * (1 - 1e-9))

    def scan(self, buckets: Iterator[pd.DataFrame]) -> pd.DataFrame:
        n = len(self.anchor)
        bound = self.low.copy()  # the larger of the lower limit and the running k-th score
        kept_w, kept_s, kept_i = (np.zeros(0, np.int64) for _ in range(3))
        for rows in buckets:
            if not len(rows):
                continue
            x, ids, labels = _matrix(list(rows["q"]), self.width), rows["id"].to_numpy(), rows["label"].to_numpy()
            largest = float(rows["norm"].max()) * (1 + 1e-9)
            reach = np.maximum(self.norms[self.anchor] * largest, 0) * (1 + 1e-9)
            alive = np.flatnonzero((reach >= bound) & (self.low <= self.high))
            step = max(1, CHUNK_CELLS // len(rows))
            fresh = []
            for at in range(0, len(alive), step):
                w = alive[at : at + step]
                mine, back = np.unique(self.anchor[w], return_inverse=True)
                s = _scores(self.q[mine], x, float(self.norms[mine].max()) * largest)[back]
                fits = (labels[None, :] == self.labels[self.anchor[w], None]) == self.same
                if self.same:
                    fits &= ids[None, :] != self.ids[self.anchor[w], None]
                fits &= (s >= bound[w, None]) & (s <= self.high[w, None])
                r, c = np.nonzero(fits)
                fresh.append(self._first(w[r], s[r, c], ids[c]))
            if fresh:
                kept_w, kept_s, kept_i = self._first(*(np.concatenate([old, *new]) for old, new in zip((kept_w, kept_s, kept_i), zip(*fresh))))
                ends = np.flatnonzero(np.diff(kept_w, append=-1))
                full = ends[np.bincount(kept_w, minlength=n)[kept_w[ends]] == self.first]
                bound[kept_w[full]] = np.maximum(bound[kept_w[full]], kept_s[full])
        return pd.DataFrame({"window": kept_w, "score": kept_s, "id": kept_i})

    def _first(self, w: np.ndarray, s: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window the first rows, by falling score and then by id."""
        order = np.lexsort((i, ~s, w))
        w, s, i = w[order], s[order], i[order]
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        rank = np.arange(len(w)) - np.repeat(starts, np.diff(starts, append=len(w)))
        stay = rank < self.first
        return w[stay], s[stay], i[stay]


def _search(rows: DataFrame, windows: Windows) -> DataFrame:
    """window, score, id, rank: the first rows of each window over all buckets."""
    sent = rows.sparkSession.sparkContext.broadcast(windows)

    def task(buckets: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield sent.value.scan(buckets)

    found = rows.where(F.col("norm") >= windows.least_norm()).select("id", "label", "q", "norm").mapInPandas(task, _FOUND)
    order = W.partitionBy("window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.first)


def _blocks(anchors: DataFrame) -> Iterator[pd.DataFrame]:
    """Anchors in blocks of at most BLOCK_BYTES; the driver holds one of them."""
    held, size = [], 0
    for row in anchors.toLocalIterator():
        held.append((row["id"], row["label"], row["q"]))
        size += 8 * len(row["q"]) + 64
        if size >= BLOCK_BYTES:
            yield pd.DataFrame(held, columns=["id", "label", "q"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["id", "label", "q"])


def _limits(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer scores of the window that a positive's score opens (crossed if the score is negative)."""
    exact = [int(p) for p in scores]
    low = np.array([-(-LOW * p // 100) for p in exact], np.int64)
    high = np.array([HIGH * p // 100 for p in exact], np.int64)
    return low, high


def _mine_block(rows: DataFrame, top: DataFrame, block: pd.DataFrame) -> DataFrame:
    q, ids, labels = list(block["q"]), block["id"].to_numpy(np.int64), block["label"].to_numpy(np.int64)
    n = len(block)
    least = np.full(n, -(2**63), np.int64)
    every = Windows(q, ids, labels, np.arange(n), least, np.full(n, 2**63 - 1, np.int64), True, POSITIVES)
    # the k-th score among the rows of the largest norms is a lower limit for all others
    for r in _search(top, every).where(F.col("rank") == POSITIVES).collect():  # at most one row an anchor of the block
        every.low[r["window"]] = r["score"]
    positives = _search(rows, every).toPandas()  # at most POSITIVES rows an anchor of the block
    positives = positives.sort_values(["window", "rank"], ignore_index=True)
    scores = positives["score"].to_numpy(np.int64)
    low, high = _limits(scores)
    windows = Windows(q, ids, labels, positives["window"].to_numpy(np.int64), low, high, False, NEGATIVES)
    spark = rows.sparkSession
    names = pd.DataFrame({"window": np.arange(len(scores)), "anchor_id": ids[positives["window"].to_numpy(np.int64)], "positive_id": positives["id"].to_numpy(np.int64), "positive_score": scores})
    told = spark.createDataFrame(names, "window long, anchor_id long, positive_id long, positive_score long")
    return (
        _search(rows, windows)
        .join(F.broadcast(told), "window")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shift: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor.

    ``anchor`` and ``shift`` are conditions on ``id`` (which rows are anchors)
    and on the input's columns (whose labels move to the next).
    """
    held = vectors(rows, id_col, vector_col, label_col, shift)
    edge = held.agg(F.count(F.lit(1)).alias("n"), F.approx_percentile("norm", 0.95, 1000).alias("norm")).first()
    top = held.where(F.col("norm") >= (edge["norm"] if edge["norm"] is not None else 0.0))
    out = None
    for k, block in enumerate(_blocks(held.where(anchor))):
        part = materialise(_mine_block(held, top, block), f"negatives{k}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


ORACLE = r"""
WITH sound AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM sound a, sound b WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM scores WHERE same AND id <> anchor_id) WHERE k <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.k ORDER BY n.score DESC, n.id)::INTEGER AS rank
  FROM positives p JOIN scores n ON n.ar = p.ar AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
