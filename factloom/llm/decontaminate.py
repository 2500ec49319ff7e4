"""Benchmark decontamination by n-grams of normalised words.

Windows of benchmark items (``n`` consecutive words; an item of fewer words is
one window) become a hash set that is broadcast to the workers: sorted 64-bit
fingerprints, with each window's place in one array of word ids and a list of
the items that hold it.  Workers scan each document once: words map to ids of
the benchmark's vocabulary, a rolling sum of random multiples of the ids gives a
fingerprint for each window, a bit table drops nearly all, and those left are
looked up and compared word for word.  Spans or whole documents can be removed.

A table's size is measured as built, and one of more than ``TABLE_BYTES`` is
halved before it is broadcast; a benchmark of several tables takes several
passes, each of which adds its spans to the rows of the one before.  A table is
read to the driver ``BLOCK_BYTES`` of text at most at a time; a single item
larger than that is a block of its own.

Defined results: null or empty text has no words and no hit; an item without
words has no window; items of equal text all count; repeated rows each get a
row; null item ids are passed over; other columns stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise

N = 10
BLOCK_BYTES, TABLE_BYTES = 8 << 20, 64 << 20

#: Bytes to words: ASCII upper case is folded, other ASCII but digits and letters splits, bytes from 0x80 on are word bytes.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class Windows:
    """The windows of a block of items, by their number of words."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.words: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        texts = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in text.encode().translate(_FOLD).split()], np.int32) for _, text in items]
        rng = np.random.default_rng(7)
        self.codes = rng.integers(1, 1 << 63, len(self.words) + 1, dtype=np.uint64)
        self.factors = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.ids = np.concatenate([*texts, np.empty(0, np.int32)])
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        self.tables = {}
        for size in sorted(set(np.minimum(lengths, n).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(lengths, n) == size)
            counts = lengths[own] - size + 1
            item = np.repeat(own, counts)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[item]
            self.tables[size] = self._table(size, item, place)

    def _prints(self, codes: np.ndarray, size: int) -> np.ndarray:
        out = codes[: len(codes) - size + 1] * self.factors[0]
        for j in range(1, size):
            out += codes[j : len(codes) - size + 1 + j] * self.factors[j]
        return out

    def _table(self, size: int, item: np.ndarray, place: np.ndarray) -> tuple:
        """Bits, sorted fingerprints, places and items of the distinct (window, item) pairs."""
        prints = self._prints(self.codes[self.ids], size)[place]
        order = np.lexsort((place, item, prints))
        prints, item, place = prints[order], item[order], place[order]
        # of an item's equal windows one is enough
        new = np.ones(len(prints), bool)
        words = np.lib.stride_tricks.sliding_window_view(self.ids, size)
        new[1:] = (prints[1:] != prints[:-1]) | (item[1:] != item[:-1])
        again = np.flatnonzero(~new)
        for at in range(0, len(again), 1 << 16):  # a few rows of words at a time
            k = again[at : at + (1 << 16)]
            new[k] = (words[place[k]] != words[place[k - 1]]).any(axis=1)
        prints, item, place = prints[new], item[new].astype(np.int32), place[new].astype(np.int32)
        shift = 64 - min(26, max(16, math.ceil(math.log2(16 * len(prints)))))
        bits = np.zeros(1 << (64 - shift), bool)
        bits[(prints >> np.uint64(shift)).astype(np.int64)] = True
        return np.uint64(shift), bits, prints, place, item

    def nbytes(self) -> int:
        """Of the arrays, and an estimate for the words (an object, an entry and a number each)."""
        tables = sum(x.nbytes for t in self.tables.values() for x in t[1:])
        return tables + self.ids.nbytes + self.codes.nbytes + sum(len(w) + 170 for w in self.words) + sum(len(i) + 60 for i in self.items)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit word spans (begin, end), items."""
        words = text.encode().translate(_FOLD).split()
        n = len(words)
        ids = np.fromiter(map(self.words.get, words, (0,) * n), np.int32, n)
        spans, items = [], set()
        codes = self.codes[ids]
        for size, (shift, bits, prints, place, item) in self.tables.items():
            if n < size:
                continue
            own = self._prints(codes, size)
            near = np.flatnonzero(bits[(own >> shift).astype(np.int64)])
            if not len(near):
                continue
            low, high = np.searchsorted(prints, own[near], "left"), np.searchsorted(prints, own[near], "right")
            near, low, high = near[high > low], low[high > low], high[high > low]
            if not len(near):
                continue
            # each window against all table rows of its fingerprint
            at = np.repeat(near, high - low)
            row = np.arange(len(at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            step = np.arange(size)
            for k in range(0, len(at), 1 << 16):
                a, r = at[k : k + (1 << 16)], row[k : k + (1 << 16)]
                same = (ids[a[:, None] + step] == self.ids[place[r][:, None] + step]).all(axis=1)
                spans += [(i, i + size) for i in np.unique(a[same]).tolist()]
                items |= {self.items[j] for j in np.unique(item[r[same]]).tolist()}
        return n, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


_HITS = "struct<n_words: long, begins: array<int>, ends: array<int>, items: array<string>>"


def _scanner(state):
    """``state``: a broadcast of the attributes of Windows, which need no module to unpickle."""

    def scan(text: pd.Series, begins: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        windows = Windows.__new__(Windows)
        windows.__dict__ = state.value
        rows = []
        for t, b, e, i in zip(text, begins, ends, items):
            n, spans, found = windows.scan(t or "")
            spans = merged([*spans, *zip(b, e)])
            rows.append((n, [x[0] for x in spans], [x[1] for x in spans], sorted(found.union(i))))
        return pd.DataFrame(rows, columns=["n_words", "begins", "ends", "items"])

    scan.__annotations__ = {"text": pd.Series, "begins": pd.Series, "ends": pd.Series, "items": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(scan, _HITS)


def tables(items: DataFrame, n: int, block_bytes: int, table_bytes: int):
    """The windows of all items (item, words) in tables of a bounded size, one after the other."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("words") + F.length("item")), F.lit(0)).alias("b")).first().b
    todo = [(max(1, math.ceil(size / block_bytes)), k) for k in range(max(1, math.ceil(size / block_bytes)))]
    while todo:
        parts, k = todo.pop()
        rows = [(r.item, r.words) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect()]
        built = Windows(rows, n)
        if built.nbytes() > table_bytes and len({item for item, _ in rows}) > 1:
            todo += [(2 * parts, k), (2 * parts, k + parts)]
        else:
            yield built


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES, out: str = "hits") -> DataFrame:
    """``docs`` with a column ``out``: n_words, begins and ends of hit word spans, items (as strings, sorted)."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("words"))
    none, no_text = F.array().cast("array<int>"), F.array().cast("array<string>")
    found = docs.withColumn(out, F.struct(F.lit(0).cast("long").alias("n_words"), none.alias("begins"), none.alias("ends"), no_text.alias("items")))
    for k, windows in enumerate(tables(items, n, block_bytes, table_bytes)):
        if k:
            found = materialise(found, "hits")
        found = found.withColumn(out, _scanner(spark.sparkContext.broadcast(vars(windows)))(F.col(text_col), f"{out}.begins", f"{out}.ends", f"{out}.items"))
    return found


@F.pandas_udf(T.StringType())
def without_spans(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    """The text without the words of the spans and what stands between them."""

    def cut(t, b, e):
        if t is None or not len(b):
            return t
        raw = t.encode()
        at, words, inside = [], np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20, None
        edges = np.flatnonzero(np.diff(np.concatenate(([False], words, [False])).astype(np.int8)))
        inside = edges.reshape(-1, 2)
        last = 0
        for x, y in zip(b, e):
            at.append(raw[last : inside[x][0]])
            last = inside[y - 1][1]
        return b"".join([*at, raw[last:]]).decode()

    return pd.Series([cut(t, b, e) for t, b, e in zip(text, begins, ends)], dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) without the hit words."""
    hits = free_name("_hits", docs)
    found = find_hits(docs, benchmark, out=hits, **options)
    if remove == "documents":
        return found.where(F.size(f"{hits}.begins") == 0).drop(hits)
    text = options.get("text_col", "text")
    return found.withColumn(text, without_spans(text, f"{hits}.begins", f"{hits}.ends")).drop(hits)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate(F.zip_with("hits.begins", "hits.ends", lambda b, e: e - b), F.lit(0), lambda a, x: a + x)
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.size("hits.begins") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rn,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT rn, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT d.rn, d.i, d.n, b.item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.g = b.g),
words AS (SELECT rn, count(DISTINCT i + k)::BIGINT AS n_hit FROM (SELECT rn, i, unnest(range(0, n)) AS k FROM hits) GROUP BY rn),
its AS (
  SELECT rn, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (rn) LEFT JOIN its USING (rn)
"""
