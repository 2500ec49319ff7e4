"""Exact removal of long byte strings that repeat, by run-length indexes.

A string of ``LENGTH`` bytes is keyed by the least hash of the ``GRAM``-grams in
it, so equal strings have equal keys.  Along a document, strings that follow
each other mostly share their key: they form one stretch of bytes, a document
yields about one stretch for 85 bytes, and each string lies in just one of them.
Stretches meet by key, first as 128-bit digests of their bytes only, streamed
with one digest in memory: equal stretches are settled at once, lone keys drop
out.  Of the others, one of each kind is fetched from its
document, and the stretches of a number of keys are indexed together: suffixes
are sorted, the Burrows-Wheeler transform is cut into runs, and suffix samples
are kept at both ends of each run.  The longest match of any position elsewhere
is only computed at run ends, where it can't be derived; along the text it falls
by one at each step, which is streamed to the matching statistics.  Positions
whose statistic reaches ``LENGTH`` start a repeated string.

A key with more distinct stretches than an index should hold (``KEY_BYTES``)
compares 128-bit hashes of its strings instead, of those that lie within what
some other stretch of the key has in common on the left and on the right.  A key
of which even the stretches are too many to hold (``HELD_BYTES``) sends its
strings' hashes to one more aggregate.

Defined results: null text is empty; a text shorter than ``LENGTH`` keeps all;
repeated rows are documents of their own, so they remove each other; ties don't
exist (all occurrences go); a null id is one document per text; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_or_empty

LENGTH, GRAM = 200, 32
INDEX_BYTES, KEY_BYTES, HELD_BYTES = 256 << 10, 1 << 20, 8 << 20
_M1 = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(m: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2^64, at least n of each."""
    have = _POWERS.get(int(m))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 14, 2 * (0 if have is None else len(have[0])))
        up, down = np.full(size, m), np.full(size, np.uint64(pow(int(m), -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _POWERS[int(m)] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def digests(raw: bytes, begin: list[int], end: list[int]) -> np.ndarray:
    """Two 64-bit halves of a digest of each stretch of bytes."""
    out = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin, end)]), np.int64)
    return out.reshape(-1, 2).T


class Prints:
    """Hashes of any substrings of a text, from prefix sums, for keys: what has equal keys is compared by other means."""

    def __init__(self, raw: np.ndarray, m: np.uint64):
        n = len(raw)
        self.up, down = _powers(m, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.up[begin] + (end - begin).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(x)
    size = -(-n // width) * width
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _recurs(grams: np.ndarray, least: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Whether a stretch holds its key's gram twice, without which none of its strings can recur in it."""
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(~_least(~np.concatenate((edge, least, edge)), width) == grams)  # least of some string
    values, rank = np.unique(grams[chosen], return_inverse=True)
    places = np.sort(rank * (len(grams) + 1) + chosen)
    base = np.searchsorted(values, keys) * (len(grams) + 1)
    return np.searchsorted(places, base + last + width - 1, side="right") - np.searchsorted(places, base + first, side="left") > 1


def stretches(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """key, two digests, first and last start, may recur in itself: of each stretch."""
    n, gram = len(raw), min(GRAM, length)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none.astype(bool)
    one = Prints(raw, _M1)
    at = np.arange(n - gram + 1)
    grams = one.of(at, at + gram)
    keys = _least(grams, length - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    last = np.append(first[1:], len(keys)) - 1
    g1, g2 = digests(raw.tobytes(), first.tolist(), (last + length).tolist())
    own = _recurs(grams, keys, keys[first], first, last, length - gram + 1)
    return keys[first].view(np.int64), g1, g2, first, last, own


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of several texts, with suffix samples at run ends."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) + 1 for t in texts])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        codes = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        self.codes = codes
        codes[self.ends - 1] = 0  # ends of texts; matches are cut there
        self.n = n = len(codes)
        # suffixes by their first seven letters, then by twice as many in turn
        padded = np.concatenate([codes, np.zeros(7, np.int64)])
        packed = np.zeros(n, np.int64)
        for j in range(7):
            packed = (packed << 9) | padded[j : j + n]
        order = np.argsort(packed, kind="stable")
        ordered = packed[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[order] = first  # the place where the class of equal prefixes begins
        open_ = np.sort(order[~fresh | np.append(~fresh[1:], False)])  # in classes of several
        width = 7
        self.ranks: list[tuple[int, np.ndarray]] = []
        while True:
            self.ranks.append((width, rank))
            if not len(open_):
                break
            old = rank[open_].astype(np.int64)
            later = open_ + width
            key = old * (n + 1) + np.where(later < n, rank[np.minimum(later, n - 1)].astype(np.int64) + 1, 0)
            by = np.argsort(key, kind="stable")
            key, old, open_ = key[by], old[by], open_[by]
            at = np.arange(len(key))
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            whole = np.concatenate(([True], old[1:] != old[:-1]))
            place = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(whole, at, 0))
            rank = rank.copy()
            rank[open_] = place
            open_ = np.sort(open_[~fresh | np.append(~fresh[1:], False)])
            width *= 2
        order = np.empty(n, np.int64)
        order[self.ranks[-1][1]] = np.arange(n)
        before = codes[order - 1]
        before[rank[0]] = -1  # nothing stands before the first text
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_starts = np.concatenate(([0], change))
        self.run_heads = before[self.run_starts]
        self.first_samples = order[self.run_starts]
        self.last_samples = order[np.append(change, n) - 1]
        # the neighbours across run borders
        self._above = order[np.maximum(self.run_starts - 1, 0)]
        self._below = order[np.minimum(np.append(change, n), n - 1)]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes, from the ranks of each doubling."""
        total = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.ranks[:-1]):
            same = rank[np.minimum(a + total, self.n - 1)] == rank[np.minimum(b + total, self.n - 1)]
            total += width * same
        going = a != b
        for _ in range(6):  # widths are multiples of seven
            x, y = a + total, b + total
            going &= (x < self.n) & (y < self.n)
            going &= self.codes[np.minimum(x, self.n - 1)] == self.codes[np.minimum(y, self.n - 1)]
            total += going
        total[a == b] = 0
        return total

    def matching_statistics(self) -> np.ndarray:
        """At each position, the length of the longest match, within its text, that starts anywhere else."""
        out = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        left = np.repeat(self.ends - 1, self.ends - self.starts) - place
        for samples, others in ((self.first_samples, self._above), (self.last_samples, self._below)):
            reach = np.full(self.n, -1, np.int64)
            np.maximum.at(reach, samples, self._common(samples, others) + samples)
            np.maximum(out, np.maximum.accumulate(reach) - place, out=out)
        return np.minimum(out, left)


_STRETCH = "key long, g1 long, g2 long, doc long, row long, first int, last int, own boolean"


def _cut(frames):
    for pdf in frames:
        cols: list[list] = [[] for _ in range(8)]
        size = 0
        for doc, row, text in zip(pdf["doc"], pdf["row"], pdf["text"]):
            found = stretches(np.frombuffer(text.encode(), np.uint8))
            for c, x in zip(cols, (*found[:3], np.full(len(found[0]), doc), np.full(len(found[0]), row), *found[3:])):
                c.append(x)
            size += len(found[0])
            if size > 200_000:
                yield _frame(cols)
                cols, size = [[] for _ in range(8)], 0
        if size:
            yield _frame(cols)


def _frame(cols: list[list]) -> pd.DataFrame:
    names = ("key", "g1", "g2", "doc", "row", "first", "last", "own")
    out = {n: np.concatenate(c) for n, c in zip(names, cols)}
    return pd.DataFrame({n: x.astype(np.int32) if n in ("first", "last") else x for n, x in out.items()})


_MET = "kind int, key long, doc long, row long, first int, last int"


_WHERE = ["key", "doc", "row", "first", "last"]


def _meet(frames):
    """Kind 0: the stretch has an equal one.  Kind 1: fetch it; kind 2: fetch it as a partner only (it has an equal one).

    Rows come sorted by key and digests.  A key with one digest needs
    no bytes, unless its stretch can recur in itself.  What a digest's first row
    is for is known when the next digest begins, so that one row waits, with
    whether its digest has had others and its key other digests.
    """
    held, twin, sibling = None, False, False

    def kind(rows: pd.DataFrame, k: int) -> pd.DataFrame:
        return rows[_WHERE].assign(kind=np.int32(k))[["kind", *_WHERE]]

    for pdf in frames:
        if not len(pdf):
            continue
        waiting = held is not None
        pdf = pd.concat([held, pdf], ignore_index=True) if waiting else pdf.reset_index(drop=True)
        key, g1, g2 = (pdf[c].to_numpy() for c in ("key", "g1", "g2"))
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])))
        begins = np.flatnonzero(fresh)
        counts = np.diff(np.append(begins, len(pdf)))
        several = counts > 1
        several[0] |= waiting and twin
        others = np.zeros(len(begins), bool)  # digests whose key has another
        same = key[begins[1:]] == key[begins[:-1]]
        others[:-1] |= same
        others[1:] |= same
        others[0] |= waiting and sibling
        equal = np.repeat(several, counts)
        if waiting and twin:
            equal[0] = False  # it has left as kind 0 before
        yield kind(pdf[equal], 0)
        done, last = begins[:-1], begins[-1]
        needed = others[:-1] | pdf["own"].to_numpy()[done]
        yield kind(pdf.iloc[done[needed & ~several[:-1]]], 1)
        yield kind(pdf.iloc[done[needed & several[:-1]]], 2)
        held, twin, sibling = pdf.iloc[last : last + 1], bool(several[-1]), bool(others[-1])
    if held is not None and (sibling or held["own"].iloc[0]):
        yield kind(held, 2 if twin else 1)


_BYTES = "key long, alone boolean, doc long, row long, first int, bytes binary"


def _fetch(length: int):
    def run(frames):
        for pdf in frames:
            rows = []
            for doc, row, text, asked in zip(pdf["doc"], pdf["row"], pdf["text"], pdf["asked"]):
                raw = text.encode()
                rows += [(a["key"], a["kind"] == 1, doc, row, a["first"], raw[a["first"] : a["last"] + length]) for a in asked]
            yield pd.DataFrame(rows, columns=["key", "alone", "doc", "row", "first", "bytes"]).astype({"first": np.int32})

    return run


_FOUND = "kind int, doc long, row long, begin int, end int, h1 long, h2 long"


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of starts whose strings touch or overlap, as (begin, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.concatenate(([0], cut))].tolist(), (starts[np.append(cut, len(starts)) - 1] + length).tolist()))


def _shared(parts: list[bytes]) -> list[int]:
    """For each part, its longest common prefix with any other."""

    def common(a: bytes, b: bytes) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[:mid] == b[:mid]:
                low = mid
            else:
                high = mid - 1
        return low

    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _reach(stretches_: list[bytes], key: int, length: int) -> list[tuple[int, int]]:
    """Begin and end within which a string of each stretch can recur: as far as any other stretch agrees to the left and to the right of the key's gram.

    A stretch that holds the gram more than once is left whole, and makes all others be so.
    """
    gram = min(GRAM, length)
    places = []
    for raw in stretches_:
        at = np.arange(len(raw) - gram + 1)
        found = np.flatnonzero(Prints(np.frombuffer(raw, np.uint8), _M1).of(at, at + gram).view(np.int64) == key)
        if len(found) != 1:
            return [(0, len(raw)) for raw in stretches_]
        places.append(int(found[0]))
    left = _shared([raw[:g][::-1] for raw, g in zip(stretches_, places)])
    right = _shared([raw[g:] for raw, g in zip(stretches_, places)])
    return [(g - x, g + y) for g, x, y in zip(places, left, right)]


def _compare(length: int):
    def indexed(held: list[tuple]) -> list[tuple]:
        index = RunIndex([x[4] for x in held])
        hit = index.matching_statistics() >= length
        out = []
        for (alone, doc, row, first, _), begin, end in zip(held, index.starts, index.ends):
            if alone:
                out += [(0, doc, row, first + a, first + b, 0, 0) for a, b in spans_of(np.flatnonzero(hit[begin:end]), length)]
        return out

    def prints(raw: bytes, at: np.ndarray) -> np.ndarray:
        return digests(raw, at.tolist(), (at + length).tolist())

    def hashed(held: list[tuple]):
        """Rows of all strings' hashes, for a key of which only a part is held."""
        out = []
        for alone, doc, row, first, raw in held:
            at = np.arange(len(raw) - length + 1)
            h1, h2 = prints(raw, at)
            out += [(1 if alone else 2, doc, row, first + s, first + s + length, a, b) for s, a, b in zip(at.tolist(), h1.tolist(), h2.tolist())]
            if len(out) > 50_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def settled(held: list[tuple], key: int):
        """Spans of a whole key that is too large for an index, by hashes of the strings that can recur."""
        parts = []
        for k, (begin, end) in enumerate(_reach([x[4] for x in held], key, length)):
            at = np.arange(begin, end - length + 1)
            if len(at):
                parts.append(np.stack([np.full(len(at), k), at, *prints(held[k][4], at)]))
        if not parts:
            return
        which, at, h1, h2 = np.concatenate(parts, axis=1)
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        hit = np.zeros(len(order), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        which, at = which[hit], at[hit]
        edges = np.flatnonzero(np.diff(which)) + 1
        out = []
        for starts, k in zip(np.split(at, edges), which[np.concatenate(([0], edges))] if len(which) else []):
            alone, doc, row, first, _ = held[k]
            if alone:
                out += [(0, doc, row, first + a, first + b, 0, 0) for a, b in spans_of(starts, length)]
        if out:
            yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["kind", "doc", "row", "begin", "end", "h1", "h2"]).astype({"kind": np.int32, "begin": np.int32, "end": np.int32})

    def run(frames):
        ready, ready_bytes = [], 0  # stretches of whole keys
        group, group_bytes, key, parted = [], 0, None, False

        def close():
            """What the group that has ended yields."""
            nonlocal ready, ready_bytes
            if parted:
                yield from hashed(group)
            elif group_bytes > KEY_BYTES:
                yield from settled(group, key)
            else:
                ready += group
                ready_bytes += group_bytes
            if ready_bytes >= INDEX_BYTES:
                yield frame(indexed(ready))
                ready, ready_bytes = [], 0

        for pdf in frames:
            for k, alone, doc, row, first, raw in zip(pdf["key"], pdf["alone"], pdf["doc"], pdf["row"], pdf["first"], pdf["bytes"]):
                if k != key:
                    yield from close()
                    group, group_bytes, key, parted = [], 0, k, False
                elif group_bytes > HELD_BYTES:  # more than is held: all strings of such a key go
                    yield from hashed(group)
                    group, group_bytes, parted = [], 0, True
                group.append((alone, doc, row, first, raw))
                group_bytes += len(raw)
        yield from close()
        if ready:
            yield frame(indexed(ready))

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, row, spans (begin, end in bytes, sorted, apart) of each document (doc, row, text) with repeated strings."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.mapInPandas(_cut, _STRETCH).repartition(n, "key").sortWithinPartitions("key", "g1", "g2")
    met = materialise(cut.mapInPandas(_meet, _MET), "met")
    asked = met.where("kind > 0").groupBy("doc", "row").agg(F.collect_list(F.struct("kind", "key", "first", "last")).alias("asked"))
    fetched = docs.join(asked, ["doc", "row"]).select("doc", "row", "text", "asked").mapInPandas(_fetch(length), _BYTES)
    fetched = fetched.repartition(n, "key").sortWithinPartitions("key")
    found = materialise(fetched.mapInPandas(_compare(length), _FOUND), "found")
    strings = found.where("kind > 0")
    if not strings.isEmpty():
        often = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        strings = strings.where("kind = 1").join(often, ["h1", "h2"], "left_semi")
    whole = met.where("kind = 0").select("doc", "row", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    spans = whole.unionByName(found.where("kind = 0").select("doc", "row", "begin", "end")).unionByName(strings.select("doc", "row", "begin", "end"))
    listed = spans.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("x"))
    return listed.select("doc", "row", F.pandas_udf(_joined, _SPANS)("x.begin", "x.end").alias("spans"))


_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _joined(begins: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for bs, es in zip(begins, ends):
        b, e = np.asarray(bs), np.maximum.accumulate(np.asarray(es))
        cut = np.flatnonzero(b[1:] > e[:-1]) + 1
        out.append([{"begin": int(x), "end": int(y)} for x, y in zip(b[np.concatenate(([0], cut))], e[np.append(cut, len(b)) - 1])])
    return pd.Series(out, dtype=object)


_joined.__annotations__ = {"begins": pd.Series, "ends": pd.Series, "return": pd.Series}


def _left(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    """sha256 of the bytes outside the spans; null where there is no span."""

    def sha(t, bs, es):
        raw, at, h = t.encode(), 0, hashlib.sha256()
        for b, e in zip(bs, es):
            h.update(raw[at:b])
            at = e
        h.update(raw[at:])
        return h.hexdigest()

    return pd.Series([None if bs is None else sha(t, bs, es) for t, bs, es in zip(text, begins, ends)], dtype=object)


_left.__annotations__ = {"text": pd.Series, "begins": pd.Series, "ends": pd.Series, "return": pd.Series}


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, text (not null), spans (null where nothing repeats)."""
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    spans = materialise(repeated_spans(keyed.select("doc", "row", "text").where(F.octet_length("text") >= length), length), "spans")
    return keyed.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")


def digest(docs: DataFrame) -> DataFrame:
    out = with_spans(docs)
    sha = F.pandas_udf(_left, T.StringType())(F.when(F.col("spans").isNotNull(), F.col("text")), "spans.begin", "spans.end")
    size = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["begin"]))
    return out.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce(size, F.lit(0)).alias("n_removed"),
        F.coalesce(F.array_size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(sha, F.sha2("text", 256)).alias("kept_sha256"),
    )
