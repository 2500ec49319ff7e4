"""Line dedup across documents.

Hashes of line keys are written once, range-partitioned on (hash, document,
position) and sorted within partitions, so a line that a third of all documents
hold spreads over many partitions.  Each partition is streamed once: the first
document of a key is remembered, later documents' positions are dropped.  The
key with which a partition begins may have begun before it; its rows wait, and
are settled by a join with the first documents of the keys at partition borders
(two rows for each partition, so broadcast).  What comes out is a compressed
bitmap of kept lines for each document that loses any (``keep_bitmaps``): it
ends with the last line that goes, lines beyond it stay.  Texts move only if
bitmaps are applied to them, and not even then while the bitmaps' measured size
allows a broadcast.

Keys are compared by 128 bits of hash.  Defined results: a null or empty text is
one empty line; a null id counts as the largest id; rows that share an id are
one document to the rule "in at least two documents", and each row is judged by
its own text; an empty table gives an empty result; other columns stay as they
are.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACES, UPPER, free_name, materialise, text_or_empty

MIN_CHARS = 10
BROADCAST_BYTES = 16 << 20
_LAST = (1 << 63) - 1


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, row (hash of the row's text), pos, h1, h2 of each line that is long enough."""
    text = text_or_empty(text_col)
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = F.trim(F.translate(F.col("line"), UPPER, LOWER), F.lit(SPACES))
    rows = rows.select("doc", "row", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return rows.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


_OUT = "kind int, doc long, row long, pos int, h1 long, h2 long"


def _stream(batches):
    """Rows of kind 0 are dropped, of kind 1 wait, of kind 2 give a border key's first document."""
    last = None  # key of the row before, and the first document of that key here
    lead = None  # the partition's first key
    for pdf in batches:
        if not len(pdf):
            continue
        h1, h2, doc = (pdf[c].to_numpy() for c in ("h1", "h2", "doc"))
        fresh = np.ones(len(pdf), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        out = []
        if last is not None:
            fresh[0] = (h1[0], h2[0]) != last[:2]
        else:
            lead = (h1[0], h2[0])
            out.append((2, doc[0], h1[0], h2[0]))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(pdf)), -1))
        first = np.where(start >= 0, doc[np.maximum(start, 0)], last[2] if last is not None else 0)
        waiting = (h1 == lead[0]) & (h2 == lead[1])
        gone = (doc != first) & ~waiting
        last = (h1[-1], h2[-1], first[-1])
        picked = np.flatnonzero(gone | waiting)
        yield pd.DataFrame({"kind": waiting[picked].astype(np.int32), "doc": doc[picked], "row": pdf["row"].to_numpy()[picked], "pos": pdf["pos"].to_numpy()[picked], "h1": h1[picked], "h2": h2[picked]})
        if out:
            yield _border(*out[0])
    if last is not None:
        yield _border(2, last[2], last[0], last[1])


def _border(kind, doc, h1, h2):
    return pd.DataFrame({"kind": np.array([kind], np.int32), "doc": [doc], "row": [0], "pos": np.array([0], np.int32), "h1": [h1], "h2": [h2]})


@F.pandas_udf(T.BinaryType())
def _bitmap(positions: pd.Series) -> pd.Series:
    def pack(at):
        kept = np.ones(8 * (max(at) // 8 + 1), bool)  # whole bytes
        kept[np.asarray(at)] = False
        return zlib.compress(np.packbits(kept).tobytes())

    return pd.Series([pack(a) for a in positions], dtype=object)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, partitions: int | None = None) -> DataFrame:
    """doc, row (hash of the text), n_dropped, keep_bitmap: one row for each (id, text) that loses lines."""
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = materialise(line_keys(docs, id_col, text_col, min_chars), "keys")
    dealt = keys.repartitionByRange(parts, "h1", "h2", "doc", "row", "pos").sortWithinPartitions("h1", "h2", "doc", "row", "pos")
    streamed = materialise(dealt.mapInPandas(_stream, _OUT), "lines")
    borders = streamed.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    waiting = streamed.where("kind = 1").join(F.broadcast(borders), ["h1", "h2"]).where("doc <> first")
    gone = streamed.where("kind = 0").select("doc", "row", "pos").unionByName(waiting.select("doc", "row", "pos"))
    positions = gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("at"))
    return positions.select("doc", "row", F.size("at").cast("long").alias("n_dropped"), _bitmap("at").alias("keep_bitmap"))


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Of each line, whether it stays; the bits are padded by ones."""
    kept = np.ones(n_lines, bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
    kept[: len(bits)] = bits
    return kept


def _kept_text(text: str, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text
    lines = text.split("\n")
    return "\n".join(line for line, keep in zip(lines, unpack(bitmap, len(lines))) if keep)


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _kept_text(t, b) for t, b in zip(text, bitmap)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept_sha(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else hashlib.sha256(_kept_text(t, b).encode()).hexdigest() for t, b in zip(text, bitmap)], dtype=object)


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with n_lines, n_dropped and keep_bitmap (null: every line stays).

    Rows that lose lines go by their id and text hash to the bitmaps; beyond
    ``BROADCAST_BYTES`` of bitmaps both sides are shuffled, and AQE may split
    the join where one id has many rows.
    """
    text = text_or_empty(text_col)
    doc, row, dropped = (free_name(c, docs) for c in ("_doc", "_row", "_dropped"))
    bitmaps = materialise(keep_bitmaps(docs, id_col, text_col, **options), "bitmaps").withColumnsRenamed({"doc": doc, "row": row, "n_dropped": dropped})
    size = bitmaps.agg(F.coalesce(F.sum(F.octet_length("keep_bitmap") + 64), F.lit(0)).alias("b")).first().b
    bitmaps = F.broadcast(bitmaps) if size <= BROADCAST_BYTES else bitmaps
    keyed = docs.drop("n_dropped", "keep_bitmap").withColumns({doc: F.coalesce(F.col(id_col), F.lit(_LAST)), row: F.xxhash64(text), "n_lines": F.size(F.split(text, "\n")).cast("long")})
    joined = keyed.join(bitmaps, [doc, row], "left")
    return joined.withColumn("n_dropped", F.coalesce(dropped, F.lit(0))).drop(doc, row, dropped)


def digest(docs: DataFrame) -> DataFrame:
    marked = with_bitmaps(docs.select("doc_id", "text"))
    text = text_or_empty("text")
    sha = F.when(F.col("keep_bitmap").isNull(), F.sha2(text, 256)).otherwise(_kept_sha(F.when(F.col("keep_bitmap").isNotNull(), text), F.col("keep_bitmap")))
    return marked.select("doc_id", "n_lines", "n_dropped", sha.alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, row_no, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (
  SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING min(coalesce(doc_id, 9223372036854775807)) <> max(coalesce(doc_id, 9223372036854775807))),
marked AS (
  SELECT q.*, coalesce(f.first_doc <> coalesce(q.doc_id, 9223372036854775807), false) AS gone
  FROM keyed q LEFT JOIN firsts f ON q.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row_no
"""
