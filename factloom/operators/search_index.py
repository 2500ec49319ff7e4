"""Substring search by an index of trigrams: gram, ids, in folders that a search prunes by.

A text that holds a needle holds each of the needle's trigrams, so ids with all
of them are candidates, and only candidates' texts are read and searched.  The
index is appended to and never rewritten: a stale gram (of a changed or deleted
text) only adds a candidate that the search of the text refuses.

Defined results, as those of ``search.search``: letters' case is folded, the
needle is trimmed, a needle of white space finds every row, one of under three
letters has no trigram and reads all texts; a null haystack holds only the empty
needle; rows without an id are indexed under null; repeated rows all come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import search as Q

#: Folders of grams and of texts; grams of a folder are dealt to ``SPREAD`` writers by id, as a common gram has ids of most texts.
GRAM_FOLDERS, TEXT_FOLDERS, SPREAD = 64, 64, 8
#: Letters of a block: longer texts are cut into blocks that overlap by two letters.
BLOCK = 65_536
#: Letters (about) of the texts whose ids share a gram's row: a row for each text and gram would be some hundred times the rows.
LETTERS = 2_000_000
#: A needle's trigrams that are asked for (bits of a long); fewer only widen the candidates.
ASKED = 62


def _folder(x: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(n)).cast("int")


def _rows_of(texts: list[np.ndarray], ids: pa.Array):
    """Batches of gram, ids: each distinct gram of the texts (arrays of letters), and the ids of those that hold it."""
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    seen = np.zeros(0x110000, bool)
    seen[flat] = True
    letters, of = np.flatnonzero(seen), (np.cumsum(seen) - 1)[flat]
    base, n = len(letters), len(texts)
    if n > 1 and base**3 * n >= 2**63:  # a gram and the place of its text are one number
        yield from _rows_of(texts[: n // 2], ids[: n // 2])
        yield from _rows_of(texts[n // 2 :], ids[n // 2 :])
        return
    at = np.repeat(np.arange(n), lengths)
    key = ((of[:-2] * base + of[1:-1]) * base + of[2:]) * n + at[:-2]
    key = np.sort(key[at[:-2] == at[2:]])
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    gram, text = key // n, key % n
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    gram = gram[first]
    joined = letters[np.stack([gram // base**2, gram // base % base, gram % base], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), ids.take(pa.array(text)))
    yield pa.RecordBatch.from_arrays([pa.array([joined[i : i + 3] for i in range(0, len(joined), 3)], pa.string()), lists], names=["gram", "ids"])


def _postings(batches):
    for batch in batches:
        ids, texts, begin, size = batch.column("id"), [], 0, 0
        for i, text in enumerate(batch.column("text")):
            texts.append(np.frombuffer(text.as_py().decode("utf-8", "replace").encode("utf-32-le"), "<u4"))
            size += len(texts[-1])
            if size >= LETTERS or i + 1 == len(batch):
                yield from _rows_of(texts, ids[begin : i + 1])
                texts, begin, size = [], i + 1, 0


def postings(df: DataFrame, id_col: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """gram, ids: the distinct trigrams of blocks of rows' haystacks, with the ids of the rows; a gram has a row for each ``LETTERS`` or batch of a task."""
    hay = df.select(F.col(id_col).alias("id"), Q.haystack(df, columns).alias("hay")).where(F.length("hay") >= 3)
    starts = F.sequence(F.lit(1), F.length("hay") - 2, F.lit(block))
    blocks = hay.select("id", "hay", F.explode(starts).alias("at")).select("id", F.substring("hay", F.col("at"), F.lit(block + 2)).cast("binary").alias("text"))
    shape = T.StructType().add("gram", T.StringType()).add("ids", T.ArrayType(df.schema[id_col].dataType))
    return blocks.mapInArrow(_postings, shape)


def grams(df: DataFrame, id_col: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """gram, id: a row for each of ``postings``."""
    return postings(df, id_col, columns, block).select("gram", F.explode("ids").alias("id"))


def _place(columns: list[str]) -> str:
    """The column of a row's folder: a name that no column of the rows has."""
    name, taken = "place", {c.lower() for c in columns}
    while name in taken:
        name = f"text_{name}"
    return name


def add(df: DataFrame, id_col: str, columns: list[str], target: str, block: int = BLOCK) -> None:
    """Append rows and their grams to the index in ``target``, which is made if it isn't there."""
    place = _place(df.columns)
    df.limit(0).write.mode("overwrite").parquet(f"{target}/shape")  # an index of no rows has columns too
    rows = df.withColumn(place, _folder(F.col(id_col), TEXT_FOLDERS))
    rows.repartition(place, F.pmod(F.xxhash64(F.lit("spread"), id_col), F.lit(SPREAD))).sortWithinPartitions(place, id_col).write.mode("append").partitionBy(place).parquet(f"{target}/texts")
    found = postings(df, id_col, columns, block).withColumn("bucket", _folder(F.col("gram"), GRAM_FOLDERS))
    dealt = found.repartition("bucket", F.pmod(F.xxhash64(F.lit("spread"), F.get("ids", F.lit(0))), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{target}/grams")


def candidates(spark: SparkSession, target: str, id_col: str, needle: str) -> DataFrame:
    """id, folder of rows that hold all asked trigrams of a needle of three letters or more; folders and row groups of other grams are pruned."""
    low = needle.strip().lower()
    asked = list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))[:ASKED]
    id_type = spark.read.parquet(f"{target}/shape").schema[id_col].dataType
    shape = T.StructType().add("gram", T.StringType()).add("id", id_type).add("ids", T.ArrayType(id_type)).add("bucket", T.IntegerType())
    index = spark.read.schema(shape).parquet(f"{target}/grams")  # rows of one id are read too
    found = index.where(F.col("bucket").isin([_folder(F.lit(g), GRAM_FOLDERS) for g in asked]) & F.col("gram").isin(asked))
    hits = found.select("gram", F.explode(F.coalesce("ids", F.array("id"))).alias("id"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(F.array(*map(F.lit, asked)), F.col("gram")) - 1).cast("int"))
    whole = hits.groupBy("id").agg(F.bit_or(bit).alias("bits")).where(F.col("bits") == (1 << len(asked)) - 1)
    return whole.select("id", _folder(F.col("id"), TEXT_FOLDERS).alias("folder"))


def search(spark: SparkSession, target: str, id_col: str, columns: list[str], needle: str) -> DataFrame:
    """Rows of the index whose haystack holds the needle: the folders of candidates are read, the texts of candidates searched."""
    shape = spark.read.parquet(f"{target}/shape").schema
    place = _place(shape.names)
    rows = spark.read.schema(T.StructType([*shape.fields, T.StructField(place, T.IntegerType())])).parquet(f"{target}/texts")
    if len(needle.strip()) >= 3:
        found = candidates(spark, target, id_col, needle)
        folders = [r.folder for r in found.select("folder").distinct().collect()]  # TEXT_FOLDERS at most
        rows = rows.where(F.col(place).isin(folders)).join(found, rows[id_col].eqNullSafe(found["id"]), "left_semi")
    return Q.search(rows.drop(place), columns, needle)
