import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import search as Q
from factloom.operators import search_index as SI

SHAPE = "id long, text string, source string, place string"


def rows(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abAB \U0001f600\n\u00e9") for _ in range(rng.choice([0, 1, 2, 3, 7, 40]))) for _ in range(n)]
    return [(i, t, rng.choice([None, "ab", "Source One"]), "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("index") / "grams")
    odd = [(None, "Aab no id", "s", "x"), (5, "aab twice", "s", "y"), (5, "aab twice", "s", "y"), (6, None, None, None), (7, "baa " * 50_000 + "the very end", "s", "x")]
    all_rows = spark.createDataFrame(rows(60, 1) + odd + rows(60, 2), SHAPE)
    for part in (all_rows.where("place = 'x'"), all_rows.where("place <> 'x' OR place IS NULL")):
        SI.add(part, "id", ["text", "source"], target, block=5_000)
    return target, all_rows.cache()


@pytest.mark.parametrize("needle", ["aab", " AAB ", "a\U0001f600b", "\U0001f600", "\u00c9a", "ce one", "the very end", "b", "", "ab ab", "nowhere at all", "ba" * 200])
def test_finds_what_a_scan_finds(spark, index, needle):
    target, everything = index
    want = Q.search(everything, ["text", "source"], needle)
    got = SI.search(spark, target, "id", ["text", "source"], needle)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_blocks_lose_no_trigram(spark):
    df = spark.createDataFrame(rows(40, 3), SHAPE)
    got = {(r.id, r.gram) for r in SI.grams(df, "id", ["text"], block=4).collect()}
    want = {(i, t[k : k + 3].lower()) for i, t, _, _ in rows(40, 3) for k in range(len(t) - 2)}
    assert got == want


def test_plan_reads_folders_of_candidates(spark, index):
    found = SI.candidates(spark, index[0], "id", "the very end")
    assert [r.id for r in found.collect()] == [7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan
    texts = SI.search(spark, index[0], "id", ["text", "source"], "the very end")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(text_place" in texts or "PartitionFilters: [text_place" in texts


def test_an_index_of_no_rows_and_stale_grams(spark, tmp_path):
    target = str(tmp_path / "empty")
    SI.add(spark.createDataFrame([], SHAPE), "id", ["text"], target)
    assert SI.search(spark, target, "id", ["text"], "abc").count() == 0 and SI.search(spark, target, "id", ["text"], "").count() == 0
    SI.add(spark.createDataFrame([(1, "abc", None, None)], SHAPE), "id", ["text"], target)
    spark.createDataFrame([("xyz", 1, 0)], "gram string, id long, bucket int").withColumn("bucket", SI._folder(F.col("gram"), SI.GRAM_FOLDERS)).write.mode("append").partitionBy("bucket").parquet(f"{target}/grams")
    assert SI.candidates(spark, target, "id", "xyz").count() == 1 and SI.search(spark, target, "id", ["text"], "xyz").count() == 0
    assert [r.id for r in SI.search(spark, target, "id", ["text"], "ABC").collect()] == [1]


def test_texts_share_a_row_of_their_gram(spark):
    """Each text had a row for each of its grams, some hundred times as many to shuffle, sort and write."""
    df = spark.createDataFrame(rows(40, 3), SHAPE).coalesce(1)
    found = SI.postings(df, "id", ["text"]).collect()
    want = {(i, t[k : k + 3].lower()) for i, t, _, _ in rows(40, 3) for k in range(len(t) - 2)}
    assert len(found) == len({r.gram for r in found}) and sorted((i, r.gram) for r in found for i in r.ids) == sorted(want)


def test_many_letters_and_texts_lose_no_gram():
    """Where gram and text are too large for one number, fewer texts are taken at once."""
    texts = list((np.arange(100_000) + 0x10000).astype("<u4").reshape(10_000, 10))
    got = [(g, i) for b in SI._rows_of(texts, pa.array(range(10_000))) for g, ids in zip(b.column("gram").to_pylist(), b.column("ids").to_pylist()) for i in ids]
    assert sorted(got) == sorted((t.tobytes().decode("utf-32-le")[k : k + 3], i) for i, t in enumerate(texts) for k in range(8))
