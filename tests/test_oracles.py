"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tests.conftest import as_set

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# the training-data operators have their own tests
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert as_set(got.collect(), got.columns, order) == as_set(want.fetchall(), want.columns, order)


@pytest.mark.parametrize("name", ["dataset_profile", "dedupe_exact", "history_csv"])
def test_blank_texts_match_sql(spark, tmp_path, name):
    """A blank text had a stand-in for its title in the profile, and one for its body in the history."""
    texts = [None, "", " ", "\n\t ", "The end of it, and of that. More.", 'He said "no",\nand left.', "x", None, "  The end of it, and of that.  More. ", "!? a"]
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i == 3)) for i in (0, 1, 3, 4, 6, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
    order = sorted(got.columns)
    assert as_set(got.collect(), got.columns, order) == as_set(want.fetchall(), want.columns, order)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
