"""Records and rejects: no line is lost."""

import json

from pyspark.sql import functions as F

from factloom.sources import datasets as DS
from factloom.sources import quarantine as Q


def test_json_lines_are_records_or_rejects(spark, tmp_path):
    good = [{"text": f" A  text {k} ", "title": "T", "label": "real" if k % 2 else "FAKE", "source": "", "dataset_type": "article"} for k in range(6)]
    lines = [json.dumps(x) for x in good] + ['{"text": "cut', "no json", '{"text": "x", "label": "maybe"}', '{"text": "  ", "label": "REAL"}', "", "   ", '[1, 2]']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    judged = Q.judge_lines(spark, str(tmp_path / "a.jsonl"), "json").cache()
    kept, lost = Q.accepted(judged).collect(), {r.line: r.reason for r in Q.rejected(judged).collect()}
    assert len(kept) == 6 and kept[0].asDict() == {"text": "A text 0", "title": "T", "label": "FAKE", "source": "Unknown source", "dataset_type": "article"}
    assert len(kept) + len(lost) == 11
    assert lost['{"text": "cut'] == lost["no json"] == Q.MALFORMED
    assert lost['{"text": "x", "label": "maybe"}'] == Q.UNKNOWN_LABEL and lost['{"text": "  ", "label": "REAL"}'] == Q.NO_TEXT
    Q.store(judged, str(tmp_path / "out"))
    records, rejects = Q.read_store(spark, str(tmp_path / "out"))
    assert records.count() == 6 and rejects.count() == 5 and records.columns == list(DS.RECORD)


def test_csv_lines_are_records_or_rejects(spark, tmp_path):
    lines = ['text,title,label,source,dataset_type', '"a, b ""c""",T,REAL,s,article', "too,few", "a,b,REAL,s,article,more", ",T,FAKE,s,article", "x,T,perhaps,s,article", ""]
    (tmp_path / "a.csv").write_text("﻿" + "\n".join(lines))
    judged = Q.judge_lines(spark, str(tmp_path / "a.csv"), "csv")
    assert [r.text for r in Q.accepted(judged).collect()] == ['a, b "c"']
    assert sorted(r.reason for r in Q.rejected(judged).collect()) == [Q.MALFORMED, Q.MALFORMED, Q.NO_TEXT, Q.UNKNOWN_LABEL]
    assert {r.reason: r.n for r in Q.summary(judged).collect()} == {"": 1, Q.MALFORMED: 2, Q.NO_TEXT: 1, Q.UNKNOWN_LABEL: 1}


def test_processed_records_are_checked_again(spark):
    rows = [(1, "x  y", None, "Real", None, None), (2, None, "t", "FAKE", "s", "claim"), (3, "z", "t", "odd", "s", "claim"), (4, "z", "t", None, "s", "claim")]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, label string, source string, dataset_type string").withColumn("mark", F.lit(7))
    got = {r.doc_id: (r.reason, r.mark) for r in Q.revalidate(df).collect()}
    assert got == {1: (None, 7), 2: (Q.NO_TEXT, 7), 3: (Q.UNKNOWN_LABEL, 7), 4: (Q.UNKNOWN_LABEL, 7)}
