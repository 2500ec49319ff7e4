"""From raw documents to shards: five of the llm operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all rows of its
predecessor; all but the last return the columns of ``documents``.

Defined results: a null text counts as empty and is scored, has no near copy and
no benchmark window, and takes no words in the mix, so it leaves in the fourth
stage at the latest; a null id stays in the second stage; a null source is a
source; of repeated rows of an id one stays in the second stage, of near copies
the smallest id (ties can't be: ids are then distinct); documents that the mix
repeats are rows of the last stage as often as it takes them; an empty table
gives an empty result; columns beside those of ``documents`` stay until the last
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, minhash_forest, mixing, rule_classifier, sharding
from factloom.llm.common import materialise, release, table

#: Near-duplicates of the pipeline share four fifths of their five-word shingles.
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return rule_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return minhash_forest.keep_first(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are sampled and repeated to their target weights; repeats are rows."""
    return mixing.mix(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes, equal texts together: the plan, one row for each document row."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
    ("sharding", cut_shards),
]

#: SQL can't express the fitted classifier or the minimax cuts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k + 1}")
            if k:
                release(before)  # the stage before last; the tables given stay
    return docs
