"""The contract queries, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, hard_negatives, hmm_lm, line_dedup, minhash_forest, mixing, pii_patterns, quality_rules, rule_classifier, run_index, sharding, site_style
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op2_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.digest(table(spark, sf_dir, "pages"))


def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.digest(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


def op8_rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op11_pii_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_patterns.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, shift=F.col("vec_id") % 7 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (op1_mixing, op2_site_style, op3_run_index, op4_decontaminate, op5_line_dedup, op6_minhash_forest, op7_quality_rules, op8_rule_classifier, op9_sharding, op10_hmm_lm, op11_pii_patterns, op12_hard_negatives, op13_filter_audit)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
