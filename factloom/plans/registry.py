"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import admin_queries, analysis_queries, claim_queries, data_queries, relational_queries, text_queries

_PARTS = (text_queries, claim_queries, analysis_queries, admin_queries, data_queries, relational_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for part in _PARTS for k, q in part.ORACLES.items()}
