"""The registered queries over the provided tables and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakelens.plans import eval_queries, graph_queries, metric_queries, source_queries, stream_queries, text_queries, triage_queries
from quakelens.sources.projections import Query

MODULES = (metric_queries, graph_queries, text_queries, eval_queries, source_queries, stream_queries, triage_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of every bundle, ranked."""
    return metric_queries.QUERIES["t01_rank_anomalies"](spark, sf_dir)
