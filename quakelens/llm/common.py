"""Shared helpers: reading tables, staging, and batch sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quakelens.sources.staging import importable, shared_dir, staged, staged_at

__all__ = ["BATCH_ROWS", "carried", "shared_dir", "small_batches", "staged", "staged_at", "table"]

#: Rows in one Arrow batch; documents can be very long, so a batch is kept small.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts stay within an executor's memory."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, used: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), which keeps all columns, with every column but the used ones out of the way of any name in it.

    The other columns go by names of their own meanwhile and get theirs back by place, whatever these are: with dots, like
    a name that work gives, or like a used one in other letters' case.
    """
    names = docs.columns
    own = {u: next((i for i, n in enumerate(names) if n == u), next((i for i, n in enumerate(names) if n.lower() == u.lower()), None)) for u in used}
    plain = {i: u for u, i in own.items() if i is not None}
    return work(docs.toDF(*(plain.get(i, f"carried_{i}") for i in range(len(names))))).toDF(*names)
