"""Sinks: schema-enforced Parquet, append-only lines, window-keyed overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quakelens.operators.governance import without_known
from quakelens.sources.schemas import enforced

#: Spark's own format for times in JSON ends at milliseconds.
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_table(df: DataFrame, contract: StructType, path: str) -> int:
    """Write df under a contract and return its number of rows, counted on the way."""
    seen = Observation()
    enforced(df, contract).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]


def append_new(new: DataFrame, held: DataFrame, key: str, order: list[str], path: str) -> None:
    """Append the rows whose key isn't held yet, the first of each."""
    without_known(new, held, key, order).write.mode("append").parquet(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; nothing is ever overwritten."""
    rows.write.mode("append").option("timestampFormat", MICROSECONDS).json(path)


def upsert_windows(edges: DataFrame, window: str, path: str) -> None:
    """Replace the windows that edges holds and keep all others."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(window).parquet(path)
