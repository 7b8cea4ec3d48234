"""Declared schemas of the fact tables, the closed vocabularies, and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


METRICS = _struct(
    ("timestamp", TimestampType(), False), ("metric_name", StringType(), False), ("service_name", StringType(), False), ("labels_json", StringType(), False), ("value", DoubleType(), False)
)
TRACES = _struct(
    ("trace_id", StringType(), False), ("span_id", StringType(), False), ("parent_span_id", StringType(), True), ("service_name", StringType(), False), ("span_name", StringType(), False),
    ("span_kind", StringType(), False), ("start_time", TimestampType(), False), ("duration_ms", DoubleType(), False), ("status_code", StringType(), False), ("attributes_json", StringType(), False),
)
LOGS = _struct(
    ("timestamp", TimestampType(), False), ("service_name", StringType(), False), ("severity", StringType(), False), ("body", StringType(), False), ("trace_id", StringType(), True), ("attributes_json", StringType(), False)
)
EDGE = _struct(
    ("client", StringType(), True), ("server", StringType(), True), ("requests_per_second", DoubleType(), True), ("failures_per_second", DoubleType(), True), ("error_ratio", DoubleType(), True)
)
TOPOLOGY = _struct(("window_start", TimestampType(), True), ("window_end", TimestampType(), True), ("services", ArrayType(StringType()), True), ("edges", ArrayType(EDGE), True))
CHANGE = _struct(("at", TimestampType(), True), ("kind", StringType(), True), ("service", StringType(), True), ("detail", StringType(), True))
WINDOW = _struct(("start", TimestampType(), True), ("end", TimestampType(), True))
FILE = _struct(("name", StringType(), True), ("sha256", StringType(), True), ("bytes", LongType(), True), ("rows", LongType(), True))
MANIFEST = _struct(
    ("bundle_id", StringType(), True), ("run_id", StringType(), True), ("demo_tag", StringType(), True), ("recorded_at", TimestampType(), True), ("window", WINDOW, True),
    ("files", ArrayType(FILE), True), ("alert_fired", BooleanType(), True), ("alert_fired_at", TimestampType(), True),
)

# Closed vocabularies: fixed values.
STATUS_CODES = ["STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR"]
ERROR_SEVERITIES = ["ERROR", "FATAL"]
PROBLEM_SEVERITIES = ["WARN", "ERROR", "FATAL"]
SPLITS = ["train", "validation", "test_id", "test_ood"]
#: Names that watch or drive a system and are never a cause: fixed values; a deployment adds its own, such as its stores, by the exclude parameter.
NOT_UNDER_INVESTIGATION = [
    "jaeger", "prometheus", "grafana", "opensearch", "opamp-server", "otel-collector", "otelcol-contrib", "alertmanager", "flagd", "flagd-ui", "telemetry-docs", "load-generator", "user",
]


def contract_findings(df: DataFrame, contract: StructType) -> list[str]:
    """What keeps df from being written under a contract: unexpected, missing or wrongly typed columns."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in contract}
    found = [f"unexpected column {n}" for n in have if n not in want] + [f"missing column {n}" for n in want if n not in have]
    return found + [f"column {n} is {have[n].simpleString()}, not {t.simpleString()}" for n, t in want.items() if n in have and have[n] != t]


def enforced(df: DataFrame, contract: StructType) -> DataFrame:
    """df in the contract's column order; a null in a required column stops the job when it runs."""
    if found := contract_findings(df, contract):
        raise ValueError("; ".join(found))
    required = [
        F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"required column {f.name} is null"))).otherwise(F.col(f.name)).alias(f.name) if not f.nullable else F.col(f.name)
        for f in contract
    ]
    return df.select(*required)


def outside_vocabulary(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Distinct values of a column that a one-column vocabulary table doesn't hold."""
    return df.select(F.col(column).alias(known.columns[0])).distinct().join(known, known.columns[0], "left_anti")
