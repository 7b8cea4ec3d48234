"""From landed exports to fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_RESULT = "metric map<string,string>, values array<array<string>>"
TAG = "struct<key: string, value: string>"
SPAN_EXPORT = (
    "data array<struct<spans: array<struct<traceID: string, spanID: string, operationName: string, references: array<struct<refType: string, spanID: string>>, startTime: bigint, duration: bigint, "
    f"tags: array<{TAG}>, processID: string>>, processes: map<string, struct<serviceName: string>>>>"
)
LOG_EXPORT = "timestamp string, service string, severity string, body string, trace_id string, attributes map<string,string>"
OWN_COLLECTOR = "otel-collector"


def sorted_json(labels: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def metric_rows(results: DataFrame, metric_name: str) -> DataFrame:
    """A row for each sample of range results (metric, values of [seconds, text]); NaN and malformed samples go."""
    samples = results.select("metric", F.explode("values").alias("v"))
    subject = F.coalesce(*(F.nullif(F.col("metric")[k], F.lit("")) for k in ("service_name", "container_name", "client")))
    value = F.expr("try_cast(v[1] as double)")
    at = F.expr("try_cast(v[0] as double)")
    rows = samples.select(F.timestamp_micros((at * 1_000_000).cast("long")).alias("timestamp"), F.lit(metric_name).alias("metric_name"), subject.alias("service_name"), sorted_json(F.col("metric")).alias("labels_json"), value.alias("value"))
    return rows.filter("timestamp is not null and service_name is not null and value is not null and not isnan(value)")


def _tag(name: str) -> Column:
    return F.get(F.filter("s.tags", lambda t: t["key"] == name), 0)["value"]


def span_rows(exports: DataFrame) -> DataFrame:
    """A row for each span of trace exports; repeats and spans of no known service go."""
    traces = exports.select(F.explode("data").alias("t"))
    spans = traces.select(F.explode("t.spans").alias("s"), F.col("t.processes").alias("p")).withColumn("service_name", F.col("p")[F.col("s.processID")]["serviceName"])
    parent = F.get(F.filter("s.references", lambda r: r["refType"] == "CHILD_OF"), 0)["spanID"]
    failed = F.lower(_tag("error")) == "true"
    status = F.when(_tag("otel.status_code").isNotNull(), F.concat(F.lit("STATUS_CODE_"), F.upper(_tag("otel.status_code")))).when(failed, "STATUS_CODE_ERROR").otherwise("STATUS_CODE_UNSET")
    rows = spans.filter("service_name is not null").select(
        F.col("s.traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), parent.alias("parent_span_id"), "service_name", F.col("s.operationName").alias("span_name"),
        F.upper(F.coalesce(_tag("span.kind"), F.lit("internal"))).alias("span_kind"), F.timestamp_micros("s.startTime").alias("start_time"), (F.col("s.duration") / 1000.0).alias("duration_ms"),
        status.alias("status_code"), sorted_json(F.map_from_entries(F.transform("s.tags", lambda t: F.struct(t["key"], t["value"])))).alias("attributes_json"),
    )
    return rows.dropDuplicates(["span_id"])


def log_rows(exports: DataFrame) -> DataFrame:
    """A row for each log line with a service and a body; times are cut to microseconds."""
    known = exports.filter(F.coalesce("service", F.lit("")) != "").filter(F.coalesce("body", F.lit("")) != "").filter(F.col("service") != OWN_COLLECTOR)
    at = F.to_timestamp(F.regexp_replace("timestamp", r"(\.\d{6})\d+", "$1"))
    return known.select(
        at.alias("timestamp"), F.col("service").alias("service_name"), F.upper(F.coalesce(F.nullif("severity", F.lit("")), F.lit("UNSPECIFIED"))).alias("severity"), "body", F.nullif("trace_id", F.lit("")).alias("trace_id"), sorted_json(F.coalesce("attributes", F.create_map().cast("map<string,string>"))).alias("attributes_json")
    )
