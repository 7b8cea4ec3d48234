"""Call edges and rates from spans and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelens.functions.columns import error_ratio


def edge_rates(samples: DataFrame) -> DataFrame:
    """Mean rates of each edge over its samples that aren't null, and the share of failures."""
    means = samples.groupBy("client", "server").agg(F.avg("requests_per_second").alias("requests_per_second"), F.avg("failures_per_second").alias("failures_per_second"))
    return means.select(
        "client", "server", F.round("requests_per_second", 9).alias("requests_per_second"), F.round("failures_per_second", 9).alias("failures_per_second"), error_ratio(F.col("failures_per_second"), F.col("requests_per_second")).alias("error_ratio")
    )


def with_parents(spans: DataFrame) -> DataFrame:
    """Spans with their parent's service, null where the parent is missing from the trace."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("parent_service"))
    return spans.join(parents, ["trace_id", "parent_span_id"], "left")


def span_edges(spans: DataFrame) -> DataFrame:
    """Pairs of a calling and a called span in different services."""
    return with_parents(spans).filter("parent_service is not null and parent_service <> service_name").select(
        "trace_id", F.col("parent_service").alias("client"), F.col("service_name").alias("server"), "start_time", "duration_ms", (F.col("status_code") == "ERROR").alias("failed")
    )


def span_topology(spans: DataFrame, seconds: float) -> DataFrame:
    """Calls and failures per second of each edge over a window's length."""
    return span_edges(spans).groupBy("client", "server").agg(F.round(F.count("*") / seconds, 9).alias("requests_per_second"), F.round(F.count_if("failed") / seconds, 9).alias("failures_per_second"))


def red(spans: DataFrame, seconds: int = 15) -> DataFrame:
    """A10: rate by service and status in each window, with exact median and 95th percentile of durations."""
    return spans.groupBy(F.window("start_time", f"{seconds} seconds").alias("w"), "service_name", "status_code").agg(
        (F.count("*") / float(seconds)).alias("rate"), F.percentile("duration_ms", F.lit(0.5)).alias("p50"), F.percentile("duration_ms", F.lit(0.95)).alias("p95")
    ).select(F.col("w.start").alias("window_start"), "service_name", "status_code", "rate", F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms"))


def service_signals(spans: DataFrame) -> DataFrame:
    """Error spans and latency of each service."""
    return spans.groupBy("service_name").agg(F.count("*").alias("spans"), F.count_if(F.col("status_code") == "ERROR").alias("error_spans"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.max("duration_ms").alias("max_ms"))
