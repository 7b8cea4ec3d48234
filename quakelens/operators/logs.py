"""Log templates and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelens.functions.columns import mask_log
from quakelens.sources.schemas import ERROR_SEVERITIES
from quakelens.sources.staging import staged


def masked(logs: DataFrame) -> DataFrame:
    """L1: lines with their template."""
    return logs.withColumn("template", mask_log(F.col("body")))


def templates(logs: DataFrame, limit: int | None = 10) -> DataFrame:
    """Lines and first appearance of each template, most frequent first."""
    found = masked(logs).groupBy("template").agg(F.count("*").alias("lines"), F.min("timestamp").alias("first_seen"))
    return found if limit is None else found.orderBy(F.desc("lines"), "template").limit(limit)


def error_signatures(logs: DataFrame, service: str | None = None, limit: int | None = 10) -> DataFrame:
    """L2: templates of error lines only, of the whole window."""
    found = logs.filter(F.upper("severity").isin(ERROR_SEVERITIES))
    return templates(found if service is None else found.filter(F.col("service_name") == service), limit)


def lines_by_service(logs: DataFrame, limit: int = 3) -> DataFrame:
    """The services with the most lines."""
    return logs.groupBy("service_name").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "service_name").limit(limit)


def cluster_quality(rows: DataFrame) -> DataFrame:
    """How well clusters (cluster, truth) agree with the truth."""
    # Written, as two groupings read them.
    cells = staged(rows.groupBy("cluster", "truth").agg(F.count("*").alias("n")), "cells")
    clusters = cells.groupBy("cluster").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("truths"))
    by_cluster = clusters.agg(F.sum("most").alias("agreeing"), F.sum("n").alias("rows"), F.count("*").alias("clusters"), F.count_if(F.col("truths") > 1).alias("merged_clusters"), F.max("truths").alias("worst_merge"))
    by_truth = cells.groupBy("truth").agg(F.count("*").alias("clusters")).agg(F.count("*").alias("truths"), F.count_if(F.col("clusters") > 1).alias("fragmented_truths"))
    return by_cluster.crossJoin(by_truth).select(F.round(F.col("agreeing") / F.col("rows"), 6).alias("purity"), "clusters", "truths", "merged_clusters", "fragmented_truths", "worst_merge")  # one row each
