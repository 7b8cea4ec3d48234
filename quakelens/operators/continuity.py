"""Whether recordings are whole: gaps, density, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakelens.functions.columns import seconds_between

GAP_FACTOR, LEAST_GAP_SECONDS, LEAST_SAMPLES = 4, 120.0, 3  # fixed values


def gaps(facts: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """The largest and the median gap between distinct sample times, and their number."""
    times = facts.select(*keys, "timestamp").distinct()
    before = F.lag("timestamp").over(Window.partitionBy(*keys).orderBy("timestamp"))
    return times.withColumn("gap", seconds_between(before, F.col("timestamp"))).groupBy(*keys).agg(
        F.round(F.max("gap"), 6).alias("max_gap"), F.round(F.median("gap"), 6).alias("median_gap"), F.count("*").alias("samples")
    )


def continuity(found: DataFrame) -> DataFrame:
    """Broken, continuous, or unknown with too few samples."""
    broken = F.col("max_gap") > F.greatest(GAP_FACTOR * F.col("median_gap"), F.lit(LEAST_GAP_SECONDS))
    return found.withColumn("verdict", F.when(F.col("samples") < LEAST_SAMPLES, "unknown").when(broken, "broken").otherwise("continuous"))


def sparse_windows(facts: DataFrame, seconds: int = 300, least: int = 3, keys: tuple[str, ...] = ("bundle_id", "service_name", "metric_name")) -> DataFrame:
    """Windows of a series with fewer samples than they should have (windows without any aren't seen)."""
    return facts.groupBy(*keys, F.window("timestamp", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("samples")).filter(F.col("samples") < least).select(*keys, F.col("w.start").alias("window_start"), "samples")


def recording_drift(runs: DataFrame, factor: float = 1.5, slack: float = 300.0) -> DataFrame:
    """Runs (planned_seconds, actual_seconds) that took much longer than planned."""
    return runs.withColumn("drifted", F.col("actual_seconds") > F.greatest(F.col("planned_seconds") * factor, F.col("planned_seconds") + slack))
