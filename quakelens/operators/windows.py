"""Baseline and incident windows, and the facts that fall into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINE_FRACTION, GUARD_SECONDS = 0.3333333333333333, 30.0  # fixed values


def choose_windows(manifests: DataFrame, fraction: float | Column = BASELINE_FRACTION, guard: float = GUARD_SECONDS) -> DataFrame:
    """Baseline and incident window of every manifest row (bundle_id, window_start, window_end, alert_fired_at).

    The fraction may be a column of the manifests."""
    start, end, alert = (F.unix_micros(c) for c in ("window_start", "window_end", "alert_fired_at"))
    guarded = int(guard * 1_000_000)
    usable = alert.isNotNull() & (start + 2 * guarded < alert) & (alert < end)
    anchor = F.when(usable, alert).otherwise(start + F.round((end - start) * fraction).cast("long"))
    return manifests.select(
        "bundle_id",
        F.col("window_start").alias("baseline_start"),
        F.timestamp_micros(F.greatest(anchor - guarded, start)).alias("baseline_end"),
        F.timestamp_micros(anchor).alias("incident_start"),
        F.col("window_end").alias("incident_end"),
        F.coalesce(usable, F.lit(False)).alias("anchored"),
    )


def tagged(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Facts with the windows that they fall into, which are closed at both ends; a fact may be in both.

    One scan of the facts and an equi-join on bundle_id; Spark broadcasts the windows where they are small.
    """
    inside = lambda a, b: (F.col("timestamp") >= F.col(a)) & (F.col("timestamp") <= F.col(b))
    joined = facts.join(windows, "bundle_id").withColumns(
        {"in_baseline": inside("baseline_start", "baseline_end"), "in_incident": inside("incident_start", "incident_end")}
    )
    return joined.filter("in_baseline or in_incident").select(*facts.columns, "in_baseline", "in_incident", "incident_start")
