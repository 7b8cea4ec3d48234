"""How unusual each series is in its incident window against its baseline, and since when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakelens.functions import columns as C
from quakelens.operators.windows import tagged
from quakelens.sources.schemas import NOT_UNDER_INVESTIGATION

MIN_BASELINE_POINTS, MIN_INCIDENT_POINTS = 4, 1  # fixed values
ONSET_THRESHOLD = 3.0
SERIES = ["bundle_id", "service_name", "metric_name"]


def _centred(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Tagged facts with both medians of their series: one shuffle by series serves the medians and what follows."""
    series = Window.partitionBy(*SERIES)
    return tagged(facts, windows).withColumns(
        {
            "baseline_median": F.median(F.when(F.col("in_baseline"), F.col("value"))).over(series),
            "incident_median": F.median(F.when(F.col("in_incident"), F.col("value"))).over(series),
        }
    )


def window_medians(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """A1: median and number of points of each series in each window."""
    both = tagged(facts, windows)
    return both.groupBy(*SERIES).agg(
        F.median(F.when(F.col("in_baseline"), F.col("value"))).alias("baseline_median"),
        F.median(F.when(F.col("in_incident"), F.col("value"))).alias("incident_median"),
        F.count_if("in_baseline").alias("baseline_points"),
        F.count_if("in_incident").alias("incident_points"),
    )


def robust_stats(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """A2: medians, points and robust scale of each series; the scale's reference is the incident median."""
    stats = _centred(facts, windows).groupBy(*SERIES).agg(
        F.first("baseline_median").alias("baseline_median"),
        F.first("incident_median").alias("incident_median"),
        F.count_if("in_baseline").alias("baseline_points"),
        F.count_if("in_incident").alias("incident_points"),
        F.median(F.when(F.col("in_baseline"), F.abs(F.col("value") - F.col("baseline_median")))).alias("mad"),
    )
    return stats.withColumn("scale", C.robust_scale(F.col("baseline_median"), F.col("mad"), F.col("baseline_points"), F.col("incident_median")))


def score_services(facts: DataFrame, windows: DataFrame, directions: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """A3-A5: score of every series by its metric's direction; with services (bundle_id, service_name) a row even without data."""
    stats = robust_stats(facts, windows)
    if services is None:
        stats = stats.join(F.broadcast(directions), "metric_name")
    else:  # the vocabulary of metrics is closed and small
        stats = services.crossJoin(F.broadcast(directions)).join(stats, SERIES, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    points = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    signed = C.robust_z(F.col("baseline_median"), F.col("incident_median"), F.col("scale"))
    delta = zero("incident_median") - zero("baseline_median")
    return stats.select(
        *SERIES, "direction", (F.round(C.directed(signed, F.col("direction")), 4) + 0.0).alias("score"), zero("baseline_median").alias("baseline_median"), zero("incident_median").alias("incident_median"),
        points("baseline_points").alias("baseline_points"), points("incident_points").alias("incident_points"),
        ((points("baseline_points") >= MIN_BASELINE_POINTS) & (points("incident_points") >= MIN_INCIDENT_POINTS)).alias("trustworthy"),
        F.round(delta, 6).alias("delta"), F.round(delta / F.nullif(zero("baseline_median"), F.lit(0.0)), 6).alias("relative_delta"),
    )


def compare_windows(facts: DataFrame, windows: DataFrame, bundle: str, service: str, metric: str, significant: float = 3.0) -> DataFrame:
    """Both medians and the signed score of one series."""
    one = facts.filter((F.col("bundle_id") == bundle) & (F.col("service_name") == service) & (F.col("metric_name") == metric))
    z = C.robust_z(F.col("baseline_median"), F.col("incident_median"), F.col("scale"))
    return robust_stats(one, windows).select(
        *SERIES, "baseline_median", "incident_median", F.round(z, 4).alias("score"), (F.col("baseline_points") >= MIN_BASELINE_POINTS).alias("trustworthy"), (F.abs(z) >= significant).alias("significant")
    )


def worst_scores(scores: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """The worst trustworthy score of each service, at least 0; P8: without those that are never a cause."""
    kept = scores.filter("trustworthy").filter(~F.col("service_name").isin(exclude if exclude is not None else NOT_UNDER_INVESTIGATION))
    return kept.groupBy("bundle_id", "service_name").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("anomaly"))


def rank_anomalies(scores: DataFrame, minimum: float = 0.0, limit: int | None = None) -> DataFrame:
    """Trustworthy scores of at least a minimum, ranked within each bundle."""
    order = Window.partitionBy("bundle_id").orderBy(F.desc("score"), "service_name", "metric_name")
    ranked = scores.filter("trustworthy").filter(F.col("score") >= minimum).withColumn("place", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("place") <= limit)


def onsets(facts: DataFrame, windows: DataFrame, threshold: float = ONSET_THRESHOLD) -> DataFrame:
    """Seconds into the incident of each service's first upward crossing on any metric.

    The scale here has no reference: a baseline flat at zero makes any rise an onset.
    """
    series = Window.partitionBy(*SERIES)
    centred = _centred(facts, windows).withColumns(
        {"points": F.count_if("in_baseline").over(series), "mad": F.median(F.when(F.col("in_baseline"), F.abs(F.col("value") - F.col("baseline_median")))).over(series)}
    )
    scale = C.robust_scale(F.col("baseline_median"), F.col("mad"), F.col("points"))
    crossed = centred.filter(F.col("in_incident") & (F.col("points") >= MIN_BASELINE_POINTS)).filter((F.col("value") - F.col("baseline_median")) / scale >= threshold)
    return crossed.groupBy("bundle_id", "service_name").agg(F.round(F.min(C.seconds_between(F.col("incident_start"), F.col("timestamp"))), 6).alias("onset_seconds"))


def started_first(found: DataFrame) -> DataFrame:
    """Whether a service's onset is the incident's first."""
    return found.withColumn("started_first", F.col("onset_seconds") <= F.min("onset_seconds").over(Window.partitionBy("bundle_id")))


def services_by_score(scores: DataFrame) -> DataFrame:
    """Services in the order of their worst anomaly, without a graph."""
    best = rank_anomalies(scores).groupBy("bundle_id", "service_name").agg(F.min("place").alias("first"), F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy("first"))).drop("first")
