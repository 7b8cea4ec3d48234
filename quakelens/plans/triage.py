"""The whole triage of all bundles in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelens.functions import columns as C
from quakelens.operators import anomaly
from quakelens.operators.windows import choose_windows
from quakelens.plans import graph

TOP_CANDIDATES = 5


def triage(facts: DataFrame, manifests: DataFrame, edges: DataFrame, directions: DataFrame, threshold: float = graph.ABSTENTION, rounds: int | None = None) -> DataFrame:
    """Finding or abstention of each bundle, with confidence, top anomaly and its best candidates."""
    windows = choose_windows(manifests)
    scores = anomaly.score_services(facts, windows, directions)
    worst = anomaly.worst_scores(scores).withColumnRenamed("service_name", "service")
    candidates = graph.rank_candidates(edges, worst, anomaly.onsets(facts, windows), rounds=rounds)
    tops = worst.groupBy("bundle_id").agg(F.max("anomaly").alias("top_anomaly"))
    found = graph.abstained(graph.confidence(candidates), tops, threshold)
    best = candidates.filter(F.col("place") <= TOP_CANDIDATES).groupBy("bundle_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "service"))), lambda x: x["service"]).alias("candidates")
    )
    return found.join(best, "bundle_id", "left")


def report_rows(found: DataFrame, manifests: DataFrame, edges: DataFrame, changes: DataFrame, onset_times: DataFrame, threshold: float = graph.ABSTENTION) -> DataFrame:
    """Triage rows with their windows, the threshold that decided, the services in the order of their onsets, the
    callers of what they name, the changes in the incident window, and the ids of the questions that these answer."""
    windows = choose_windows(manifests)
    named = found.filter("root_cause is not null").select("bundle_id", F.col("root_cause").alias("start"))
    callers = graph.blast_radius(edges, named).groupBy("bundle_id").agg(F.sort_array(F.collect_set("service")).alias("blast_radius"))
    # Windows and changes meet by day.
    days = windows.select("bundle_id", "incident_start", "incident_end", F.explode(F.sequence(F.to_date("incident_start"), F.to_date("incident_end"))).alias("day"))
    inside = changes.withColumn("day", F.to_date("at")).join(days, "day").filter("at >= incident_start and at <= incident_end")
    near = inside.groupBy("bundle_id").agg(F.count("*").alias("changes_in_window"))
    # A service for each place, as many as the bundle has.
    order = onset_times.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("onset_seconds", "service_name"))), lambda x: x["service_name"]).alias("onset_order"))
    none = F.array().cast("array<string>")
    asked = {"metric": "anomalies", "topology": "blast_radius", "change": "changes"}
    cited = F.array(*(C.question_id(kind, F.concat_ws(":", F.lit(question), "bundle_id"), F.col("incident_start"), F.col("incident_end"), F.col("bundle_id")) for kind, question in asked.items()))
    joined = found.join(windows, "bundle_id").join(callers, "bundle_id", "left").join(near, "bundle_id", "left").join(order, "bundle_id", "left")
    return joined.withColumns(
        {
            "blast_radius": F.coalesce("blast_radius", none), "onset_order": F.coalesce("onset_order", none), "changes_in_window": F.coalesce("changes_in_window", F.lit(0)),
            "threshold": F.lit(threshold), "cited": cited,
        }
    )


def fraction_trials(facts: DataFrame, manifests: DataFrame, edges: DataFrame, directions: DataFrame, truths: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """For each baseline fraction (by its configuration's name), how often the truth (bundle_id, truth) ranks first or
    among three, and the share of bundles whose onsets differ, so that their order says something.

    All fractions are tried in one job: every bundle stands for one trial with each, with the configuration in its key, and
    the facts are read once.
    """
    tried = F.array(*(F.struct(F.lit(name).alias("configuration"), F.lit(f).alias("fraction")) for name, f in fractions.items()))
    under = lambda df: df.select("*", F.inline(tried)).withColumn("bundle_id", F.concat("configuration", F.lit("\0"), "bundle_id"))
    facts, edges, truths = (under(df).drop("configuration", "fraction") for df in (facts, edges, truths))
    windows = choose_windows(under(manifests), F.col("fraction"))
    worst = anomaly.worst_scores(anomaly.score_services(facts, windows, directions)).withColumnRenamed("service_name", "service")
    onset_times = anomaly.onsets(facts, windows)
    places = graph.rank_candidates(edges, worst, onset_times).join(truths, "bundle_id").filter("service = truth").select("bundle_id", "place")
    distinct = onset_times.groupBy("bundle_id").agg(F.count_distinct("onset_seconds").alias("onsets"))
    trials = windows.select("bundle_id").join(places, "bundle_id", "left").join(distinct, "bundle_id", "left")
    return trials.groupBy(F.substring_index("bundle_id", "\0", 1).alias("configuration")).agg(
        F.count("*").alias("trials"), F.count_if(F.col("place") == 1).alias("top1"), F.count_if(F.col("place") <= 3).alias("top3"), F.count_if(F.col("onsets") > 1).alias("onset_order_survives"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("onsets") > 1), F.count("*")), F.lit(0.0)), 4).alias("survival_share"),
    )
