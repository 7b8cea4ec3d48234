"""Grades of outcomes against labels, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K, ONSET_TOLERANCE = 3, 60.0  # fixed values
CORRECT, INCORRECT, NOT_APPLICABLE = "correct", "incorrect", "not_applicable"


def joined(outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes with their labels by bundle."""
    return outcomes.join(labels, "bundle_id")


def unmatched(outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    """Bundles that only one side has."""
    left = outcomes.select("bundle_id").distinct().join(labels, "bundle_id", "left_anti").select("bundle_id", F.lit("no label").alias("finding"))
    return left.unionByName(labels.select("bundle_id").distinct().join(outcomes, "bundle_id", "left_anti").select("bundle_id", F.lit("no outcome").alias("finding")))


def _verdict(applies: Column, right: Column) -> Column:
    return F.when(~applies, NOT_APPLICABLE).when(F.coalesce(right, F.lit(False)), CORRECT).otherwise(INCORRECT)


def rank_of(candidates: Column, truth: Column) -> Column:
    """One-based place of the truth in the ranking, null where it isn't ranked."""
    return F.nullif(F.array_position(candidates, truth), F.lit(0))


def grades(rows: DataFrame, k: int = TOP_K, tolerance: float = ONSET_TOLERANCE) -> DataFrame:
    """A verdict column for each grader.

    rows: target_service, fault_class_label, onset_label; root_cause, ranked_candidates, abstained, fault_class, onset.
    """
    real = F.col("target_service").isNotNull()
    place = rank_of(F.col("ranked_candidates"), F.col("target_service"))
    error = F.abs(F.unix_micros("onset") - F.unix_micros("onset_label")) / 1_000_000.0
    named = F.col("root_cause").isNotNull() & ~F.col("abstained")
    stated = (F.col("fault_class_label") != "unknown") & F.col("fault_class").isNotNull()
    return rows.withColumns(
        {
            "root_cause_grade": _verdict(real, named & (F.col("root_cause") == F.col("target_service"))),
            "top_k_grade": _verdict(real, place <= k),
            "fault_class_grade": _verdict(F.coalesce(stated, F.lit(False)), F.col("fault_class") == F.col("fault_class_label")),
            "onset_error": error,
            "onset_grade": _verdict(error.isNotNull(), error <= tolerance),
            "abstention_grade": F.when(real, F.when(F.col("abstained"), INCORRECT).otherwise(CORRECT)).otherwise(F.when(named, INCORRECT).otherwise(CORRECT)),
        }
    )


def headline(graded: DataFrame) -> DataFrame:
    """The root cause grade where it applies, else the abstention grade."""
    return graded.withColumn("correct", F.coalesce(F.nullif("root_cause_grade", F.lit(NOT_APPLICABLE)), F.col("abstention_grade")) == CORRECT)


def evidence_validity(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited ids (bundle_id, cited_evidence) that don't resolve, and the share that does."""
    ids = cited.select("bundle_id", F.explode_outer("cited_evidence").alias("evidence_id"))
    found = ids.join(evidence.select("bundle_id", "evidence_id").distinct().withColumn("held", F.lit(1)), ["bundle_id", "evidence_id"], "left")
    return found.groupBy("bundle_id").agg(F.count("evidence_id").alias("cited"), F.count("held").alias("resolved"), F.round(F.try_divide(F.count("held"), F.count("evidence_id")), 6).alias("share"))


def remediation_grade(proposals: DataFrame, allowed: DataFrame) -> DataFrame:
    """Whether a proposed action is on the allowlist and aims at the right flag and service."""
    held = proposals.join(allowed.select("action", F.lit(True).alias("listed")).distinct(), "action", "left")
    right = F.coalesce("listed", F.lit(False)) & (F.col("flag") == F.col("flag_label")) & (F.col("service") == F.col("service_label"))
    return held.withColumn("remediation_grade", F.when(F.col("action").isNull() | F.col("flag_label").isNull(), NOT_APPLICABLE).when(F.coalesce(right, F.lit(False)), CORRECT).otherwise(INCORRECT))


def long_grades(graded: DataFrame, keys: list[str], graders: list[str]) -> DataFrame:
    """One row for each trial and grader."""
    return graded.select(*keys, F.inline(F.array(*(F.struct(F.lit(g).alias("grader"), F.col(g).alias("verdict")) for g in graders))))


def grader_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """How often each grader applied and was right; accuracy is null where it never applied."""
    applies = F.col("verdict") != NOT_APPLICABLE
    return rows.groupBy(*by).agg(
        F.count("*").alias("trials"), F.count_if(applies).alias("applicable"), F.count_if(F.col("verdict") == CORRECT).alias("correct"), F.round(F.count_if(applies) / F.count("*"), 6).alias("coverage"),
        F.round(F.try_divide(F.count_if(F.col("verdict") == CORRECT), F.count_if(applies)), 6).alias("accuracy"),
    )


def task_scores(rows: DataFrame, task: list[str], by: list[str]) -> DataFrame:
    """The mean over a task's trials, then over tasks, of a 0/1 value."""
    return rows.groupBy(*by, *task).agg(F.avg("value").alias("score")).groupBy(*by).agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("tasks"))


def ranking_summary(rows: DataFrame, group: str) -> DataFrame:
    """First places, first three places and mean reciprocal rank (of `place`, null where not ranked), by group and over all."""
    return rows.rollup(group).agg(
        F.count("*").alias("trials"), F.count_if(F.col("place") == 1).alias("top1"), F.count_if(F.col("place") <= 3).alias("top3"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr")
    )


def rank_histogram(rows: DataFrame) -> DataFrame:
    """Trials by rank."""
    return rows.groupBy("place").agg(F.count("*").alias("trials"))


def baseline_summary(rows: DataFrame, group: str) -> DataFrame:
    """What became of each trial (target_service, root_cause), by group and over all."""
    real, named = F.col("target_service").isNotNull(), F.col("root_cause").isNotNull()
    return rows.rollup(group).agg(
        F.count_if((real & (F.col("root_cause") == F.col("target_service"))) | (~real & ~named)).alias("correct"), F.count_if(real & named & (F.col("root_cause") != F.col("target_service"))).alias("named_wrong"),
        F.count_if(real & ~named).alias("abstained_on_real"), F.count_if(~real & named).alias("invented"), F.round(F.avg("calls"), 6).alias("mean_calls"),
    )


def nearest_rank(rows: DataFrame, column: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles that are values of the rows: the one at place int(share * n), counted from 0."""
    of = Window.partitionBy(*by)
    placed = rows.filter(F.col(column).isNotNull()).withColumns({"__i": F.row_number().over(of.orderBy(column)) - 1, "__n": F.count("*").over(of)})
    at = lambda p: F.least(F.floor(p * F.col("__n")), F.col("__n") - 1)
    return placed.groupBy(*by).agg(*(F.max(F.when(F.col("__i") == at(p), F.col(column))).alias(name) for name, p in shares.items()))


def cost_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Calls, cost and tokens, with nearest-rank quantiles of seconds."""
    sums = rows.groupBy(*by).agg(F.round(F.avg("calls"), 6).alias("mean_calls"), F.round(F.avg("usd"), 6).alias("mean_usd"), F.round(F.median("usd"), 6).alias("median_usd"), F.sum("tokens").alias("tokens"))
    return sums.join(nearest_rank(rows, "seconds", by, {"p50_seconds": 0.5, "p95_seconds": 0.95}), by)


def split_summary(rows: DataFrame) -> DataFrame:
    """Tasks and families of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("tasks"), F.sort_array(F.collect_set("family")).alias("families"))


def split_soundness(rows: DataFrame, trained: str = "train", known: str = "test_id", unknown: str = "test_ood") -> DataFrame:
    """U4: families of the unknown split that were trained on, and of the known split that weren't."""
    of = lambda s: rows.filter(F.col("split") == s).select("family").distinct()
    overlap = of(unknown).intersect(of(trained)).withColumn("finding", F.lit("overlap"))
    return overlap.unionByName(of(known).exceptAll(of(trained)).withColumn("finding", F.lit("never trained")))


def by_group(rows: DataFrame, key_map: DataFrame, key: str) -> DataFrame:
    """Rows with their group; rows whose key has none are left out."""
    return rows.join(key_map, key)


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each model's tokens at its price for a million; unpriced calls are counted, not averaged."""
    priced = calls.join(prices, "model", "left").withColumn("usd", (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6)
    return priced.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("usd"), 6).alias("usd"), F.count_if(F.col("usd").isNull()).alias("unpriced"))


def graph_fingerprint(edges: DataFrame, by: list[str]) -> DataFrame:
    """An order-free digest of rows: their number, and sum and xor of their hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in edges.columns if c not in by])), 1, 12), 16, 10).cast("long")
    return edges.groupBy(*by).agg(F.count("*").alias("edges"), F.sum(h).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))
