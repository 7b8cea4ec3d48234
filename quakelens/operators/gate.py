"""Metrics of whole runs, comparisons and the non-inferiority gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelens.operators import stats

#: Margins by grader: fixed values.
MARGINS = [("root_cause", 0.03), ("root_cause_top3", 0.05), ("abstention", 0.02), ("evidence_validity", 0.0)]
CALIBRATION_MARGIN, COST_INCREASE, COST_FLOOR, MINIMUM_TASKS = 0.02, 0.20, 0.01, 10  # fixed values


def all_metrics(rows: DataFrame, group: str) -> DataFrame:
    """Selective accuracy, Brier score and calibration of each group and over all (group null)."""
    both = rows.unionByName(rows.withColumn(group, F.lit(None).cast("string")))
    keyed = both.withColumn("__g", F.coalesce(group, F.lit("\0all")))
    found = stats.selective(keyed, ["__g"]).join(stats.brier(keyed, ["__g"]), "__g").join(stats.calibration(keyed, ["__g"]).select("__g", "ece", "mce"), "__g")
    return found.withColumn(group, F.nullif("__g", F.lit("\0all"))).drop("__g")


def compare(treatment: DataFrame, control: DataFrame, resamples: int = stats.RESAMPLES) -> DataFrame:
    """Paired difference with interval of each grader (grader, task, value), and the tasks of one side only."""
    found = stats.paired_bootstrap(treatment, control, ["grader"], resamples)
    t, c = treatment.select("grader", "task", F.lit(1).alias("t")), control.select("grader", "task", F.lit(1).alias("c"))
    lone = t.join(c, ["grader", "task"], "full").groupBy("grader").agg(F.count_if(F.col("t").isNull() | F.col("c").isNull()).alias("unpaired"))
    return found.join(lone, "grader")


def gate_checks(differences: DataFrame) -> DataFrame:
    """Compared graders against their margins: passed, underpowered or regressed."""
    rules = differences.sparkSession.createDataFrame(MARGINS, "grader string, margin double")
    passed = F.col("lower") >= -F.col("margin")
    return differences.join(F.broadcast(rules), "grader").withColumn("check", F.when(passed, "passed").when(F.col("estimate") >= -F.col("margin"), "underpowered").otherwise("regressed"))


def gate_verdict(checks: DataFrame, calibration: DataFrame, costs: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row with the verdict. calibration: estimate, upper; costs: candidate, baseline (medians); tasks: tasks."""
    quality = checks.agg(F.count_if(F.col("check") == "regressed").alias("regressed"), F.count_if(F.col("check") == "underpowered").alias("underpowered"))
    worst = F.greatest("candidate", "baseline")
    dear = (worst >= COST_FLOOR) & (F.col("baseline") > 0) & ((F.col("candidate") - F.col("baseline")) / F.col("baseline") > COST_INCREASE)
    off = F.col("upper") > CALIBRATION_MARGIN
    verdict = (
        F.when(F.col("tasks") < MINIMUM_TASKS, "INCONCLUSIVE").when(F.col("regressed") > 0, "FAIL_QUALITY").when(F.col("underpowered") > 0, "INCONCLUSIVE")
        .when(off & (F.col("estimate") <= CALIBRATION_MARGIN), "INCONCLUSIVE").when(off, "FAIL_CALIBRATION").when(dear, "FAIL_COST").otherwise("PASS")
    )
    return quality.crossJoin(calibration).crossJoin(costs).crossJoin(tasks).select("tasks", "regressed", "underpowered", verdict.alias("verdict"))  # one row each


def sweep(run: Callable[[dict], DataFrame], configurations: dict[str, dict]) -> DataFrame:
    """The same plan under several configurations, each row with its configuration's name."""
    found = None
    for name, settings in configurations.items():
        part = run(settings).withColumn("configuration", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def result_status(results: DataFrame, counts: DataFrame) -> DataFrame:
    """Whether a result set can be quoted, what stands against it, and whether the data have grown since."""
    j = results.join(counts, "split", "left")
    caveats = F.array_compact(
        F.array(F.when(F.col("tasks") < 30, F.lit("few tasks")), F.when(F.col("stub"), F.lit("stub model")), F.when(F.col("tasks") < F.coalesce("available", F.lit(0)), F.lit("stale")))
    )
    return j.withColumn("caveats", caveats).withColumn("quotable", F.size("caveats") == 0)


def blind_sample(rows: DataFrame, key: str, answers: list[str], size: int, seed: str = "blind") -> DataFrame:
    """A seeded sample in a seeded order with the answers removed; the size is the sample's purpose."""
    order: Column = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    return rows.withColumn("ticket", order).orderBy("ticket").limit(size).drop(*answers)


def labelled_back(sheet: DataFrame) -> DataFrame:
    """The answered rows of a returned sheet."""
    return sheet.filter(F.trim(F.coalesce("verdict", F.lit(""))) != "")
