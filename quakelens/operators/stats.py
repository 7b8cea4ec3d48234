"""Intervals, calibration, selective accuracy, reliability, agreement, thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelens.functions import columns as C
from quakelens.operators.prefix import running_sums
from quakelens.sources.staging import importable, staged

#: Odd multipliers of the mixed bits, and 31 of these, so that products stay within 64.
MIX, BITS = (2_654_435_761, 2_246_822_519, 739_982_445, 695_872_825), (1 << 31) - 1
RESAMPLES, SEED, CONFIDENCE, BINS = 10_000, 20_260, 0.95, 10
KAPPA_ROWS, KAPPA_LEAST = 60, 0.4  # fixed values
#: Weights are drawn from so many of the mixed bits: a weight of k or more from the k-th of these steps on.
WEIGHT_BITS = 20
STEPS = [round((1 << WEIGHT_BITS) * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9)]
#: Tasks to one partition at least, and those that are weighed together.
_PART_TASKS, _STRIP = 2_000, 32


def task_bits(task: Column) -> Column:
    """31 bits of a task's name."""
    return F.conv(F.substring(F.md5(F.coalesce(task.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long").bitwiseAND(BITS)


def weights(bits: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """How often each resample takes each task: Poisson numbers of mean 1 (a row for each task), from name, resample and seed alone."""
    h = (np.arange(resamples, dtype=np.int64) * MIX[0])[None, :] + (bits * MIX[1] + seed)[:, None]
    h &= BITS
    for factor, shift in zip(MIX[2:], (15, 12), strict=True):
        h ^= h >> shift
        h *= factor
        h &= BITS
    h ^= h >> 15
    return _table()[h >> (31 - WEIGHT_BITS)]


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.searchsorted(STEPS, np.arange(1 << WEIGHT_BITS), side="right").astype(np.float32)


def _weighed(keys: int, resamples: int, seed: int):
    """A partition's rows (keys, bits, value), sorted by the keys, to a row for each group and resample: weight and weighted sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        kinds: list = []
        total, summed = np.zeros(resamples), np.zeros(resamples)

        def group() -> pa.RecordBatch:
            of = [pa.repeat(pa.scalar(k, t), resamples) for k, t in zip(at, kinds, strict=True)]
            batch = pa.RecordBatch.from_arrays([*of, pa.array(np.arange(resamples)), pa.array(total.copy()), pa.array(summed.copy())], names=[*(f"k{i}" for i in range(keys)), "r", "w", "s"])
            total[:], summed[:] = 0, 0
            return batch

        for batch in batches:
            kinds = [c.type for c in batch.columns[:keys]]
            rows = list(zip(*(c.to_pylist() for c in batch.columns[:keys]), strict=True)) if keys else [()] * batch.num_rows
            bits, values = (batch.column(keys + i).to_numpy(zero_copy_only=False) for i in range(2))
            ends = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]] + [len(rows)]
            start = 0
            for end in ends if rows else []:
                if at is not None and rows[start] != at:
                    yield group()
                at = rows[start]
                for i in range(start, end, _STRIP):
                    some = slice(i, min(end, i + _STRIP))
                    w = weights(bits[some], resamples, seed)
                    total += w.sum(axis=0)
                    summed += values[some] @ w.astype(np.float64)
                start = end
        if at is not None:
            yield group()

    return run


def bootstrap(tasks: DataFrame, by: list[str], resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """Percentile interval of the mean over tasks (by, task, value), resampling tasks.

    A resample takes each task a Poisson number of times (mean 1), which needs nothing but the task: partitions sum weights
    and weighted values of all resamples in arrays, and only a row for each group, resample and partition is shuffled. A
    resample's mean is over what it took; one that took nothing has none. Rows of one task are taken together, null values
    never. The numbers depend on task, resample and seed alone, so results don't depend on partitions.
    """
    spark = tasks.sparkSession
    importable(spark)
    named = tasks.filter("value is not null").select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), task_bits(F.col("task")).alias("bits"), F.col("value").cast("double").alias("value"))
    parts = max(1, min(spark.sparkContext.defaultParallelism, tasks.count() // _PART_TASKS))
    keys = [f"k{i}" for i in range(len(by))]
    kinds = ", ".join(f"{k} {dict(named.dtypes)[k]}" for k in keys)
    dealt = named.repartition(parts, "bits").sortWithinPartitions(*keys, "bits")
    sums = dealt.mapInArrow(_weighed(len(by), resamples, seed), f"{kinds}{', ' if keys else ''}r long, w double, s double")
    means = sums.groupBy(*keys, "r").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    tail = (1 - confidence) / 2
    bounds = means.groupBy(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True))).agg(F.round(F.percentile("mean", F.lit(tail)), 6).alias("lower"), F.round(F.percentile("mean", F.lit(1 - tail)), 6).alias("upper"))
    return tasks.groupBy(*by).agg(F.round(F.avg("value"), 6).alias("estimate"), F.count("*").alias("tasks")).join(bounds, by)


def paired_differences(treatment: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of the values of tasks that both sides have."""
    t, c = treatment.withColumnRenamed("value", "t"), control.withColumnRenamed("value", "c")
    return t.join(c, keys).select(*keys, (F.col("t") - F.col("c")).alias("value"))


def paired_bootstrap(treatment: DataFrame, control: DataFrame, by: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Interval of the mean paired difference, and whether it excludes 0."""
    found = bootstrap(paired_differences(treatment, control, [*by, "task"]), by, resamples, seed)
    return found.withColumn("excludes_zero", (F.col("lower") > 0) | (F.col("upper") < 0))


def percentile(rows: DataFrame, column: str, by: list[str], share: float) -> DataFrame:
    """The linearly interpolated percentile."""
    return rows.groupBy(*by).agg(F.round(F.percentile(column, F.lit(share)), 6).alias("percentile"))


def _checked(confidence: str) -> Column:
    c = F.col(confidence)
    return F.when((c < 0) | (c > 1), F.raise_error(F.lit("a confidence must be from 0 to 1")).cast("double")).otherwise(c)


def brier(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean squared distance of confidence from outcome."""
    return rows.groupBy(*by).agg(F.round(F.avg(F.pow(_checked("confidence") - F.col("outcome").cast("double"), 2)), 6).alias("brier"))


def calibration_bins(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins, empty ones included."""
    place = F.least(F.floor(_checked("confidence") / (1.0 / bins)), F.lit(bins - 1))
    held = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("outcome").cast("double")).alias("a"))
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6)
    return every.join(held, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("predictions"), zero("c").alias("mean_confidence"), zero("a").alias("accuracy"))


def calibration(rows: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """Expected and largest calibration error."""
    place = F.least(F.floor(_checked("confidence") / (1.0 / bins)), F.lit(bins - 1))
    held = rows.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("confidence") - F.avg(F.col("outcome").cast("double"))).alias("gap"))
    return held.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"), F.sum("n").alias("predictions"))


def selective(rows: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, accuracy among answered, accuracy over all."""
    right = F.col("outcome")
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("answered").alias("answered"), F.round(F.count_if("answered") / F.count("*"), 6).alias("coverage"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("answered") & right), F.count_if("answered")), F.lit(0.0)), 6).alias("selective_accuracy"), F.round(F.count_if(right) / F.count("*"), 6).alias("overall_accuracy"),
    )


def risk_coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """The curve over observed thresholds, by sums that run over distinct confidences only.

    Thresholds are rounded to 6 digits and compared with unrounded confidences.
    """
    values = rows.groupBy(*by, "confidence").agg(F.count("*").alias("n"), F.count_if("answered").alias("a"), F.count_if(F.col("answered") & F.col("outcome")).alias("r"))
    marks = values.select(*by, F.round("confidence", 6).alias("threshold")).union(values.select(*by, F.lit(0.0))).distinct()
    both = values.select(*by, F.col("confidence").alias("at"), F.lit(1).alias("kind"), "n", "a", "r").unionByName(
        marks.select(*by, F.col("threshold").alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("r"))
    )
    summed = running_sums(both, by, [F.desc("at"), F.desc("kind")], ["a", "r"]).filter("kind = 0").withColumnsRenamed({"a": "kept", "r": "right"}).drop("n")
    totals = values.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.sum("n").alias("total"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    summed = summed.join(totals, same)  # a row for each group
    accuracy = F.coalesce(F.try_divide("right", "kept"), F.lit(0.0))
    return summed.select(*by, F.col("at").alias("threshold"), F.round(F.col("kept") / F.col("total"), 6).alias("coverage"), F.round(accuracy, 6).alias("accuracy"), F.round(1.0 - accuracy, 6).alias("risk"))


def reliability(trials: DataFrame, by: list[str], k: int) -> DataFrame:
    """pass@k and pass^k of tasks (by, task, outcome), averaged by task; tasks with fewer than k trials stop the job."""
    tasks = trials.groupBy(*by, "task").agg(F.count("*").alias("n"), F.count_if("outcome").alias("c"))
    n = F.when(F.col("n") < k, F.raise_error(F.lit("too few trials")).cast("long")).otherwise(F.col("n"))
    return tasks.groupBy(*by).agg(F.round(F.avg(C.pass_at_k(F.col("c"), n, k)), 6).alias("pass_at_k"), F.round(F.avg(C.pass_hat_k(F.col("c"), n, k)), 6).alias("pass_hat_k"), F.count("*").alias("tasks"))


def kappa(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cohen's kappa of two raters (first, second: boolean), and whether to trust it."""
    n = F.count("*")
    sums = rows.groupBy(*by).agg(n.alias("n"), (F.count_if(F.col("first") == F.col("second")) / n).alias("o"), (F.count_if("first") / n).alias("p"), (F.count_if("second") / n).alias("q"))
    expected = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    value = F.when(expected >= 1.0, 0.0).otherwise((F.col("o") - expected) / (1 - expected))
    return sums.select(*by, "n", F.round("o", 6).alias("agreement"), F.round(value, 6).alias("kappa"), ((F.col("n") >= KAPPA_ROWS) & (value >= KAPPA_LEAST)).alias("trusted"))


def threshold_curve(rows: DataFrame) -> DataFrame:
    """Sensitivity, specificity and Youden's J at each distinct score (score, faulted)."""
    values = staged(rows.groupBy("score").agg(F.count_if("faulted").alias("hit"), F.count_if(~F.col("faulted")).alias("alarm")), "scores")
    totals = values.agg(F.sum("hit").alias("all_f"), F.sum("alarm").alias("all_q"))
    summed = running_sums(values, [], [F.desc("score")], ["hit", "alarm"]).crossJoin(F.broadcast(totals))  # totals: one row
    sensitivity, specificity = F.coalesce(F.try_divide("hit", "all_f"), F.lit(0.0)), 1.0 - F.coalesce(F.try_divide("alarm", "all_q"), F.lit(0.0))
    return summed.select("score", F.round(sensitivity, 6).alias("sensitivity"), F.round(specificity, 6).alias("specificity"), F.round(sensitivity + specificity - 1, 6).alias("youden"))


def tuned_threshold(rows: DataFrame) -> DataFrame:
    """The geometric midpoint between quiet and faulted scores where they don't overlap, else the highest best score."""
    ends = rows.agg(F.max(F.when(~F.col("faulted"), F.col("score"))).alias("quiet_max"), F.min(F.when(F.col("faulted"), F.col("score"))).alias("faulted_min"))
    best = threshold_curve(rows).agg(F.max(F.struct("youden", "score")).alias("b"))
    apart = F.col("quiet_max") < F.col("faulted_min")
    return ends.crossJoin(best).select("quiet_max", "faulted_min", apart.alias("separable"), F.round(F.when(apart, F.sqrt(F.col("quiet_max") * F.col("faulted_min"))).otherwise(F.col("b.score")), 6).alias("threshold"))  # one row each


def optimisation_score(rows: DataFrame) -> DataFrame:
    """0.55 for a correct answer, 0.30 for valid evidence, 0.15 for little error of confidence."""
    return rows.withColumn("score", F.round(0.55 * F.col("outcome").cast("double") + 0.30 * F.col("evidence") + 0.15 * (1 - F.pow(F.col("confidence") - F.col("outcome").cast("double"), 2)), 6))
