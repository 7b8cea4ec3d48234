"""Running sums over a whole table or large groups, in two levels, so that no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelens.sources.staging import staged


def running_sums(rows: DataFrame, by: list[str], order: list[Column], columns: list[str], parts: int | None = None) -> DataFrame:
    """rows with the columns summed up to and including each row, by group and order; rows of equal order must not occur.

    Rows are range-sorted over partitions once and written, since a second exchange would draw other bounds. Ranges are
    summed, their totals carried on (a row for each range and group in it), and each range adds what came before it.
    """
    whole = rows.withColumn("__all", F.lit(0)) if not by else rows
    own = by or ["__all"]
    at = [*(F.col(c) for c in own), *order]
    ranged = whole.repartitionByRange(parts, *at) if parts else whole.repartitionByRange(*at)
    dealt = staged(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*own, "__part").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    earlier = Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*own, "__part", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns))
    within = Window.partitionBy(*own, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({c: F.sum(c).over(within) for c in columns})
    # Groups may be null.
    b = before.select(*(F.col(c).alias(f"__by_{c}") for c in own), F.col("__part").alias("__of"), *(f"__{c}" for c in columns))
    same = F.col("__part") == F.col("__of")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return summed.join(b, same).select(*(F.col(c) + F.col(f"__{c}") if c in columns else F.col(c) for c in rows.columns)).toDF(*rows.columns)
