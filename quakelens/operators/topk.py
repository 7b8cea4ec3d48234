"""The best items of each question without scoring every item that shares something with it.

Items have features, each with an impact; a question gives features weights, and an item's score is at most the sum of
weight times impact over what they share. Impact-ordered heads of the posting lists give each question some good items and
so a score that the k-th best has at least. Then the features that are common for what they can bring are set aside, as
many as can't reach that score together: an item that has only such features is never met. What the others bring, and all
that the set-aside ones could bring, bounds an item's score, and only items that can still be among the best are scored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakelens.sources.staging import staged

#: Features of a question that are looked at first, and items of each of them.
FIRST_FEATURES, FIRST_ITEMS = 8, 64
#: Scores are rounded to 6 digits; bounds give way by so much.
_MARGIN = 2e-6


def _places(scored: DataFrame, ties: list[str], k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def essential(postings: DataFrame, asked: DataFrame, score: Callable[[DataFrame], DataFrame], item: list[str], k: int, floor: float) -> tuple[DataFrame, DataFrame]:
    """The features (query_id, feature, weight) that items must be met by, and for each question `least` and `rest`.

    least: a score that the k-th best item reaches, or the floor; rest: what the features set aside can bring at most.
    """
    lists = postings.groupBy("feature").agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    bound = staged(asked.join(lists, "feature").select("query_id", "feature", "weight", "n", (F.col("weight") * F.col("top")).alias("bound")), "topk-features")
    leading = Window.partitionBy("query_id").orderBy(F.desc("bound"), "feature")
    first = bound.withColumn("place", F.row_number().over(leading)).filter(F.col("place") <= FIRST_FEATURES).select("query_id", "feature")
    head = Window.partitionBy("feature").orderBy(F.desc("impact"), F.xxhash64(*item))
    heads = postings.join(first.select("feature").distinct(), "feature", "left_semi").withColumn("place", F.row_number().over(head)).filter(F.col("place") <= FIRST_ITEMS)
    some = score(first.join(heads.select("feature", *item), "feature").select("query_id", *item).distinct())
    least = _places(some.filter(F.col("score") >= floor), item, k).filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    known = bound.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(floor)))
    cheap = Window.partitionBy("query_id").orderBy(F.col("bound") / F.col("n"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    cut = staged(known.withColumn("together", F.sum("bound").over(cheap)).withColumn("aside", F.col("together") < F.col("least") - _MARGIN), "topk-cut")
    limits = cut.groupBy("query_id").agg(F.first("least").alias("least"), F.coalesce(F.sum(F.when(F.col("aside"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    return cut.filter("not aside").select("query_id", "feature", "weight"), limits


def met(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each feature that a question and an item share (query_id, item, points)."""
    return wanted.join(postings, "feature").drop("feature").withColumn("points", F.col("weight") * F.col("impact")).drop("weight", "impact")


def best(postings: DataFrame, asked: DataFrame, score: Callable[[DataFrame], DataFrame], item: list[str], k: int, floor: float = 0.0, ties: list[str] | None = None) -> DataFrame:
    """The k best items of each question with score and place; scores below the floor don't count.

    postings: item columns, feature, impact, one row for each feature of an item. asked: query_id, feature, weight, not
    negative. score: adds score to pairs (query_id, item columns), never above the sum of weight times impact.
    """
    wanted, limits = essential(postings, asked, score, item, k, floor)
    hits = met(postings, wanted).groupBy("query_id", *item).agg(F.sum("points").alias("points"))
    open_ = hits.join(limits, "query_id").filter(F.col("points") + F.col("rest") >= F.col("least") - _MARGIN).select("query_id", *item)
    return _places(score(staged(open_, "topk-open")).filter(F.col("score") >= floor), ties or item, k)
