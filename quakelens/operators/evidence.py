"""Evidence records, claims and the gate that deletes what doesn't hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIVE, SURE, SURE_KINDS, LEAST_SUPPORT = 0.01, 0.8, 2, 2  # fixed values


def canonical(columns: list[str]) -> Column:
    """A row as JSON with its fields in name order, nulls included."""
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')), F.lit("null"))) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def result_hashes(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """V2: a digest of each result's rows in their order. For results of a report's size; graph_fingerprint is for tables."""
    row = F.struct(*order, canonical(columns).alias("__row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["__row"]), "\n")
    return rows.groupBy(*by).agg(F.count("*").alias("row_count"), F.sha2(joined, 256).alias("result_sha256"))


def without_repeats(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """V3: the first record of each id, and how often it came again."""
    of = Window.partitionBy(key)
    return records.withColumns({"__n": F.row_number().over(of.orderBy(*order)), "repeats": F.count("*").over(of) - 1}).filter("__n = 1").drop("__n")


def re_execution(first: DataFrame, again: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """V4: evidence (evidence_id, result_sha256) against its second run: same, drifted with its numbers intact, or mismatched.

    facts: evidence_id, holds - whether the numbers cited from it still hold.
    """
    both = first.select("evidence_id", F.col("result_sha256").alias("x")).join(again.select("evidence_id", F.col("result_sha256").alias("y")), "evidence_id", "left")
    if facts is not None:
        both = both.join(facts.groupBy("evidence_id").agg(F.bool_and("holds").alias("holds")), "evidence_id", "left")
    holds = F.coalesce("holds", F.lit(False)) if facts is not None else F.lit(False)
    return both.select("evidence_id", F.when(F.col("y").isNull(), "missing").when(F.col("x") == F.col("y"), "same").when(holds, "drifted").otherwise("mismatched").alias("status"))


def number_holds(cited: Column, fact: Column, unit: Column) -> Column:
    """Whether a cited number is a fact's: exact for counts, else within a share."""
    return F.when(unit == "count", cited == fact).otherwise(F.abs(cited - fact) <= F.greatest(F.abs(fact) * RELATIVE, F.lit(1e-9)))


def cited_numbers(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Cited numbers (claim_id, evidence_id, field, cited) with whether a fact of that evidence supports them."""
    near = claims.join(facts.select("evidence_id", "field", "value", "unit"), ["evidence_id", "field"], "left")
    return near.groupBy("claim_id", "evidence_id", "field", "cited").agg(F.coalesce(F.bool_or(number_holds(F.col("cited"), F.col("value"), F.col("unit"))), F.lit(False)).alias("holds"))


def coverage_findings(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """V5: claims (claim_id, evidence_ids) that cite nothing or something unknown."""
    none = claims.filter(F.size("evidence_ids") <= 0).select("claim_id", F.lit("cites nothing").alias("finding"))
    unknown = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")
    return none.unionByName(unknown.select("claim_id", F.lit("unknown evidence").alias("finding")).distinct())


def out_of_order(claims: DataFrame, by: str) -> DataFrame:
    """Timeline claims (position, at) that are dated after the one that follows."""
    following = F.lead("at").over(Window.partitionBy(by).orderBy("position"))
    return claims.withColumn("following", following).filter(F.col("at") > F.col("following"))


def inconsistent(reports: DataFrame, board: DataFrame) -> DataFrame:
    """V6: reports whose named cause isn't the leading hypothesis (bundle_id, hypothesis, support)."""
    lead = board.groupBy("bundle_id").agg(F.min(F.struct((-F.col("support")).alias("s"), "hypothesis")).alias("b")).select("bundle_id", F.col("b.hypothesis").alias("leading"))
    return reports.join(lead, "bundle_id").filter(F.col("root_cause").isNotNull() & (F.col("root_cause") != F.col("leading")))


def too_sure(reports: DataFrame, cited: DataFrame) -> DataFrame:
    """V7: reports of a high confidence that rests on fewer kinds of signal than it should."""
    kinds = cited.groupBy("bundle_id").agg(F.count_distinct("kind").alias("kinds"))
    return reports.join(kinds, "bundle_id", "left").filter((F.col("confidence") > SURE) & (F.coalesce("kinds", F.lit(0)) < SURE_KINDS))


def board(votes: DataFrame) -> DataFrame:
    """V8: each hypothesis's distinct evidence for it less that against it, and whether it suffices (bundle_id, hypothesis, evidence_id, supports)."""
    sums = votes.groupBy("bundle_id", "hypothesis").agg(
        F.count_distinct(F.when(F.col("supports"), F.col("evidence_id"))).alias("for"), F.count_distinct(F.when(~F.col("supports"), F.col("evidence_id"))).alias("against")
    )
    return sums.withColumn("support", F.col("for") - F.col("against")).withColumn("suffices", F.col("support") >= LEAST_SUPPORT)


def gated(claims: DataFrame, failing: DataFrame) -> DataFrame:
    """V9: the claims that no check failed."""
    return claims.join(failing.select("claim_id").distinct(), "claim_id", "left_anti")


def fetch(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored evidence by id, with a note where there is none."""
    return wanted.join(evidence.withColumn("found", F.lit(True)), "evidence_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
