"""Integrity of recordings, knowledge, memory, proposals and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECOVERY_RUN, RECOVERY_SECONDS, RECOVERY_FACTOR, RECOVERY_FLOOR = 3, 300.0, 1.25, 0.00125  # fixed values


def without_known(new: DataFrame, held: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows to append: keys that aren't held yet, the first of each."""
    of = Window.partitionBy(key).orderBy(*order)
    return new.withColumn("__n", F.row_number().over(of)).filter("__n = 1").drop("__n").join(held.select(key).distinct(), key, "left_anti")


def checksum_findings(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (name, sha256) that are missing, changed or unlisted against a manifest (name, sha256)."""
    both = manifest.select("name", F.col("sha256").alias("want")).join(files.select("name", F.col("sha256").alias("have")), "name", "full")
    finding = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") != F.col("have"), "changed")
    return both.select("name", finding.alias("finding")).filter("finding is not null")


def bundle_findings(files: DataFrame, manifest: DataFrame, required: list[str], forbidden: list[str], own: str = "manifest.json") -> DataFrame:
    """What is wrong with recorded bundles, from their files (bundle_id, name, sha256) and what their manifests list.

    missing: listed, not there; changed: other content than listed; unlisted: there, not listed; forbidden: a file that holds
    answers; omitted: a required file that the manifest doesn't list; bare: a folder without a manifest. The manifest itself
    needs no listing.
    """
    key = ["bundle_id", "name"]
    listed = manifest.filter("name is not null").select(*key, F.col("sha256").alias("want")).withColumn("listed", F.lit(True))
    there = files.select(*key, F.col("sha256").alias("have")).withColumn("there", F.lit(True))
    both = listed.join(there, key, "full")
    finding = (
        F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull() & (F.col("name") != own), "unlisted")
        .when(F.col("listed") & ~F.coalesce(F.col("want") == F.col("have"), F.lit(False)), "changed")
    )
    found = both.select(*key, finding.alias("finding")).filter("finding is not null")
    answers = files.filter(F.col("name").isin(forbidden)).select(*key, F.lit("forbidden").alias("finding"))
    needed = manifest.groupBy("bundle_id").agg(F.collect_set("name").alias("names")).select("bundle_id", F.explode(F.array_except(F.array(*(F.lit(r) for r in required)).cast("array<string>"), "names")).alias("name"), F.lit("omitted").alias("finding"))
    bare = files.select("bundle_id").distinct().join(manifest.select("bundle_id").distinct(), "bundle_id", "left_anti").select("bundle_id", F.lit(own).alias("name"), F.lit("bare").alias("finding"))
    return found.unionByName(answers).unionByName(needed).unionByName(bare)


def split_of(key: Column, recorded: Column | None = None, salt: str = "split:", shares: tuple[float, float] = (0.5, 0.7)) -> Column:
    """The recorded split, else one by a salted digest's place between 0 and 1."""
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 13), 16, 10).cast("double") / float(2**52)
    assigned = F.when(part < shares[0], "train").when(part < shares[1], "validation").otherwise("test_id")
    return assigned if recorded is None else F.coalesce(recorded, assigned)


def held_out_rows(rows: DataFrame, allowed: str = "train") -> DataFrame:
    """Rows of a train-only table that come from another split."""
    return rows.filter(~F.col("split").eqNullSafe(F.lit(allowed)))


def agreement(reviews: DataFrame, by: str, verdict: str) -> DataFrame:
    """Whether reviewers agree; null with fewer than two."""
    return reviews.groupBy(by).agg(F.count("*").alias("reviews"), F.when(F.count("*") < 2, None).otherwise(F.count_distinct(F.coalesce(F.col(verdict).cast("string"), F.lit("\0"))) == 1).alias("agreed"))


def promoted(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """Reviews that become labels, with what each still lacks; incidents that have a label already stay out."""
    lacking = F.array_compact(
        F.array(F.when(F.col("true_cause").isNull(), F.lit("cause")), F.when(F.col("fault_class").isNull(), F.lit("fault class")), F.when(F.col("onset").isNull(), F.lit("onset")))
    )
    return without_known(reviews.withColumn("remaining", lacking), labels, "incident_id", ["received_at"])


def proposal_findings(proposals: DataFrame, allowed: DataFrame, services: DataFrame) -> DataFrame:
    """Proposals (proposal_id, action, service, evidence, approved) that may not run, with the reasons."""
    j = proposals.join(allowed.select("action", "reversible", F.lit(True).alias("listed")), "action", "left").join(services.select("service", F.lit(True).alias("known")).distinct(), "service", "left")
    why = F.array_compact(
        F.array(
            F.when(F.col("listed").isNull(), F.lit("not allowed")), F.when(F.col("evidence") <= 0, F.lit("no evidence")), F.when(F.col("known").isNull(), F.lit("unknown target")),
            F.when(~F.coalesce("reversible", F.lit(True)) & ~F.col("approved"), F.lit("needs approval")),
        )
    )
    return j.select("proposal_id", why.alias("findings"))


def already_executed(records: DataFrame) -> DataFrame:
    """Whether each proposal has been executed."""
    return records.groupBy("proposal_id").agg(F.bool_or(F.col("decision") == "executed").alias("executed"))


def undeclared(uses: DataFrame, inventory: DataFrame) -> DataFrame:
    """Flags and variants (flag, variant) in use that the inventory doesn't have."""
    flags = uses.join(inventory.select("flag").distinct(), "flag", "left_anti").select("flag", "variant", F.lit("unknown flag").alias("finding"))
    variants = uses.join(inventory.select("flag").distinct(), "flag", "left_semi").join(inventory, ["flag", "variant"], "left_anti").select("flag", "variant", F.lit("unknown variant").alias("finding"))
    return flags.unionByName(variants).distinct()


def recovery(signals: DataFrame, key: str, run: int = RECOVERY_RUN, seconds: float = RECOVERY_SECONDS) -> DataFrame:
    """Whether a signal (key, at, value, baseline, acted_at) stays low for a run of readings within a time.

    Readings that are null neither count nor break a run.
    """
    ceiling = F.when(F.col("baseline") > 0, F.col("baseline") * RECOVERY_FACTOR).otherwise(RECOVERY_FLOOR)
    since = (F.unix_micros("at") - F.unix_micros("acted_at")) / 1_000_000.0
    read = signals.filter(F.col("value").isNotNull()).withColumns({"inside": F.when(F.col("value") <= ceiling, 1).otherwise(0), "since": since}).filter((F.col("since") >= 0) & (F.col("since") <= seconds))
    of = Window.partitionBy(key).orderBy("at")
    runs = read.withColumns({"held": F.sum("inside").over(of.rowsBetween(-(run - 1), 0)), "n": F.row_number().over(of)})
    found = runs.groupBy(key).agg(F.count("*").alias("readings"), F.min(F.when((F.col("held") == run) & (F.col("n") >= run), F.col("since"))).alias("recovered_after"))
    every = signals.groupBy(key).agg(F.max("baseline").alias("baseline"))
    status = F.when(F.col("baseline").isNull() | F.col("readings").isNull(), "unknown").when(F.col("recovered_after").isNotNull(), "recovered").otherwise("not_recovered")
    return every.join(found, key, "left").select(key, status.alias("status"), F.round("recovered_after", 6).alias("recovered_after"))


def record_hash(previous: Column, fields: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", previous, *fields), 256)


def chain_breaks(records: DataFrame, chain: str, fields: list[str]) -> DataFrame:
    """The first record of each chain (chain, sequence, previous_hash, record_hash) that doesn't follow from the one before."""
    before = records.select(chain, (F.col("sequence") + 1).alias("sequence"), F.col("record_hash").alias("want"))
    joined = records.join(before, [chain, "sequence"], "left")
    own = record_hash(F.col("previous_hash"), [F.col("sequence").cast("string"), *(F.col(f).cast("string") for f in fields)])
    first = F.col("sequence") == 0
    broken = (own != F.col("record_hash")) | (~first & ~F.col("previous_hash").eqNullSafe(F.col("want"))) | (first & (F.col("previous_hash") != ""))
    return joined.filter(broken).groupBy(chain).agg(F.min("sequence").alias("first_break"))


def budget_stops(calls: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """The first round of each investigation at which a running total reaches its limit, and which; limits in order."""
    of = Window.partitionBy(key).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    sums = calls.withColumn("calls", F.lit(1)).withColumns({f"t_{c}": F.sum(c).over(of) for c in limits})
    reached = None
    for c, limit in limits.items():
        reached = F.when(F.col(f"t_{c}") >= limit, c) if reached is None else reached.when(F.col(f"t_{c}") >= limit, c)
    hit = sums.withColumn("limit", reached).filter("limit is not null")
    return hit.groupBy(key).agg(F.min(F.struct("round", "limit")).alias("f")).select(key, "f.round", "f.limit")


def stalls(rounds: DataFrame, key: str, value: str, quiet: int = 2) -> DataFrame:
    """Rounds at which a running total hasn't grown for some rounds."""
    of = Window.partitionBy(key).orderBy("round").rowsBetween(-quiet, 0)
    seen = rounds.withColumns({"__spread": F.max(value).over(of) - F.min(value).over(of), "__n": F.count("*").over(of)})
    return seen.filter(f"__spread = 0 and __n = {quiet + 1}").drop("__spread", "__n")


def repeated_calls(calls: DataFrame, key: str, call: str, least: int = 3) -> DataFrame:
    """Calls made again and again in one investigation."""
    return calls.groupBy(key, call).agg(F.count("*").alias("times")).filter(F.col("times") >= least)


def referential_findings(rules: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Keys of each rule's first table that its second lacks."""
    found = None
    for name, (rows, known, key) in rules.items():
        part = rows.select(F.col(key).cast("string").alias("key")).distinct().join(known.select(F.col(key).cast("string").alias("key")).distinct(), "key", "left_anti").select(F.lit(name).alias("rule"), "key")
        found = part if found is None else found.unionByName(part)
    return found


def not_exactly_one(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that don't have exactly one owner."""
    return rows.groupBy(key).agg(F.count_distinct(owner).alias("owners")).filter("owners <> 1")


def latest_window_edges(edges: DataFrame, keys: list[str], window: str, order: list[Column]) -> DataFrame:
    """One row for each edge and window, the last written."""
    of = Window.partitionBy(*keys, window).orderBy(*order)
    return edges.withColumn("__n", F.row_number().over(of)).filter("__n = 1").drop("__n")


def windows_of(edges: DataFrame, window: str) -> DataFrame:
    """The windows there are, newest first."""
    return edges.select(window).distinct().orderBy(F.desc(window))
