"""Runbook sections and similar incidents, for a batch of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelens.functions.columns import memory_tokens, runbook_tokens
from quakelens.operators.topk import best
from quakelens.sources.staging import staged

K1, COVERS, SYMPTOM, TITLE = 1.2, 4.0, 2.5, 0.75  # fixed values
#: Characters of sections times questions in one part.
PAIR_CHARS = 1 << 29
TOP_SECTIONS, TOP_MATCHES, LEAST_SIMILARITY, SHARED_SERVICE = 5, 3, 0.10, 0.25  # fixed values


def sections(runbooks: DataFrame) -> DataFrame:
    """Sections of each body (runbook_id, title, covers, body) at its ## headings; a preamble bears the title."""
    parts = runbooks.select("runbook_id", "title", "covers", F.posexplode(F.split(F.concat(F.lit("\n"), F.trim("body")), r"\n##[ \t]+", -1)).alias("number", "part"))
    heading = F.when(F.col("number") == 0, F.col("title")).otherwise(F.trim(F.substring_index("part", "\n", 1)))
    # What follows the heading's line; a heading alone has no text.
    text = F.when(F.col("number") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    return parts.select("runbook_id", "title", "covers", "number", heading.alias("heading"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text")).filter("text <> ''")


def sentences(runbooks: DataFrame) -> DataFrame:
    """Lines of each body that end a sentence, as sections of their own."""
    lines = runbooks.select("runbook_id", "title", "covers", F.posexplode(F.split("body", "\n")).alias("number", "text"))
    return lines.filter(F.col("text").endswith(".")).select("runbook_id", "title", "covers", "number", F.col("title").alias("heading"), "text")


def _sources(parts: DataFrame) -> list[tuple[str, Column]]:
    """What a section's points come from: kinds, and the words of each (repeated words of text count)."""
    found = [
        ("w", runbook_tokens(F.concat_ws(" ", "heading", "text"))), ("t", F.array_distinct(runbook_tokens(F.concat_ws(" ", "title", "heading")))), ("c", F.array_distinct("covers")),
    ]
    return [*found, ("s", F.array_distinct(runbook_tokens(F.array_join("symptoms", " "))))] if "symptoms" in parts.columns else found


def score_sections(parts: DataFrame, questions: DataFrame) -> DataFrame:
    """Score of each section for each question (query_id, text, service) that shares a term or names what it covers.

    Words meet in an equi-join, a section's own being counted once for all questions. Sections are dealt once, into parts
    small enough for all their scores; as long as the questions' words are few enough that Spark broadcasts them, both
    groupings stay within these parts, so that neither words nor points are shuffled.
    """
    key = ["runbook_id", "number"]
    size = parts.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    dealt = parts.repartition(max(1, -(-size * questions.count() // PAIR_CHARS)), *key)
    of = lambda kind, words: F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    words = dealt.select(*key, F.inline(F.concat(*(of(kind, own) for kind, own in _sources(parts))))).groupBy(*key, "kind", "word").agg(F.count("*").alias("tf"))
    terms = F.array_distinct(runbook_tokens(F.col("text")))
    asked = questions.select("query_id", F.inline(F.concat(*(of(kind, terms) for kind in "wts"), of("c", F.array("service")))))
    points = F.when(F.col("kind") == "w", F.col("tf") / (F.col("tf") + K1)).when(F.col("kind") == "t", F.lit(TITLE)).when(F.col("kind") == "c", F.lit(COVERS)).otherwise(F.lit(0.0))
    met = words.join(asked, ["kind", "word"]).select("query_id", *key, points.alias("points"), (F.col("kind") == "s").cast("int").alias("sign"))
    found = met.groupBy("query_id", *key).agg(F.sum("points").alias("points"), F.sum("sign").alias("signs"))
    return found.select("query_id", *key, F.round(F.col("points") + SYMPTOM * F.col("signs") / (F.col("signs") + K1), 6).alias("score"))


def search(parts: DataFrame, questions: DataFrame, limit: int = TOP_SECTIONS) -> DataFrame:
    """The best sections for each question. Each part of the sections gives up its best, ties included, then they are placed."""
    key = ["runbook_id", "number"]
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "runbook_id")
    top = staged(score_sections(parts, questions).filter("score > 0").withColumn("near", F.rank().over(near)).filter(F.col("near") <= limit).drop("near"), "best-sections")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "runbook_id", "heading", "number")
    return top.join(parts.select(*key, "heading"), key).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def document_frequency(entries: DataFrame) -> DataFrame:
    """Rarity of each token over the entries (incident_id, symptom_summary)."""
    seen = entries.select(F.explode(F.array_distinct(memory_tokens(F.col("symptom_summary")))).alias("token"))
    total = entries.agg(F.count("*").alias("total"))
    return seen.groupBy("token").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("token", "n", F.log(1.0 + F.col("total") / F.col("n")).alias("rarity"))  # total: one row


def _weighted(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, token and its weight; tokens that no entry has are the rarest."""
    rarity = document_frequency(entries).select("token", "rarity")
    rarest = rarity.agg(F.max("rarity").alias("rarest"))
    asked = questions.select("query_id", F.explode(F.array_distinct(memory_tokens(F.col("text")))).alias("token"))
    return asked.join(rarity, "token", "left").crossJoin(F.broadcast(rarest)).select("query_id", "token", F.coalesce("rarity", "rarest").alias("w"))  # rarest: one row


def similarity(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of a question's rarity-weighted tokens that an entry has, for all pairs that share a token."""
    weighted = _weighted(entries, questions)
    weights = weighted.groupBy("query_id").agg(F.sum("w").alias("whole"))
    held = entries.select("incident_id", F.explode(F.array_distinct(memory_tokens(F.col("symptom_summary")))).alias("token"))
    shared = held.join(weighted, "token").groupBy("query_id", "incident_id").agg(F.sum("w").alias("part"))
    return shared.join(weights, "query_id").select("query_id", "incident_id", (F.col("part") / F.col("whole")).alias("similarity"))


def similar_incidents(entries: DataFrame, questions: DataFrame, limit: int = TOP_MATCHES, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The closest entries of each question (query_id, text, services), with a bonus for shared services.

    Entries that can't be among the closest are not scored (topk); a bound takes the bonus as if all services were shared.
    """
    weighted = staged(_weighted(entries, questions), "question-tokens")
    weights = weighted.groupBy("query_id").agg(F.sum("w").alias("whole"), F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("asks"))
    whole = staged(questions.select("query_id", "services").join(weights, "query_id"), "questions")
    all_shared = 1.0 + SHARED_SERVICE * F.greatest(F.size(F.array_distinct("services")), F.lit(0))
    asked = weighted.join(whole.select("query_id", "whole", all_shared.alias("bonus")), "query_id").select("query_id", F.col("token").alias("feature"), (F.col("w") / F.col("whole") * F.col("bonus")).alias("weight"))
    held = staged(entries.select("incident_id", "services_involved", F.array_distinct(memory_tokens(F.col("symptom_summary"))).alias("has")), "entry-tokens")

    def score(pairs: DataFrame) -> DataFrame:
        part = F.aggregate(F.array_intersect(F.map_keys("asks"), F.col("has")), F.lit(0.0), lambda total, t: total + F.element_at("asks", t))
        shared = F.size(F.array_intersect("services_involved", "services"))
        both = pairs.join(held, "incident_id").join(whole, "query_id")
        return both.select("query_id", "incident_id", F.round(part / F.col("whole") * (1.0 + SHARED_SERVICE * shared), 6).alias("score"), shared.alias("shared_services"))

    postings = held.select("incident_id", F.explode("has").alias("feature"), F.lit(1.0).alias("impact"))
    return best(postings, asked, score, ["incident_id"], limit, least)
