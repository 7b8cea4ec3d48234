"""Text that gives orders, leaks and broken links."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelens.functions import columns as C
from quakelens.sources.staging import importable

#: Characters of texts, and of markers, that meet in one task; a row counts as ROW_CHARS more, as objects take room too.
PART_CHARS, PART_MARKERS, ROW_CHARS = 8 << 20, 1 << 20, 100
#: Texts that are Python objects at one time.
TEXTS_AT_ONCE = 10_000


def classified(rows: DataFrame, column: str) -> DataFrame:
    """Rows with the categories of orders in a text column."""
    return rows.withColumn("categories", C.injection_categories(F.col(column)))


def sanitised(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Free-text columns with suspicious ones withheld, and how many were."""
    marks = [F.when(F.size(C.injection_categories(F.col(f))) > 0, 1).otherwise(0) for f in fields]
    total = marks[0]
    for m in marks[1:]:
        total = total + m
    return rows.withColumn("withheld", total).withColumns({f: C.withheld(F.col(f)) for f in fields})


def _found_in(sides: tuple[str, str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, markers: pa.Table) -> pa.Table:
        numbers, keys = array("q"), array("q")
        if texts.num_rows and markers.num_rows:
            search = ahocorasick.Automaton()
            of: dict[str, list[int]] = {}
            for i, marker in enumerate(markers.column("marker").to_pylist()):
                of.setdefault(marker, []).append(i)
            for marker in of:
                search.add_word(marker, marker)
            search.make_automaton()
            for at in range(0, texts.num_rows, TEXTS_AT_ONCE):
                for i, text in enumerate(texts.column("text").slice(at, TEXTS_AT_ONCE).to_pylist(), at):
                    own = [k for marker in {m for _, m in search.iter(text)} for k in of[marker]]
                    numbers.extend(own)
                    keys.extend([i] * len(own))
        take = lambda t, name, rows: t.column(name).take(pa.array(np.frombuffer(rows, np.int64)))
        return pa.table([take(markers, sides[0], numbers), take(texts, sides[1], keys)], names=list(sides))

    return run


def canary_hits(texts: DataFrame, canaries: DataFrame, text: str, text_key: str, key: str, canary: str, part_chars: int = PART_CHARS, part_markers: int = PART_MARKERS) -> DataFrame:
    """Which markers occur in which texts, for any number of markers of any length.

    Markers and texts are dealt into parts of bounded size, and each part of texts is read once for each part of markers, by
    one automaton over all of these (Aho-Corasick): time goes with the texts' length, not with texts times markers. Empty
    and null markers and null texts find nothing; repeated rows count once.
    """
    importable(texts.sparkSession)
    mine, theirs = "item", "place"
    rows = texts.select(F.col(text_key).alias(theirs), F.col(text).alias("text")).filter("text is not null and text <> ''")
    marks = canaries.select(F.col(key).alias(mine), F.col(canary).alias("marker")).filter("marker is not null and marker <> ''")
    chars, n = (t.agg(F.sum(F.length(c) + ROW_CHARS)).first()[0] or 0 for t, c in ((rows, "text"), (marks, "marker")))
    parts, turns = max(1, -(-chars // part_chars)), max(1, -(-n // part_markers))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    dealt = rows.select(theirs, "text", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"), every(turns).alias("turn"))
    asked = marks.select(mine, "marker", F.pmod(F.xxhash64("marker"), F.lit(turns)).cast("int").alias("of_turn"), every(parts).alias("of_part"))
    kinds = {**dict(asked.dtypes), **dict(dealt.dtypes)}
    found = dealt.groupBy("part", "turn").cogroup(asked.groupBy("of_part", "of_turn")).applyInArrow(_found_in((mine, theirs)), f"{mine} {kinds[mine]}, {theirs} {kinds[theirs]}")
    return found.distinct().toDF(key, text_key)


def leakage_findings(texts: DataFrame, rules: DataFrame, text: str, key: str) -> DataFrame:
    """What stands in texts that must not, by rules (rule, kind, value); rows (rule, key, value).

    kind text: the value, in either case, anywhere (flag names, scenario ids); token: the value as a whole word, in either
    case (fault classes); field: the value as a quoted field name (what only the answers have); shape: a text that doesn't
    match the value as a pattern (ids that must not speak). Rules of kind shape are few, as patterns are code.
    """
    lower = texts.select(key, F.lower(F.col(text)).alias("__text"))
    anywhere = rules.filter("kind = 'text'").select("rule", "value", F.lower("value").alias("marker"))
    quoted = rules.filter("kind = 'field'").select("rule", "value", F.concat(F.lit('"'), "value", F.lit('"')).alias("marker"))
    named = lambda own, table, column: canary_hits(table, own.withColumn("__of", F.struct("rule", "value")), column, key, "__of", "marker").select("__of.rule", key, "__of.value")
    words = lower.select(key, F.explode(F.array_distinct(F.regexp_extract_all("__text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    tokens = words.join(rules.filter("kind = 'token'").withColumn("word", F.lower("value")), "word").select("rule", key, "value")
    shapes = rules.filter("kind = 'shape'").agg(F.collect_list(F.struct("rule", "value")).alias("shapes"))  # one row
    spoken = texts.crossJoin(F.broadcast(shapes)).select(key, F.inline(F.filter("shapes", lambda r: ~F.rlike(F.col(text), r["value"])))).select("rule", key, "value")
    return named(anywhere, lower, "__text").unionByName(named(quoted, texts, text)).unionByName(tokens).unionByName(spoken).distinct()


def vocabulary_findings(texts: DataFrame, words: DataFrame, text: str, key: str, rule: str) -> DataFrame:
    """Whole words of a vocabulary (word) in texts, case-insensitive, by an equi-join on the word."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))
    return found.join(words.select(F.lower("word").alias("word")).distinct(), "word").select(F.lit(rule).alias("rule"), key, "word")


def policy_lines(texts: DataFrame, words: DataFrame, text: str, key: str) -> DataFrame:
    """Lines of a text with a flagged word, with their numbers from 1."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    found = lines.select(key, (F.col("n") + 1).alias("line_number"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return found.join(words, "word")


def without_flags(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rows that mention no flag anywhere, in keys or values, upper or lower case."""
    whole = F.lower(F.to_json(F.struct(*rows.columns)))
    return rows.filter(~F.exists(F.array(*(F.lit(f.lower()) for f in flags)), lambda f: F.contains(whole, f)))


def links(pages: DataFrame) -> DataFrame:
    """The distinct internal targets of each page's links: paths without query and fragment."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""(?:href|src)="([^"]*)\""""), F.lit(1))).alias("target"))
    inner = found.filter(~F.col("target").rlike(r"^(#|[a-zA-Z][a-zA-Z0-9+.-]*:|//)") & (F.col("target") != ""))
    return inner.select("page_id", F.regexp_replace("target", r"[?#].*$", "").alias("path")).filter("path <> ''").distinct()


def broken_links(pages: DataFrame) -> DataFrame:
    """Internal targets that are no page's path."""
    known = pages.select(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path")).distinct()
    return links(pages).join(known, "path", "left_anti").select("page_id", "path")


def unsourced_numbers(texts: DataFrame, sources: DataFrame, text: str, key: str, tolerance: float = 0.01) -> DataFrame:
    """Numbers in prose that no structured number (key, value) of the same row comes near."""
    said = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))).alias("number"))
    said = said.withColumn("said", F.expr("try_cast(number as double)"))
    known = sources.groupBy(key).agg(F.collect_set("value").alias("known"))  # a row's own numbers
    near = F.exists("known", lambda v: F.abs(v - F.col("said")) <= F.greatest(F.abs(v) * tolerance, F.lit(1e-9)))
    return said.join(known, key, "left").filter(~F.coalesce(near, F.lit(False))).select(key, "number")
