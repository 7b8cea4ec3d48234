"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models of what patterns miss.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples: the
values that the fixed patterns label in a bounded sample of the corpus and generated digests are random; the sample's
other long words are ordinary. A word weighs no more than MAX_WEIGHT characters. What the patterns leave of a text is then
searched for long tokens: one whose log-likelihood ratio is at least MIN_RATIO a character is a span of kind "random".

Offsets are code points. A text is cut at a pattern's matches, and the lengths of the cuts and matches add up to places.
Running sums and cuts go in blocks, and what a lambda uses is bound once, so that texts of many megabytes with many
matches take time about in proportion to their length.

Defined results: null texts count as empty and have no spans; the spans' text is empty then and its digest that of the
empty string; texts are scanned whole; repeated rows give repeated results; with an empty table nothing is trained but
the digests, and nothing is found. Other columns are ignored (and kept by `redact`), but names beginning with "__secret"
are taken.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelens.llm.common import carried, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A whole run of too few characters never matches, so these equal a match of one or more with short ones dropped.
ACCESS, HEX, TOKEN = r"AKIA[A-Z0-9]{16,}+", r"[0-9a-f]{24,}+", r"[A-Za-z0-9+/_=-]{16,}+"
KINDS = ["assign", "access", "hex", "random"]
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
MIN_VALUE = 6
MIN_RATIO = 1.0
MAX_WEIGHT = 64
SAMPLE_ROWS, GENERATED = 2_000, 1_500
MARK = "[SECRET]"
_BLOCK = 128
_START = "~"  # stands before a token's first character; no token holds it
_SPAN = "struct<start:int,kind:int,end:int>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once; an expression used within a lambda is computed for each element."""
    return F.transform(F.array(value), use).getItem(0)


def _blocks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running results of step from 0 over an array of integers that isn't empty; appending stays within blocks."""

    def within(block: Column, start: Column) -> Column:
        return F.slice(F.aggregate(block, F.array(start), lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x))), F.lit(2), F.size(block))

    def over(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.aggregate(b, F.element_at(acc, -1), step)))
        return _let(starts, lambda s: F.flatten(F.transform(blocks, lambda b, j: within(b, F.get(s, j)))))

    return _let(values, lambda v: _let(_blocks(v), over))


def _places(hits: Column, text: Column, pattern: str, kind: int) -> Column:
    """Spans of a pattern's matches in the text (one at least)."""
    lengths = F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda h, p: F.length(h) + F.length(p))
    return F.zip_with(hits, _running(lengths, lambda a, b: a + b), lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def with_base_spans(docs: DataFrame) -> DataFrame:
    """docs with __secret_text (never null), __secret_values (what assign holds), and __secret_base: the patterns' spans."""
    text = F.col("__secret_text")
    found = docs.withColumn("__secret_text", F.coalesce(F.col("text"), F.lit("")))
    found = found.withColumns({f"__secret_{name}": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for name, pattern in PATTERNS.items()})
    held = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    found = found.withColumn("__secret_values", F.when(F.size("__secret_assign") > 0, held).otherwise(F.array().cast("array<string>")))
    spans = {}
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        hits = F.col(f"__secret_{name}")
        placed = _places(hits, text, pattern, kind)
        if name == "assign":
            placed = F.transform(F.filter(F.arrays_zip(placed.alias("s"), F.col("__secret_values").alias("v")), lambda x: F.length(x["v"]) >= MIN_VALUE), lambda x: x["s"])
        spans[f"__secret_s_{name}"] = F.when(F.size(hits) > 0, placed).otherwise(_none())
    return found.withColumns(spans).withColumn("__secret_base", F.array_sort(F.concat(*spans)))


def _blanked(text: Column, pattern: str) -> Column:
    """The text with spaces in place of a pattern's matches."""

    def joined(hits: Column, pieces: Column) -> Column:
        parts = F.zip_with(hits, F.slice(pieces, F.lit(1), F.size(hits)), lambda h, p: F.concat(p, F.repeat(F.lit(" "), F.length(h))))
        return F.concat(F.array_join(parts, ""), F.element_at(pieces, -1))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: _let(F.split(text, pattern, -1), lambda p: joined(h, p)))).otherwise(text)


def _pairs(words: DataFrame) -> DataFrame:
    """Weights of neighbouring characters by label, of (word, label)."""
    chars = words.select("label", F.split(F.concat(F.lit(_START), "word"), "").alias("c"), F.floor(1024 * F.least(F.lit(1.0), MAX_WEIGHT / F.length("word"))).alias("weight"))
    return chars.select("label", "weight", F.explode(F.zip_with(F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c) - 1)"), lambda a, b: F.concat(a, b))).alias("pair")).groupBy("label", "pair").agg(F.sum("weight").alias("weight"))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[float]:
    """The log-likelihood ratio of each character after each (code * 128 + code); from a sample of about `rows` documents."""
    spark = docs.sparkSession
    share = min(1.0, rows / max(1, docs.count()))
    # By hash, so that the sample is the same however the rows are dealt.
    some = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    based = with_base_spans(some)
    values = F.concat("__secret_values", "__secret_access", "__secret_hex")
    digest = F.sha2(F.col("id").cast("string"), 256)
    generated = spark.range(GENERATED).select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40), F.upper(F.substring(F.base64(F.unhex(F.md5(digest))), 1, 20)))).alias("word"))
    random = based.select(F.explode(values).alias("word")).filter(F.length("word") >= MIN_VALUE).unionByName(generated).select(F.regexp_replace("word", "[^A-Za-z0-9+/_=-]", "").alias("word"))
    words = based.select(F.explode(F.array_except(F.regexp_extract_all("__secret_text", F.lit(r"[A-Za-z0-9+/_=-]{8,}+"), F.lit(0)), values)).alias("word"))
    # Names may have one short number.
    words = words.filter(F.col("word").rlike("^[A-Za-z_=/+-]++(?:[0-9]{1,4}[A-Za-z_=/+-]*+)?$"))
    labelled = random.withColumn("label", F.lit(1)).unionByName(words.withColumn("label", F.lit(0))).filter(F.length("word") >= MIN_VALUE)
    alphabet = 68  # characters of a token; the table of pairs is bounded by its square
    counts = [[0.0] * (128 * 128) for _ in range(2)]
    totals = [[0.0] * 128 for _ in range(2)]
    for label, pair, weight in _pairs(labelled).collect():
        a, b = ord(pair[0]), ord(pair[1])
        counts[label][a * 128 + b] += weight / 1024
        totals[label][a] += weight / 1024
    return [
        round(math.log((counts[1][k] + 1) / (totals[1][k // 128] + alphabet)) - math.log((counts[0][k] + 1) / (totals[0][k // 128] + alphabet)), 6) for k in range(128 * 128)
    ]


def ratio(token: Column, model: list[float]) -> Column:
    """A token's log-likelihood ratio a character."""
    scores = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = F.transform(F.split(F.concat(F.lit(_START), token), ""), lambda c: F.ascii(c))
    steps = _let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(scores, a * 128 + b)))
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s) / F.length(token)


def with_spans(docs: DataFrame, model: list[float]) -> DataFrame:
    """docs with the columns of with_base_spans and __secret_spans: all spans, by start and kind."""
    found = with_base_spans(docs).withColumn("__secret_left", F.col("__secret_text"))
    for name, pattern in PATTERNS.items():
        found = found.withColumn("__secret_left", F.when(F.size(f"__secret_{name}") > 0, _blanked(F.col("__secret_left"), pattern)).otherwise(F.col("__secret_left")))
    found = found.withColumn("__secret_tokens", F.regexp_extract_all("__secret_left", F.lit(TOKEN), F.lit(0)))

    placed = F.arrays_zip(_places(F.col("__secret_tokens"), F.col("__secret_left"), TOKEN, KINDS.index("random")).alias("s"), F.col("__secret_tokens").alias("w"))
    odd = F.transform(F.filter(placed, lambda x: F.when(x["w"].rlike("[A-Za-z]"), ratio(x["w"], model) >= MIN_RATIO).otherwise(F.lit(False))), lambda x: x["s"])
    found = found.withColumn("__secret_odd", F.when(F.size("__secret_tokens") > 0, odd).otherwise(_none()))
    return found.withColumn("__secret_spans", F.array_sort(F.concat("__secret_base", "__secret_odd")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row of docs (doc_id, text, ...)."""
    found = with_spans(docs.select("doc_id", "text"), train(docs))
    return found.select(
        "doc_id", *(F.size(f"__secret_s_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS), F.sha2(_written(F.col("__secret_base")), 256).alias("base_sha256"), _written(F.col("__secret_spans")).alias("spans")
    )


def _merged(spans: Column) -> Column:
    """Overlapping spans of a sorted array as one; gives struct<start, end> in order."""

    def joined(s: Column, ends: Column) -> Column:
        # A span starts a new one where all spans before it have ended.
        numbered = F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), ((i == 0) | (x["start"] >= F.get(ends, i - 1))).alias("new")))
        firsts = F.filter(numbered, lambda x: x["new"])
        return _let(firsts, lambda f: F.transform(f, lambda x, j: F.struct(x["start"].alias("start"), F.coalesce(F.get(ends, F.get(f, j + 1)["i"] - 1), F.element_at(ends, -1)).alias("end"))))

    return _let(spans, lambda s: _let(_running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda ends: joined(s, ends)))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each of the spans (start, end), which are apart and in order. Cut first by blocks of spans, then within."""

    def of_block(blocks: Column, block: Column, j: Column) -> Column:
        start = F.when(j > 0, F.element_at(F.get(blocks, j - 1), -1)["end"]).otherwise(F.lit(0))
        part = lambda at: F.substring(text, at + 1, F.element_at(block, -1)["end"] - at)
        cut = lambda at, own: F.transform(block, lambda s, i: F.substring(own, F.when(i > 0, F.get(block, i - 1)["end"]).otherwise(at) - at + 1, s["start"] - F.when(i > 0, F.get(block, i - 1)["end"]).otherwise(at)))
        return _let(start, lambda at: _let(part(at), lambda own: cut(at, own)))

    def of(s: Column) -> Column:
        pieces = _let(_blocks(s), lambda blocks: F.flatten(F.transform(blocks, lambda block, j: of_block(blocks, block, j))))
        tail = F.substring(text, F.element_at(s, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(pieces, mark), F.lit(mark), tail)

    return _let(spans, of)


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with each secret in text replaced by a mark (overlapping ones by one mark), and n_chars of the new text."""

    def redacted(docs: DataFrame) -> DataFrame:
        columns = docs.columns
        found = with_spans(docs, train(docs))
        some = F.size("__secret_spans") > 0
        found = found.withColumn("text", F.when(some, _redacted(F.col("__secret_text"), _merged(F.col("__secret_spans")), mark)).otherwise(F.col("text")))
        if "n_chars" in columns:
            found = found.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return found.select(*columns)

    return carried(docs, ("doc_id", "text", "n_chars"), redacted)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
