"""Groups of spelling variants: words one letter apart, found by a bit-sliced position index.

1. Words are counted: letter runs of whole texts, a hash dropping a letter of some; tasks send words with their counts.
2. The vocabulary goes in blocks. Words one letter apart share their first KEY letters or their last KEY, so each word goes
   to the block of the one and to the block of the other; a block holds the words of many keys. Neighbours with the same
   first letters count in the first block, all others in the second, so that each pair is found once.
3. A block's index has a bitset over its words for each (position, letter). All words of one length are looked up
   together: the set of words equal so far, and the sets with one letter replaced, one more and one fewer, follow from the
   sets of one letter before by and, or, and a shift of the position.
4. A word's form is its most frequent near word if that is RATIO times as frequent; forms are followed to the last by
   pointer doubling. Each form is RATIO times as frequent as its word, so there are no circles.

Blocks have about BLOCK_LETTERS letters. Where the words of one key alone have more, its block is cut into parts, and each
part of the words looked up meets each part of the index. Words of LONG letters or more are dealt by length too, so that
few long words never make the index of a large block long.

Defined results: null and empty texts have no words; a null id counts as an empty one in the hash; repeated rows count each
for itself; an empty table gives no words. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelens.llm.common import small_batches, staged, table

_RUN = re.compile("[a-zÀ-ÿ]+")
#: One of so many words of a document, by hash, loses a letter.
DROPS = 199
LEAST_LETTERS, LEAST_TIMES = 6, 5
RATIO = 5
#: Letters by which words meet; a word of LEAST_LETTERS has two such ends that don't overlap.
KEY = LEAST_LETTERS // 2
BLOCK_LETTERS = 1 << 18
LONG = 48
#: Distinct words that a task counts before it sends them on.
_HELD = 200_000
#: Bytes of one bitset matrix (words looked up x words of the block).
_STRIP_BYTES = 1 << 20


def words_of(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """The words of a document of LEAST_LETTERS or more with their counts. Only A-Z become lower case."""
    found: dict[str, int] = {}
    for run in _RUN.findall((text or "").encode("utf-8").lower().decode("utf-8")):
        found[run] = found.get(run, 0) + 1
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, times in found.items():
        if len(run) < LEAST_LETTERS:
            continue
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % DROPS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LETTERS:
                continue
        yield run, times


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def sent() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, times in words_of(doc_id, text):
                held[word] = held.get(word, 0) + times
            if len(held) >= _HELD:
                yield sent()
    if held:
        yield sent()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n (occurrences) of the words of docs (doc_id, text, ...) with LEAST_TIMES occurrences or more."""
    small_batches(docs.sparkSession)
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


class PositionIndex:
    """Bitsets over some words for each (position, letter), and for each length."""

    def __init__(self, words: list[str]):
        self.words = words
        sizes = np.array([len(w) for w in words])
        self.width = -(-len(words) // 64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        places = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.keys, rows = np.unique(places << 21 | letters, return_inverse=True)
        self.bits = self._bitsets(len(self.keys) + 1, rows, np.repeat(np.arange(len(words)), sizes))  # the last row is empty
        self.lengths, rows = np.unique(sizes, return_inverse=True)
        self.of_length = self._bitsets(len(self.lengths) + 1, rows, np.arange(len(words)))

    def _bitsets(self, rows: int, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        bits = np.zeros((rows, self.width), np.uint64)
        np.bitwise_or.at(bits, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
        return bits

    def _at(self, place: int, letters: np.ndarray) -> np.ndarray:
        """The words with each of the letters at a place."""
        key = np.int64(place) << 21 | letters
        row = np.searchsorted(self.keys, key)
        row[row == len(self.keys)] = 0
        return self.bits[np.where(self.keys[row] == key, row, len(self.keys))]

    def _sized(self, length: int) -> np.ndarray:
        row = np.searchsorted(self.lengths, length)
        return self.of_length[row if row < len(self.lengths) and self.lengths[row] == length else -1]

    def near(self, asked: np.ndarray, same_start: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of asked, word) one letter apart. asked: letters of words of one length, a row a word.

        same_start: only pairs with equal first KEY letters, or else only the others.
        """
        n, m = asked.shape
        equal = np.full((n, self.width), ~np.uint64(0))
        replaced, more, fewer = np.zeros_like(equal), equal, np.zeros_like(equal)
        start = equal
        for i in range(m):
            letters = asked[:, i]
            here = self._at(i, letters)
            replaced = replaced & here | equal
            fewer = (fewer & self._at(i - 1, letters) if i else fewer) | equal
            equal = equal & here
            more = more & self._at(i + 1, letters) | equal
            if i == KEY - 1:
                start = equal
        found = replaced & ~equal & self._sized(m) | more & self._sized(m + 1) | fewer & self._sized(m - 1)
        found &= start if same_start else ~start
        row, group = np.nonzero(found)
        bits = np.unpackbits(found[row, group].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        return row[which], group[which] * 64 + bit


def _neighbours(block: pa.Table) -> pa.Table:
    """word, near and near_n of the pairs that one part of a block holds. asks: to be looked up, otherwise in the index."""
    asks = block.column("asks").to_pylist()
    words, times = block.column("word").to_pylist(), block.column("n").to_pylist()
    same_start = block.column("kind")[0].as_py() == 0
    indexed = [i for i, a in enumerate(asks) if not a]
    out_word, out_near, out_n = [], [], []
    if indexed:
        index = PositionIndex([words[i] for i in indexed])
        by_length: dict[int, list[str]] = {}
        for i, a in enumerate(asks):
            if a:
                by_length.setdefault(len(words[i]), []).append(words[i])
        for length, asked in by_length.items():
            strip = max(1, _STRIP_BYTES // (8 * index.width))
            for k in range(0, len(asked), strip):
                some = asked[k : k + strip]
                letters = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(some), length)
                for row, word in zip(*(x.tolist() for x in index.near(letters, same_start)), strict=True):
                    out_word.append(some[row])
                    out_near.append(index.words[word])
                    out_n.append(times[indexed[word]])
    return pa.table([pa.array(out_word, pa.string()), pa.array(out_near, pa.string()), pa.array(out_n, pa.int64())], names=["word", "near", "near_n"])


def _band(length: Column) -> Column:
    """0 for words below LONG letters, and then a band for each doubling of the length."""
    return F.when(length < LONG, 0).otherwise(1 + F.floor(F.log2(length / LONG) + 1e-9).cast("int"))


def near_words(words: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """word, near and near_n: both directions of every pair of distinct words (word, n) that differ by one letter."""
    small_batches(words.sparkSession)
    sized = words.select("word", "n", F.length("word").alias("letters"))
    total = sized.agg(F.sum("letters")).first()[0] or 0
    blocks = max(1, -(-total // block_letters))
    ends = [(0, F.substring("word", 1, KEY)), (1, F.expr(f"right(word, {KEY})"))]
    # Index rows stand in the band of their own length; words are looked up in the bands of the lengths that they can meet.
    met = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _band(F.col("letters") + d)))
    keyed = reduce(DataFrame.unionByName, [sized.select("*", F.lit(kind).alias("kind"), F.pmod(F.xxhash64(end), F.lit(blocks)).alias("block")) for kind, end in ends])
    at = ["kind", "block", "band"]
    index = keyed.withColumn("band", _band(F.col("letters")))
    # So many parts has a block; a row for each block.
    parts = staged(index.groupBy(*at).agg(F.ceil(F.sum("letters") / (2 * block_letters)).cast("int").alias("parts")), "spelling-blocks")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    holds = index.join(parts, at).select(*at, part.alias("part"), every.alias("turn"), "word", "n", F.lit(False).alias("asks"))
    asked = keyed.withColumn("band", F.explode(met)).join(parts, at)
    asked = asked.select(*at, every.alias("part"), part.alias("turn"), "word", "n", F.lit(True).alias("asks"))
    return holds.unionByName(asked).groupBy(*at, "part", "turn").applyInArrow(_neighbours, "word string, near string, near_n long")


def _followed(forms: DataFrame) -> DataFrame:
    """word and root, from (word, form) of the words that have one: each round looks twice as far."""
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = staged(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of words (word, n); words are distinct."""
    pairs = near_words(words, block_letters)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    found = words.join(best, "word", "left")
    enough = -F.col("best.minus") >= ratio * F.col("n")
    told = staged(
        found.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best.minus")).alias("form_n")),
        "spelling-forms",
    )
    roots = _followed(told.filter("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(staged(vocabulary(table(spark, sf_dir, "documents")), "spelling-words"))


#: The same by other means: a bitwise hash, and words that meet by what is left when a letter is taken out.
ORACLE = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS times, encode(doc_id || ':' || run)::BIT AS bits FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, bit_length(bits)), lambda i: get_bit(bits, (i // 8 * 8 + 7 - i % 8)::INT)::BIGINT)),
         lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
  FROM counted
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, sum(times)::BIGINT AS n FROM hashed GROUP BY 1
), vocabulary AS (SELECT word, n FROM words WHERE length(word) >= 6 AND n >= 5),
dropped AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM vocabulary)),
pairs AS (
  SELECT a.word, b.word AS near FROM dropped a JOIN dropped b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM dropped d JOIN vocabulary v ON v.word = d.rest
  UNION SELECT v.word, d.word FROM dropped d JOIN vocabulary v ON v.word = d.rest
), best AS (
  SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN vocabulary v ON v.word = p.near
  QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) = 1
), forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * v.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * v.n THEN b.near_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word
), chain AS (
  SELECT word, form AS root, 1 AS steps FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN roots r ON r.word = f.word
"""
