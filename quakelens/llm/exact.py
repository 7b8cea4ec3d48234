"""Exact deduplication by skew-safe combining; full contents are compared at every stage.

1. Locally: within each Arrow batch, rows of equal content are combined into the best of them.
2. Salted groups: what is left is dealt by digest and a salt (from the batch), so a hot digest spreads over many tasks.
   There are as many salts as the square root of the number of batches, so that neither a salted group nor the global
   one of its winners holds more than about that many rows of a digest, however many copies there are.
3. Globally: the winners of the salted groups are combined by digest.

At each stage rows are equal only if digest and content are equal. Each stage says which row won over which, and every
document follows these steps to the row that stays. Contents move twice, once for each shuffle; ids follow separately.

Defined results: null texts count as empty, and all empty texts are equal; of equal texts the one with the most code
points, then the smallest id stays; an id that occurs in several rows gives a row for each, and each counts in
group_size; rows with a null id sort after others. Empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelens.llm.common import BATCH_ROWS, carried, small_batches, table

WHITE = b" \t\n\x0b\x0c\r"
#: The fewest salts.
SALTS = 16
_LOCAL = "row long, doc_id long, digest binary, content binary, points long, local long, n long, salt int"


def _combine_locally(salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document; the best of those with equal content in this batch carries the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            best: dict[bytes, int] = {}
            count: dict[bytes, int] = {}
            contents, lengths = [], []
            for i, text in enumerate(texts):
                content = (text or "").encode("utf-8").translate(None, WHITE)
                contents.append(content)
                lengths.append(len(text or ""))
                count[content] = count.get(content, 0) + 1
                j = best.get(content)
                if j is None or _rank(lengths[i], ids[i], rows[i]) < _rank(lengths[j], ids[j], rows[j]):
                    best[content] = i
            digests = [hashlib.sha256(c).digest() for c in contents]
            won = [best[c] for c in contents]
            partition, place = divmod(rows[0] if rows else 0, 1 << 33)
            salt = (partition + place // BATCH_ROWS) % salts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([c if w == i else None for i, (c, w) in enumerate(zip(contents, won, strict=True))], pa.binary()),
                    pa.array(lengths, pa.int64()),
                    pa.array([rows[w] for w in won], pa.int64()),
                    pa.array([count[c] for c in contents], pa.int64()),
                    pa.array([salt] * len(rows), pa.int32()),
                ],
                names=["row", "doc_id", "digest", "content", "points", "local", "n", "salt"],
            )

    return run


def _rank(points: int, doc_id: int | None, row: int) -> tuple:
    return (-points, doc_id is None, doc_id or 0, row)


def salts_for(rows: int) -> int:
    """The number of salts for a table of some number of rows."""
    return max(SALTS, math.isqrt(rows // BATCH_ROWS))


def deduplicate(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    salts = salts_for(docs.count()) if salts is None else salts
    # A row's own number, as ids may repeat. docs is read twice and must give the same rows in the same partitions each
    # time, as a scan of files does.
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    local = named.mapInArrow(_combine_locally(salts), _LOCAL)
    order = [F.col("points").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    winner = F.struct("row", "doc_id")

    salted = Window.partitionBy("digest", "salt", "content")
    second = local.filter("row = local").select(
        "row", "doc_id", "digest", "salt", "content", "points", F.first(winner).over(salted.orderBy(*order)).alias("won"), F.sum("n").over(salted).alias("m")
    )
    overall = Window.partitionBy("digest", "content")
    third = second.filter("row = won.row").select(
        "row", F.first(winner).over(overall.orderBy(*order)).alias("keep"), F.sum("m").over(overall).alias("group_size")
    )
    # Both uses of the salted groups read the same columns, so that their one exchange of contents serves both.
    steps = second.filter("m > 0").select(F.col("row").alias("local"), F.col("won.row").alias("salted")).join(third.withColumnRenamed("row", "salted"), "salted")
    return (
        local.select("row", "doc_id", "digest", "local")
        .join(steps, "local")
        .select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row"
        )
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""

    def kept(docs: DataFrame) -> DataFrame:
        numbered = docs.withColumn("row", F.monotonically_increasing_id())
        return numbered.join(deduplicate(docs).filter("kept").select("row"), "row", "left_semi").drop("row")

    return carried(docs, ("doc_id", "text"), kept)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("row")


ORACLE = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id)
"""
