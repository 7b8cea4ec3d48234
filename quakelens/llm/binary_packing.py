"""Packing without padding: each document's ids are split into pieces of power-of-two lengths, and equal lengths share a bucket.

A document of n ids gives n div capacity pieces of the full capacity and, for the rest, one piece for each bit of n mod
capacity, the longest first. Each piece is a sequence of its own, so no sequence crosses documents and none is padded.
Bucket k holds the sequences of length 2^k; a batch takes as many neighbours of one bucket as make `batch_tokens` ids, so
that every batch but a bucket's last has that many.

One pass encodes and cuts. A task numbers its own sequences within each bucket, and the tasks' counts, summed over the
tasks before (a row for each task and bucket), make these numbers dense. Ids of tokens are never shuffled.

Defined results: a null text is empty and gives one piece, of the end id alone; repeated rows are packed each for itself;
rows with a null id are packed too; an empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelens.llm.common import small_batches, staged, table
from quakelens.llm.ids import VOCABULARY, encoder

CAPACITY = 1024
BATCH_TOKENS = 1 << 19
#: Token bytes in one Arrow batch from a task, about; a piece is never larger than the capacity.
_BATCH_BYTES = 4 << 20
_END = np.zeros(1, "<u4")
_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, place long"


def binary_lengths(n: int, capacity: int) -> list[int]:
    """The lengths into which n ids are cut; capacity is a power of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def _split(path: str, capacity: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def emitted(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        places: Counter = Counter()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), _END]).astype("<u4", copy=False)
                start = 0
                for length in binary_lengths(len(ids), capacity):
                    rows.append((doc, start, length, len(ids), ids[start : start + length].tobytes(), part, places[length]))
                    places[length] += 1
                    start, size = start + length, size + 4 * length + 48
                    if size >= _BATCH_BYTES:
                        yield emitted(rows)
                        rows, size = [], 0
            if rows:
                yield emitted(rows)

    return run


def binary_pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit) of every piece of docs (doc_id, text, ...).

    part is the task that made a piece, place its number in that task among pieces of its length.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"the capacity {capacity} is no power of two")
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_split(path, capacity), _PIECES)


def bucketed(pieces: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The rows of pieces (length, part, place, ...) with sequence_id, offset, bucket and batch_id; without part and place.

    sequence_id is dense from 0, bucket after bucket from the shortest on; batch_id is dense within a bucket.
    """
    names = [c for c in pieces.columns if c not in ("part", "place")]
    rows = staged(pieces, "binary-pieces")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))  # a row for each task and bucket
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n"))  # log2(capacity) + 1 rows at most
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    first = buckets.select("length", F.coalesce(F.sum("n").over(shorter), F.lit(0)).alias("__first"))
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before")).join(F.broadcast(first), "length")
    within = F.col("__before") + F.col("place")
    return rows.join(before, ["length", "part"]).select(
        *names, (F.col("__first") + within).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"), F.expr(f"(__before + place) div greatest({batch_tokens} div length, 1)").alias("batch_id"),
    )


def write_sequences(pieces: DataFrame, path: str, batch_tokens: int = BATCH_TOKENS) -> None:
    """Write the sequences with their ids to path, a folder for each bucket, as a loader reads one length at a time."""
    bucketed(pieces, batch_tokens).write.partitionBy("bucket").parquet(path)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = binary_pieces(table(spark, sf_dir, "documents"))
    return bucketed(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "part", "place"))
