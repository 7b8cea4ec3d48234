"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds of distributed sweeps.

Pieces longer than half a sequence open one each. The others go in bands of length, from the longest down; a round a band:

1. Range sort: the band's pieces and the gaps are sorted together by size, largest first, over as many ranges as their
   number asks for. A gap with room for several of the band's longest piece stands as that many slots of equal size.
2. Successor sweep: a gap raises the height by one, a piece lowers it. Each range sums its own steps, the ranges' totals
   are carried on, and so every piece and gap knows its height.
3. Conflicts by rank: a piece that wants the successor that another has taken gets the next one. These ranks are the
   heights: a piece takes the gap that reached the piece's height last, the smallest that fits and is free. At one height
   gaps and pieces alternate, and sizes are whole numbers up to the capacity, so a height has few rows.
4. Pieces that find no gap have the ranks 0, 1, ... and open new sequences: as many of the band's longest as fit share one,
   or, of short pieces, as many as have their summed length in one share.
5. The gaps shrink by what they took, new ones join, and the next band follows.

Where a band's pieces fit a sequence at most eight times this is best-fit decreasing, but that the last sequence a band
opens may stay half empty; bands of shorter pieces may open a few sequences more.

Defined results: a null text is empty and gives one piece, of the end id alone; documents of more than `capacity` ids are
cut, the first piece being the shorter one; repeated rows are packed each for itself; an empty table gives no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelens.llm.common import small_batches, staged, staged_at, table
from quakelens.llm.ids import VOCABULARY, encoder

CAPACITY = 2048
#: Bands end where one piece more fits into a sequence; short pieces need fewer bands. The last takes what is left.
DIVISORS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 21, 32, 64)
#: Pieces and slots in one range of a sweep, about.
RANGE_ROWS = 400_000
_END = np.zeros(1, np.uint32)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), _END]).astype("<u4", copy=False)
                start, length = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(ids[start : start + length])))
                    start, length = start + length, capacity
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of docs (doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, capacity), _PIECES)


def _slots(rooms: dict[int, int], widest: int, least: int, wanted: int) -> Column:
    """How often a gap is offered, by its room: no more slots in all than are wanted, the smallest gaps first.

    rooms: gaps by room. A gap left out has `wanted` free slots before it that fit every piece, so no piece would reach it.
    """
    offered, free = [], 0
    for room in sorted(r for r in rooms if r > least):
        each = max(1, room // widest)
        if room >= widest:
            each = min(each, -(-(wanted - free) // rooms[room]))
            if each <= 0:
                break
            free += each * rooms[room]
        offered.append((room, each))
    table_ = F.create_map(*(F.lit(x) for pair in offered for x in pair)) if offered else F.create_map().cast("map<int,int>")
    return F.coalesce(table_[F.col("room").cast("int")], F.lit(0))


def _swept(docs: DataFrame, gaps: DataFrame, slots: Column, events: int) -> DataFrame:
    """Each piece (id, length) with the sequence whose gap it takes, or with its rank among those that find none."""
    offered = gaps.withColumn("slots", slots).filter("slots > 0").select(
        F.expr("room div slots").alias("size"), F.lit(0).alias("kind"), F.col("sequence_id").alias("id"), F.explode(F.expr("sequence(1, slots)")).alias("slot")
    )
    both = offered.unionByName(docs.select(F.col("length").alias("size"), F.lit(1).alias("kind"), "id", F.lit(0).alias("slot")))
    order = [F.desc("size"), F.col("kind"), F.col("id"), F.col("slot")]
    ranges = -(-events // RANGE_ROWS)
    # Written once: range bounds come from a sample, and a second exchange would draw others.
    dealt = staged(both.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "packing-ranges")
    step = F.when(F.col("kind") == 0, 1).otherwise(-1)
    totals = dealt.groupBy("part").agg(F.sum(step).alias("total"))  # a row for each range
    carried = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    height = F.col("own") + F.col("carried") + F.col("kind")  # the upper end of the step, up or down
    stepped = dealt.withColumn("own", F.sum(step).over(within)).join(F.broadcast(carried), "part").withColumn("height", height)
    taken = F.lag(F.when(F.col("kind") == 0, F.col("id"))).over(Window.partitionBy("height").orderBy(*order))
    return stepped.withColumn("sequence_id", taken).filter("kind = 1").select(
        "id", F.col("size").alias("length"), "sequence_id", F.when(F.col("sequence_id").isNull(), -F.col("height")).alias("rank")
    )


def _opened(swept: DataFrame, first: int, widest: int, capacity: int) -> DataFrame:
    """id, length and sequence_id of every piece; those with a rank open sequences of ids below `first`."""
    if widest * 8 >= capacity:
        group = F.expr(f"rank div {capacity // widest}")
    else:
        # Ranks follow the lengths, so a run of equal lengths tells the summed length before each of its pieces.
        runs = swept.filter("rank is not null").groupBy("length").agg(F.min("rank").alias("from"), F.count("*").alias("n"))  # at most `capacity` rows
        longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select("length", "from", F.coalesce(F.sum(F.col("length") * F.col("n")).over(longer), F.lit(0)).alias("before"))
        swept = swept.join(F.broadcast(runs), "length", "left")
        group = F.expr(f"(before + (rank - from) * length) div {capacity - widest}")
    return swept.select("id", "length", F.coalesce("sequence_id", F.lit(first) - group).alias("sequence_id"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of cut (length from 1 to capacity, ...) with sequence_id and offset.

    Each round writes its placements and the gaps that it leaves; the next one starts from these files, and the result
    reads all placements in one scan, so no plan holds more than one round.
    """
    names = cut.columns
    spark = cut.sparkSession
    rows = staged(cut.select("*", F.monotonically_increasing_id().alias("__id"), F.col("length").cast("long").alias("__length")), "pieces")
    items = rows.select(F.col("__id").alias("id"), F.col("__length").alias("length"))
    lengths = {r.length: r["count"] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    large = items.filter(2 * F.col("length") > capacity).select("id", "length", F.col("id").alias("sequence_id"), F.lit(0).alias("round"))
    written = [staged_at(large, "packing-placed")]
    placed = spark.read.schema(large.schema)
    gaps = placed.parquet(written[0]).select("sequence_id", (capacity - F.col("length")).alias("room")).filter("room > 0")
    ends = [capacity // d for d in DIVISORS if capacity >= d] + [0]
    for turn, (most, least) in enumerate(zip(ends, ends[1:], strict=False), 1):
        wanted = sum(n for x, n in lengths.items() if least < x <= most)
        if not wanted:
            continue
        widest = max(x for x in lengths if least < x <= most)
        rooms = {r.room: r["count"] for r in gaps.groupBy("room").count().collect()}  # at most `capacity` rows
        slots = _slots(rooms, widest, least, wanted)
        band = items.filter((F.col("length") > least) & (F.col("length") <= most))
        swept = staged(_swept(band, gaps, slots, wanted + sum(n for r, n in rooms.items() if r > least)), "packing-swept")
        first = -(turn << 44) - 1
        written.append(staged_at(_opened(swept, first, widest, capacity).select("id", "length", "sequence_id", F.lit(turn).alias("round")), "packing-placed"))
        changes = gaps.union(placed.parquet(written[-1]).select("sequence_id", -F.col("length")))
        room = F.sum("room") + F.when(F.col("sequence_id") <= first, capacity).otherwise(0)
        gaps = staged(changes.groupBy("sequence_id").agg(room.alias("room")).filter("room > 0"), "packing-gaps")
    places = placed.parquet(*written).select(F.col("id").alias("__id"), "sequence_id", F.col("round").alias("__round"))
    before = Window.partitionBy("sequence_id").orderBy("__round", "__id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(places, "__id").select(*names, "sequence_id", F.coalesce(F.sum("__length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
