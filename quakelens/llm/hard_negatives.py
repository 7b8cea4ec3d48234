"""Hard negatives by segment summaries: bounds from each segment's mean and deviation spare most exact scores.

A vector is cut into segments. Of a segment of s components with mean m and deviation d (the length of what is left when
the mean is taken off), the inner product of two vectors' segments is s * m * m' give or take d * d'. Summed over segments
this bounds a score from both sides. Summaries of few long segments and of many short ones are computed once and stored
with the vector; a search goes from the coarse to the fine, and only what no bound rules out is scored.

1. Positives: the rows of one label, in parts, meet the anchors of that label; each cell keeps its first `positives` rows
   of an anchor, and the first of all cells' rows are taken. A row goes if its upper bound is below as many lower bounds.
2. Negatives: all rows, in parts, meet the anchors with their positives. A positive's score sets a window; a row goes if it
   has the anchor's label, if its bounds miss all windows, or if `negatives` others that surely lie in the window beat it.

Cells hold about PART_ROWS rows and ANCHOR_ROWS anchors, whatever a label's share of the table. Results are exact.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part, nor do rows with a
component of LARGEST or more (scores of such would not fit); of rows with one id that with the smallest label, then vector
stays; vectors of different lengths are never compared; an anchor alone in its label has no positives and no rows, and a
negative positive score has an empty window. Ties go to the smaller id. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelens.llm.common import small_batches, staged, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
SCALE = 256
LARGEST = 1 << 24
#: Segments of a vector, from the coarse to the fine; each divides the next.
SEGMENTS = (4, 16, 32)
PART_ROWS, ANCHOR_ROWS = 32_768, 4_096
#: Anchors that are searched together.
_STRIP = 16
_SUMMARY = "vec_id long, label int, size int, vector binary, means binary, deviations binary"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vector: 32-bit components, padded with zeros to whole segments; means and deviations of all levels, one after another."""
    for batch in batches:
        vectors, means, deviations = [], [], []
        for x in batch.column(2).to_pylist():
            own = np.zeros(max(1, -(-len(x) // SEGMENTS[-1])) * SEGMENTS[-1])
            own[: len(x)] = x
            cut = [own.reshape(k, -1) for k in SEGMENTS]
            mean = [c.mean(axis=1) for c in cut]
            rest = np.concatenate([np.sqrt(((c - m[:, None]) ** 2).sum(axis=1)) for c, m in zip(cut, mean, strict=True)])
            vectors.append(own.astype("<i4").tobytes())
            means.append(np.concatenate(mean).astype("<f8").tobytes())
            deviations.append(np.nextafter(rest.astype("<f4"), np.float32(np.inf)).tobytes())  # rounded up, so that bounds hold
        columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int32()), *(pa.array(c, pa.binary()) for c in (vectors, means, deviations))]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "size", "vector", "means", "deviations"])


def summaries(rows: DataFrame) -> DataFrame:
    """Scaled vectors with their segment summaries, from rows (vec_id, embedding, label); see the module for what is left out."""
    small_batches(rows.sparkSession)
    x = F.transform("embedding", lambda v: v.cast("double") * SCALE)
    usable = rows.filter("vec_id is not null and label is not null and embedding is not null").filter(F.forall(x, lambda v: F.coalesce((v > -LARGEST) & (v < LARGEST), F.lit(False))))
    scaled = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform(x, lambda v: F.floor(v).cast("int")).alias("vector"))
    single = scaled.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")
    return single.mapInArrow(_summarise, _SUMMARY)


class _Side:
    """Rows of one side of a cell as matrices, sorted by id."""

    def __init__(self, rows: pa.Table):
        ids = np.array(rows.column("vec_id").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        self.order, self.ids = order, ids[order]
        self.labels = np.array(rows.column("label").to_pylist(), np.int64)[order]
        n = len(ids)
        read = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(n, -1)[order]
        self.vectors = read("vector", "<i4").astype(np.float64)
        self.means, self.deviations = read("means", "<f8"), read("deviations", "<f4").astype(np.float64)
        self.most = float(np.abs(self.vectors).max(initial=0.0))


def _exact(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers; in floats where all sums are whole numbers there."""
    if most * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _narrowed(anchors: _Side, some: slice, rows: _Side, may: np.ndarray, still: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns (rows) that no level of bounds rules out for some of the anchors, which anchors they are open for, and scores.

    may: which pairs count at all. still(low, high, open): the pairs that are open yet, given all their bounds.
    """
    length = rows.vectors.shape[1]
    columns = np.arange(len(rows.ids))
    open_ = may
    at = 0
    low = np.full(may.shape, -np.inf)
    high = np.full(may.shape, np.inf)
    for k in SEGMENTS:
        part = slice(at, at + k)
        at += k
        middle = (length // k) * (anchors.means[some, part] @ rows.means[columns, part].T)
        width = anchors.deviations[some, part] @ rows.deviations[columns, part].T
        width += 1e-9 * (np.abs(middle) + width) + 1e-6  # the sums' own rounding
        low, high = np.maximum(low, middle - width), np.minimum(high, middle + width)
        open_ = still(low, high, open_)
        kept = np.flatnonzero(open_.any(axis=0))
        columns, open_, low, high = columns[kept], open_[:, kept], low[:, kept], high[:, kept]
    return columns, open_, _exact(anchors.vectors[some], rows.vectors[columns], anchors.most * rows.most)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, largest first, then by id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each line, or -inf."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _sides(cell: pa.Table) -> tuple[_Side, _Side, list] | None:
    asks = np.array(cell.column("asks").to_pylist(), bool)
    if asks.all() or not asks.any():
        return None
    anchors = cell.filter(pa.array(asks))
    side = _Side(anchors)
    scores = anchors.column("scores").to_pylist()
    return side, _Side(cell.filter(pa.array(~asks))), [scores[i] for i in side.order]


def _positives(k: int):
    def run(cell: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if sides := _sides(cell):
            anchors, rows, _ = sides

            def still(low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> np.ndarray:
                return open_ & (high >= _kth(np.where(open_, low, -np.inf), k)[:, None])

            for at in range(0, len(anchors.ids), _STRIP):
                some = slice(at, at + _STRIP)
                columns, open_, scores = _narrowed(anchors, some, rows, rows.ids[None, :] != anchors.ids[some, None], still)
                for i, anchor in enumerate(anchors.ids[some].tolist()):
                    own = np.flatnonzero(open_[i])
                    ids, found = rows.ids[columns[own]], scores[i, own]
                    out += [(anchor, int(ids[p]), int(found[p])) for p in _first(found, ids, k)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [(), (), ()])], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, lowest: int, highest: int):
    def run(cell: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if sides := _sides(cell):
            anchors, rows, scores_of = sides
            for at in range(0, len(anchors.ids), _STRIP):
                some = slice(at, at + _STRIP)
                wanted = [sorted({s for s in scores if s >= 0}) for scores in scores_of[some]]
                # Windows of each anchor, side by side; a window that isn't there holds nothing.
                bounds = np.full((max(map(len, wanted), default=0), 2, len(wanted)), np.nan)
                for i, own in enumerate(wanted):
                    for w, s in enumerate(own):
                        bounds[w, :, i] = -(-lowest * s // 100), highest * s // 100
                bounds = bounds[:, :, :, None]

                def still(low: np.ndarray, high: np.ndarray, open_: np.ndarray, bounds: np.ndarray = bounds) -> np.ndarray:
                    left = np.zeros_like(open_)
                    for least, most in bounds:
                        sure = open_ & (low >= least) & (high <= most)
                        left |= (high >= np.fmax(least, _kth(np.where(sure, low, -np.inf), k)[:, None])) & (low <= most)
                    return open_ & left

                columns, open_, scores = _narrowed(anchors, some, rows, rows.labels[None, :] != anchors.labels[some, None], still)
                for i, anchor in enumerate(anchors.ids[some].tolist()):
                    own = np.flatnonzero(open_[i])
                    ids, found = rows.ids[columns[own]], scores[i, own]
                    for s in wanted[i]:
                        inside = np.flatnonzero((100 * found >= lowest * s) & (100 * found <= highest * s))
                        out += [(anchor, s, int(ids[inside[p]]), int(found[inside[p]])) for p in _first(found[inside], ids[inside], k)]
        names = ["anchor_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)], names=names)

    return run


def _cells(rows: DataFrame, anchors: DataFrame, at: list[str], part_rows: int, anchor_rows: int) -> DataFrame:
    """Both sides, dealt so that every anchor meets every row with the same values in `at` in exactly one cell."""
    sizes = rows.groupBy(*at).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    turns = anchors.groupBy(*at).agg(F.ceil(F.count("*") / anchor_rows).cast("int").alias("turns"))
    dealt = staged(sizes.join(turns, at), "negatives-cells")
    own: Callable[[str], Column] = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every: Callable[[str], Column] = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = [*dict.fromkeys([*at, "vec_id", "label", "vector", "means", "deviations", "scores"])]
    held = rows.withColumn("scores", F.lit(None).cast("array<long>")).join(dealt, at)
    held = held.select(own("parts").alias("part"), every("turns").alias("turn"), F.lit(False).alias("asks"), *kept)
    asked = anchors.join(dealt, at).select(every("parts").alias("part"), own("turns").alias("turn"), F.lit(True).alias("asks"), *kept)
    return held.unionByName(asked)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
    part_rows: int = PART_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (vec_id, embedding, label).

    is_anchor: a condition on vec_id. A negative's score lies from lowest to highest hundredths of the positive's.
    """
    stored = staged(summaries(rows), "negatives-summaries")
    anchors = stored.filter(is_anchor)
    asked = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    cells = _cells(stored, asked, ["size", "label"], part_rows, anchor_rows).groupBy("size", "label", "part", "turn")
    found = cells.applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = staged(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).drop("place"), "negatives-positives")

    scores = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores"))  # `positives` at most
    cells = _cells(stored, anchors.join(scores, "vec_id"), ["size"], part_rows, anchor_rows).groupBy("size", "part", "turn")
    found = cells.applyInArrow(_negatives(negatives, lowest, highest), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return chosen.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id's label moves on, so that labels aren't those that the vectors were made for."""
    return rows.withColumn("label", F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.expr("vec_id % 100 = 0"))


ORACLE = """
WITH d AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM d a JOIN d b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), negatives AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
