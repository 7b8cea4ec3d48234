"""Quality scores from pairwise preferences (Bradley-Terry), with a threshold at a quantile of the scores.

A document's features are shape statistics of its whole text. Each labelled good document is preferred to labelled bad
ones; weights are learned by logistic loss on feature differences. The threshold is the score quantile at the share of
bad labels among the training rows, and scores are placed so that the threshold is at 0.7.

Every labelled row that is not held out (crc32(doc_id) mod 4 is 2) is trained on. Up to SMALL_ROWS of them are fitted by
one process on drawn pairs, so many that each row is drawn. More are dealt into blocks of about BLOCK_ROWS rows of the more
frequent label; in a block each good row is preferred to each bad one, and a Newton step sums the blocks' gradients and
Hessians in Spark. A rare label's rows go to several blocks, so that no block lacks them. The threshold is the exact
quantile over all training rows. The driver holds sums and counts only.

Defined results: null texts count as empty and get a score like any other; labels of unknown documents, null labels and
null ids are ignored; of contradicting labels for one document the lower counts; with no label, or labels of one kind
only, every weight is 0 and every score is 0.7 (nothing is rejected). Labels, lang, source and ids are no features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quakelens.llm.common import carried, small_batches, staged, table

SMALL_ROWS, BLOCK_ROWS, LEAST_RARE = 2_000, 256, 32
PAIRS = 60_000
THRESHOLD = 0.7
_OWN = "__quality_"
FEATURES = [
    "log_chars", "upper", "digit", "symbol", "bar", "stop", "comma", "distinct", "repeat", "top", "word_length", "long_words",
    "shouted", "marked", "line_repeat", "log_line",
]
_KINDS = np.zeros((256, 6), dtype=np.float32)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b"*#$%&!@^~=<>_", b"|", b".")):
    _KINDS[list(_chars), _i] = 1


def features(text: str) -> list[float]:
    """Shape statistics of one text; shares are of letters or words."""
    data = text.encode("utf-8")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float32)
    upper, lower, digit, symbol, bar, stop = (counts @ _KINDS).tolist()
    other = float(counts[195:].sum())  # letters outside ASCII, by their first bytes
    words = data.split()
    n = max(1, len(words))
    # Counting all words of a very long text costs little: one dictionary of its distinct words.
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeat = sum(a == b for a, b in zip(words, words[1:], strict=False))
    top = max(seen.values(), default=0)
    shouted = sum(k for w, k in seen.items() if len(w) > 1 and w.isupper())
    marked = sum(k for w, k in seen.items() if w[-1:] in b"*#$%&!|")
    wide = sum(k for w, k in seen.items() if len(w) > 14)
    lines = [x for x in data.split(b"\n") if x]
    letters = max(1.0, upper + lower + other)
    return [
        np.log1p(len(data)), upper / letters, digit / letters, symbol / letters, bar / n, stop / n, counts[44] / n, len(seen) / n ** 0.8, repeat / n, top / n,
        letters / n / 10, wide / n, shouted / n, marked / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(data) / max(1, len(lines))),
    ]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table_ = np.array([features(t or "") for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in table_.T.copy())], names=["doc_id", *FEATURES])


def feature_table(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Weights over standardised features, and the raw score that stands at the threshold."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, at: float):
        self.mean, self.scale, self.weights, self.at = mean, scale, weights, at

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _basis((x - self.mean) / self.scale) @ self.weights

    def column(self, prefix: str = "") -> Column:
        """The score as a Spark expression over the feature columns."""
        return F.lit(1.0) / (1.0 + F.exp(-(self.above(prefix) + float(np.log(THRESHOLD / (1 - THRESHOLD))))))

    def above(self, prefix: str = "") -> Column:
        """How far the raw score stands above the threshold, as a Spark expression."""
        z = [F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(prefix + f) - float(m)) / float(s))) for f, m, s in zip(FEATURES, self.mean, self.scale, strict=True)]
        total = F.lit(float(-self.at))
        for v, w in zip([*z, *(x * x for x in z)], self.weights, strict=True):
            total = total + v * float(w)
        return total


def _basis(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z])


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Bradley-Terry weights by Newton steps on the logistic loss of good-minus-bad differences, with a ridge."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    width = 2 * len(FEATURES)
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return Model(mean, scale, np.zeros(width), 0.0)
    rng = np.random.default_rng(seed)
    b = _basis((x - mean) / scale)
    d = b[rng.choice(better, pairs)] - b[rng.choice(worse, pairs)]
    w = np.zeros(width)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # the chance of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-3 * np.eye(width), d.T @ p / pairs - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0)
    model.at = float(np.quantile(model.raw(x), (good == 0).mean()))
    return model


def _packed(mean: np.ndarray, scale: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """A block's rows as two matrices in one row."""

    def run(block: pa.Table) -> pa.Table:
        x = np.column_stack([block.column(f).to_numpy() for f in FEATURES])
        z, good = np.clip((x - mean) / scale, -6, 6), block.column("quality").to_numpy()
        return pa.table({"better": pa.array([z[good == 1].tobytes()], pa.binary()), "worse": pa.array([z[good == 0].tobytes()], pa.binary())})

    return run


def _pair_sums(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gradient, Hessian and number of all pairs of the blocks of a partition, one after another by position."""
    width = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, hessian, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            for first, second in zip(batch.column(0), batch.column(1), strict=True):
                better, worse = (_basis(np.frombuffer(c.as_buffer(), np.float64).reshape(-1, len(FEATURES))) for c in (first, second))
                low = worse @ weights
                for at in range(0, len(better), BLOCK_ROWS):
                    some = better[at : at + BLOCK_ROWS]
                    p = 1 / (1 + np.exp(np.clip((some @ weights)[:, None] - low, -40, 40)))  # the chance of the wrong order
                    q = p * (1 - p)
                    gradient += p.sum(1) @ some - p.sum(0) @ worse
                    cross = some.T @ q @ worse
                    hessian += (some * q.sum(1)[:, None]).T @ some + (worse * q.sum(0)[:, None]).T @ worse - cross - cross.T
                n += len(better) * len(worse)
        values = np.concatenate([gradient, hessian.ravel(), [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["position", "value"])

    return run


def _ranked(values: DataFrame, rank: int, bins: int = 1024, few: int = 1000) -> float:
    """The value of a rank (from 0) in a column `raw`, exactly: counts by bins, then by bins of the bin that holds it."""
    low, high = values.agg(F.min("raw"), F.max("raw")).first()
    while low < high:
        number = F.least(F.floor((F.col("raw") - low) / (high - low) * bins), F.lit(bins - 1))
        inside = values.filter(F.col("raw").between(low, high))
        for found in inside.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).orderBy("bin").collect():
            if rank < found.n:
                break
            rank -= found.n
        low, high = found.low, found.high
        if found.n <= few:
            return sorted(r.raw for r in values.filter(F.col("raw").between(low, high)).collect())[rank]
    return low


def _rounded(values: np.ndarray, digits: int = 9) -> np.ndarray:
    """So that the order in which Spark adds does not show."""
    return np.array([float(f"{v:.{digits}g}") for v in values])


def fit_blocks(labelled: DataFrame, n_good: int, n_bad: int, n: int) -> Model:
    """Bradley-Terry weights as in `fit`, from every row of a written table (doc_id, features, quality)."""
    moments = labelled.agg(*(f(c) for f in (F.avg, F.stddev_pop) for c in FEATURES)).first()
    mean, scale = _rounded(moments[: len(FEATURES)]), _rounded(moments[len(FEATURES) :]) + 1e-6
    width = 2 * len(FEATURES)
    if not n_good or not n_bad:
        return Model(mean, scale, np.zeros(width), 0.0)
    blocks = -(-max(n_good, n_bad) // BLOCK_ROWS)
    rare, copies = int(n_good < n_bad), min(blocks, -(-LEAST_RARE * blocks // min(n_good, n_bad)))
    first = F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(blocks))
    turns = F.sequence(F.lit(0), F.when(F.col("quality") == rare, F.lit(copies - 1)).otherwise(F.lit(0)))
    dealt = labelled.filter("quality in (0, 1)").withColumn("block", F.explode(F.transform(turns, lambda i: F.pmod(first + i * (blocks // copies), F.lit(blocks)))))
    small_batches(labelled.sparkSession)
    packed = staged(dealt.groupBy("block").applyInArrow(_packed(mean, scale), "better binary, worse binary"), "quality-blocks")
    w = np.zeros(width)
    for _ in range(25):
        sums = packed.mapInArrow(_pair_sums(w), "position int, value double").groupBy("position").agg(F.sum("value")).orderBy("position").collect()
        values = np.array([r[1] for r in sums])
        gradient, hessian, pairs = values[:width], values[width:-1].reshape(width, width), values[-1]
        step = np.linalg.solve(hessian / pairs + 1e-3 * np.eye(width), gradient / pairs - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    model = Model(mean, scale, np.round(w, 6), 0.0)
    raw = staged(labelled.select(model.above().alias("raw")), "quality-raw")
    at = n_bad / n * (n - 1)
    low = _ranked(raw, int(at))
    model.at = low + (_ranked(raw, min(int(at) + 1, n - 1)) - low) * (at - int(at))
    return model


def train(shapes: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled, not held-out rows of a feature table."""
    marks = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = staged(shapes.join(marks, "doc_id"), "quality-labelled")
    n_good, n_bad, n = labelled.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0), F.count("*")).first()
    if n > SMALL_ROWS:
        return fit_blocks(labelled, n_good, n_bad, n)
    rows = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).select(*FEATURES, "quality").collect()
    got = np.array([tuple(r) for r in rows], dtype=np.float64).reshape(-1, len(FEATURES) + 1)
    return fit(got[:, :-1], got[:, -1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    shapes = staged(feature_table(docs), "quality")
    model = train(shapes, labels)
    return shapes.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns. The text is read once more, never shuffled."""
    return carried(docs, ("doc_id", "text"), lambda plain: _accepted(plain, labels))


def _accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    shapes = staged(feature_table(docs), "quality")
    model = train(shapes, labels)

    def with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = np.array([features(t or "") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in got.T.copy())], names=[*batch.schema.names, *(_OWN + f for f in FEATURES)])

    schema = StructType(list(docs.schema) + [StructField(_OWN + f, DoubleType()) for f in FEATURES])
    # The same expression decides here as in score.
    return docs.mapInArrow(with_features, schema).filter(model.column(_OWN) >= THRESHOLD).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
