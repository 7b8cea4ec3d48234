"""Near-duplicate documents: MinHash with banding, verified links, and connected components by alternating stars.

1. A document's set: its distinct five-word shingles (64-bit hashes). Documents with equal sets form a class, and only
   the class's smallest id goes on, so large groups of copies cost one row.
2. HASHES universal hash minima, in BANDS bands of ROWS. At the threshold of 0.75 a pair misses all bands with a chance
   of about 1e-6, and less above it.
3. A bucket's members are linked with its smallest id (never all pairs). Candidates are checked by signature (estimates
   below 0.55 go, over seven standard deviations below the threshold), then on the full sets.
4. Components of these links. Buckets that still hold several components are looked at again. Where they have at most
   CROSS pairs across components for each row, those pairs are checked. The documents of all other mixed buckets (many
   that share a passage, say) are compared by their rarest shingles, which loses nothing: of a similar pair each holds
   three quarters of the other's set, so the pair shares one of any quarter (and one more) of it. A document that met a
   component of BIG members or more in a bucket is compared with its members and with others that met it, and takes the
   shingles that the fewest of these hold, all others as one group. Shingles that a single component holds make no rows.
5. Components by alternating large-star and small-star, each round written to the shared folder.

Defined results: null and blank texts have an empty set and stand alone; with fewer than five words the whole sequence
is the one shingle; rows with a null id are never linked and are kept; repeated rows get the same values; ids should
name one text: where rows of one id differ, one of them makes the links. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelens.llm.common import carried, small_batches, staged, table

WORDS = 5
BANDS, ROWS = 50, 5
HASHES = BANDS * ROWS
SIMILAR, ESTIMATED = 0.75, 0.55
CROSS = 4
BIG = 32
_rng = np.random.default_rng(20240101)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


class _WordIds(dict):
    """64-bit hashes of words; forgets them all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_word_ids = _WordIds()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes. Only A-Z become lower case; words end at ASCII space."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_word_ids.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total += ids[i : n - size + 1 + i] * _PLACE[i]
    return np.unique(_mix(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The signature of a set that isn't empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        y = x[i : i + 1024, None] * _A
        y += _B
        np.minimum(low, y.min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    return _mix((low.reshape(BANDS, ROWS).astype(np.uint64) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


_SIGNED = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, signatures, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = shingles(text)
            sizes.append(len(own))
            if len(own):
                low = minima(own)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                signatures.append(low.astype(np.uint8).tobytes())
                bands.append(band_keys(low))
            else:
                keys.append(None)
                signatures.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "signature", "bands"],
        )


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in enough places."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
        keep = (left == right).mean(axis=1) >= ESTIMATED
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the intersection is at least three quarters of the union."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= 75 * (len(a) + len(b) - both) and both > 0


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar. Neighbouring rows often share a document; the last few sets are kept."""
    held: dict[int, np.ndarray] = {}

    def of(doc: int, text: str) -> np.ndarray:
        if doc not in held:
            while len(held) >= 16:
                held.pop(next(iter(held)))
            held[doc] = shingles(text)
        return held[doc]

    for batch in batches:
        keep = [similar(of(a, x), of(b, y)) for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are similar. known: id, n, signature and text of every document that a pair may hold."""
    sides = [known.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}")) for s in "ab"]
    texts = [known.select(F.col("id").alias(s), F.col("text").alias(f"t_{s}")) for s in "ab"]
    near = pairs.join(sides[0], "a").join(sides[1], "b").filter(100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b"))
    near = staged(near.select("a", "b", "s_a", "s_b").mapInArrow(_estimate, "a long, b long"), f"{name}-near")
    return staged(near.join(texts[0], "a").join(texts[1], "b").select("a", "b", "t_a", "t_b").mapInArrow(_confirm, "a long, b long"), f"{name}-links")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("u", "m")).distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """id and component (its smallest id) of every id in the edges (a, b), by alternating large-star and small-star."""
    edges = edges.filter("a is not null and b is not null and a <> b")
    print_ = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = None
    while True:
        edges = staged(_small_star(_large_star(edges)), name)
        now = tuple(edges.agg(print_.alias("p")).first()["p"])
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Of labelled rows (key, id, component): the keys with several components, the largest one, rows and pairs across."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    across = (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2
    return parts.groupBy("key").agg(F.sum("c").alias("members"), across.alias("across"), F.max(F.struct("c", "component"))["component"].alias("largest")).filter("across > 0")


def _across(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in the buckets of small (key, largest).

    Only members outside a bucket's largest component are joined with all of it, so the rows made are about the pairs
    across components, however many members the largest one has.
    """
    open_ = rows.join(small, "key")
    outside = open_.filter("component <> largest").select("key", F.col("id").alias("x"), F.col("component").alias("c_x"))
    pairs = outside.join(open_.select("key", F.col("id").alias("y"), F.col("component").alias("c_y")), "key").filter("c_x <> c_y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each document: h, what precedes the text, and the number of shingles."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for i, text in enumerate(texts):
            own = shingles(text)
            k = len(own)
            given = [pa.array(np.full(k, batch.column(c)[i].as_py())) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *given, pa.array(np.full(k, k))], names=["h", *batch.schema.names[:-1], "n"])


def _rare_pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of documents of one group and different components that share one of the first one's rarest shingles there.

    held: id, component, text. groups: id, against, asks. Pairs are sought for the rows that ask. A similar document holds
    at least three quarters of the asking one's shingles, and so one of any quarter and one more; those that the fewest in
    the group hold are taken. A document with a quarter of its shingles to itself makes no pair at all. Given both sizes,
    a similar pair has 3/7 of their sum in common, so that the other lacks fewer still and fewer need be looked at.
    """
    rows = groups.join(held, "id").select("against", "asks", "id", "component", "text")
    rows = staged(rows.mapInArrow(_shingle_rows, "h long, against long, asks boolean, id long, component long, n long"), "near-shingles")
    at = ["against", "h"]
    # What the asking ones hold, with the number of others that hold it.
    counts = rows.groupBy(*at).agg(F.count("*").alias("holders"), F.max("asks").alias("asked"), F.min("component").alias("low"), F.max("component").alias("high")).filter("asked")
    # A shingle that only one component holds makes no pair.
    rare = F.when(F.col("low") < F.col("high"), F.col("holders") - 1).otherwise(0)
    counts = staged(counts.select(*at, rare.alias("others")), "near-counts")
    order = Window.partitionBy("against", "id").orderBy("others", "h")
    prefix = rows.filter("asks").join(counts, at).withColumn("place", F.row_number().over(order)).filter("others > 0 and place <= n - ceil(0.75 * n) + 1")
    a = prefix.select(*at, F.col("id").alias("a"), F.col("component").alias("c_a"), F.col("n").alias("n_a"), "place")
    b = rows.select(*at, F.col("id").alias("b"), F.col("component").alias("c_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, at).filter("a <> b and c_a <> c_b and 100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b) and place <= n_a - ceil(3 * (n_a + n_b) / 7) + 1")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_table(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """id and component of every class representative that has a link. signed: _SIGNED columns of docs."""
    classes = signed.filter("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    first = signed.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    banded = first.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).filter("members > 1").drop("members")
    rows = staged(banded.join(buckets, "key"), "near-buckets")

    wanted = rows.select("id").distinct()
    marks = first.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature").join(wanted, "id", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    known = staged(marks.join(texts, "id").dropDuplicates(["id"]), "near-known")

    tested = staged(rows.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "near-tested")
    found = components(_links(tested, known, "near-first"))

    labelled = _labelled(rows.select("key", "id"), found)
    mixed = staged(_mixed(labelled), "near-mixed")
    if mixed.isEmpty():
        return found
    pairs = _across(labelled, mixed.filter(F.col("across") <= CROSS * F.col("members")).select("key", "largest"))
    large = mixed.filter(F.col("across") > CROSS * F.col("members")).select("key")
    in_large = staged(labelled.join(large, "key", "left_semi"), "near-large-rows")
    held = staged(in_large.select("id", "component").distinct().join(known.select("id", "text"), "id"), "near-large")
    if not held.isEmpty():
        sizes = staged(held.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= BIG), "near-sizes")
        big = in_large.join(sizes, "component").select("key", F.col("component").alias("against")).distinct()
        met = in_large.join(big, "key").filter("component <> against").select("id", "against").distinct()
        # Two documents of a bucket with a large component have both met it; those of all other buckets are one group.
        rest = in_large.join(big.select("key").distinct(), "key", "left_anti").select("id", F.lit(-1).cast("long").alias("against")).distinct()
        asking = met.unionByName(rest).withColumn("asks", F.lit(True))
        members = held.join(sizes, "component").select("id", F.col("component").alias("against"), F.lit(False).alias("asks"))
        pairs = pairs.union(_rare_pairs(held, staged(asking.unionByName(members), "near-groups"))).distinct()
    across = _links(staged(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs"), known, "near-across")
    # The components so far are stars already; the new links join them.
    return components(found.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(across))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    signed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign, _SIGNED), "near-signed")
    found = link_table(docs, signed)
    sized = signed.select("doc_id", "n_shingles", "set_key")
    classes = sized.filter("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    labelled = _labelled(classes, found).select("set_key", "component")
    return sized.join(labelled, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs without those near copies that don't stay, with all their columns."""

    def kept(docs: DataFrame) -> DataFrame:
        gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

    return carried(docs, ("doc_id", "text"), kept)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
