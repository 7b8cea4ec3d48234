"""Token counts: pieces are counted once for each distinct pre-token and joined to per-document frequencies.

1. A task reduces each document to the frequencies of its pre-tokens and numbers the pre-tokens of a block of documents.
   A block's pre-tokens go out in buckets by their hash, a row for each bucket.
2. A bucket gathers all blocks' pre-tokens of its hash: each distinct one is tokenized once, and the counts go back to the
   blocks that have it. A frequent pre-token stands there once for each block, not for each document.
3. A block's counts meet its documents' frequencies, which are summed. Ids are never made.

Blocks end after BLOCK_PIECES pre-tokens or BLOCK_BYTES of text, and there is a bucket for each BUCKET_CHARS of the table,
so neither grows with it.

Defined results: null and empty texts have 0 bytes and tokens; a special string in a text counts as one token; repeated
rows are counted each for itself; texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelens.llm.common import BATCH_ROWS, small_batches, staged, table
from quakelens.llm.pretokens import SPECIAL, chunks, pre_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BLOCK_PIECES, BLOCK_BYTES = 600_000, 64 << 20
BUCKET_CHARS = 8 << 20
LIMIT = 512
_SEEN = "block long, doc_id long, n_bytes long, special long, frequencies binary, bucket int, places binary, words binary"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _parts(text: str) -> tuple[Counter, int]:
    """Frequencies of the text's chunks (a pre-token or a few that stand together), and its special strings."""
    segments = text.split(SPECIAL) if SPECIAL in text else [text]
    firsts, found = [], Counter()
    for segment in segments:
        first, *rest = chunks(segment)
        firsts.append(first)
        found.update(rest)
    whole = Counter({" " + chunk: times for chunk, times in found.items()})
    whole.update(filter(None, firsts))  # a segment's first chunk has no space in front
    return whole, len(segments) - 1


def _counted(path: str):
    """A bucket's rows of words with the tokens of each; every distinct word is tokenized once."""

    def run(bucket: pa.Table) -> pa.Table:
        own = tokenizer(path)
        rows = [_words(w) for w in bucket.column("words").to_pylist()]
        tokens = {w: 0 for words in rows for w in words}
        for w in tokens:
            tokens[w] = len(own.encode(w, add_special_tokens=False).ids)
        counts = pa.array([np.array([tokens[w] for w in words], "<u4").tobytes() for words in rows], pa.binary())
        return pa.table([bucket.column("block"), bucket.column("places"), counts], names=["of", "places", "tokens"])

    return run


def _packed(*parts: bytes) -> bytes:
    """Byte strings in one, compressed: these are what is written and shuffled."""
    return zstandard.compress(b"".join([len(p).to_bytes(8, "little") for p in parts] + list(parts)), 3)


def _unpacked(packed: bytes, n: int) -> list[bytes]:
    whole = zstandard.decompress(packed)
    ends = [8 * n]
    for i in range(n):
        ends.append(ends[-1] + int.from_bytes(whole[8 * i : 8 * i + 8], "little"))
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _words(packed: bytes) -> list[str]:
    lengths, data = _unpacked(packed, 2)
    ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
    return [data[a:b].decode("utf-8") for a, b in zip([0, *ends], ends, strict=False)]


class _Block:
    """Numbers of a block's pre-tokens, and which of them a chunk consists of."""

    def __init__(self) -> None:
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def frequencies(self, text: str) -> tuple[bytes, int]:
        """The numbers of a text's pre-tokens and how often each comes, and its special strings.

        Numbers stand in order as steps, their bytes by significance, which packs well; one may come more than once."""
        found, special = _parts(text)
        numbers: list[int] = []
        times: list[int] = []
        for chunk, n in found.items():
            own = self.chunks.get(chunk)
            if own is None:
                own = self.chunks[chunk] = tuple([self.pieces.setdefault(p, len(self.pieces)) for p in pre_tokens(chunk)])
            numbers += own
            times += [n] * len(own)
        own, often = np.array(numbers, "<u4"), np.array(times, "<u4")
        order = np.argsort(own, kind="stable")
        steps = np.diff(own[order], prepend=np.uint32(0)).astype("<u4")
        return _packed(*(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in (steps, often[order]))), special


def _seen(buckets: int, block_pieces: int, block_bytes: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    names = ["block", "doc_id", "n_bytes", "special", "frequencies", "bucket", "places", "words"]

    def emitted(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 31, _Block()

        def vocabulary() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, tuple[list[int], list[bytes]]] = {}
            for word, place in sorted((w.encode("utf-8"), place) for w, place in block.pieces.items()):
                places, words = dealt.setdefault(zlib.crc32(word) % buckets, ([], []))
                places.append(place)
                words.append(word)
            rows = [
                (number, *[None] * 4, bucket, np.array(places, "<u4").tobytes(), _packed(np.array([len(w) for w in words], "<u4").tobytes(), b"".join(words)))
                for bucket, (places, words) in dealt.items()
            ]
            for i in range(0, len(rows), BATCH_ROWS):
                yield emitted(rows[i : i + BATCH_ROWS])

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len((text or "").encode("utf-8"))
                own, special = block.frequencies(text or "")
                rows.append((number, doc, size, special, own, None, None, None))
                block.size += size
                if len(block.pieces) >= block_pieces or block.size >= block_bytes:
                    yield emitted(rows)
                    yield from vocabulary()
                    rows, number, block = [], number + 1, _Block()
            if rows:
                yield emitted(rows)
        if block.pieces:
            yield from vocabulary()

    return run


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    places = np.frombuffer(b"".join(counts.column("places").to_pylist()), "<u4")
    tokens = np.zeros(int(places.max(initial=0)) + 1, np.int64)
    tokens[places] = np.frombuffer(b"".join(counts.column("tokens").to_pylist()), "<u4")
    sums = []
    for packed, special in zip(docs.column("frequencies").to_pylist(), docs.column("special").to_pylist(), strict=True):
        steps, times = (np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for x in _unpacked(packed, 2))
        sums.append(int(tokens[np.cumsum(steps)] @ times) + special)
    return pa.table([docs.column("doc_id"), docs.column("n_bytes"), pa.array(sums, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def frequencies(docs: DataFrame, block_pieces: int = BLOCK_PIECES, block_bytes: int = BLOCK_BYTES, bucket_chars: int = BUCKET_CHARS) -> tuple[DataFrame, DataFrame]:
    """Each document's pre-token frequencies (block, doc_id, ...) and the blocks' pre-tokens (bucket, block, places, words)."""
    small_batches(docs.sparkSession)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_seen(max(1, -(-chars // bucket_chars)), block_pieces, block_bytes), _SEEN)
    seen = staged(seen, "pre-tokens", compression="zstd")
    return seen.filter("bucket is null").select("block", "doc_id", "n_bytes", "special", "frequencies"), seen.filter("bucket is not null").select("bucket", "block", "places", "words")


def counted(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The tokens of each block's pre-tokens (of: the block, places, tokens); each distinct one is tokenized once."""
    return words.groupBy("bucket").applyInArrow(_counted(path), "of long, places binary, tokens binary")


def count_tokens(
    docs: DataFrame, path: str = VOCABULARY, limit: int = LIMIT, block_pieces: int = BLOCK_PIECES, block_bytes: int = BLOCK_BYTES, bucket_chars: int = BUCKET_CHARS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text, ...)."""
    documents, words = frequencies(docs, block_pieces, block_bytes, bucket_chars)
    found = documents.groupBy("block").cogroup(counted(words, path).groupBy("of")).applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
