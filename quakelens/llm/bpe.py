"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols form a linked list. The tree's leaf i holds the rank of the pair that starts at symbol i, and its
root the leftmost lowest rank. A merge changes three leaves, each in logarithmic time, until no mergeable pair is left.

Defined results: null and empty texts have no ids; the vocabulary's special string in a text is its special id, as the
library has it; texts of any length are encoded whole; repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelens.llm.common import small_batches, table
from quakelens.llm.pretokens import SPECIAL, SPECIAL_ID, Encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], byte_letters()
        self.of_byte = [ids[c] for c in letters]
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(back[c] for c in word) for word, i in ids.items()} | {SPECIAL_ID: SPECIAL.encode()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = rank, ids[left + right]
        self.encode = Encoder(self.pre_tokens)

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids of one pre-token, given its bytes' ids."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        # A node holds rank * size + place, so that the least is the leftmost of the lowest rank.
        tree = [_NEVER] * (2 * size)
        for i in range(n - 1):
            pair = merges.get((symbols[i], symbols[i + 1]))
            if pair:
                tree[size + i] = pair[0] * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] != _NEVER:
            i = tree[1] % size
            j = following[i]
            symbols[i] = merges[symbols[i], symbols[j]][1]
            symbols[j] = -1
            after = following[j]
            following[i] = after
            if after < n:
                before[after] = i
            for place in (j, i, before[i]):
                if place < 0 or place >= n - 1:
                    continue
                second = following[place]
                pair = merges.get((symbols[place], symbols[second])) if place != j and second < n else None
                k = size + place
                value = pair[0] * size + place if pair else _NEVER
                if tree[k] == value:
                    continue
                tree[k] = value
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    low = a if a < b else b
                    if tree[k] == low:
                        break
                    tree[k] = low
                    k >>= 1
        return [s for s in symbols if s >= 0]

    def pre_tokens(self, pieces: list[str]) -> list[bytes]:
        return [np.array(self.merge([self.of_byte[b] for b in p.encode("utf-8")]), dtype="<u4").tobytes() for p in pieces]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = [own.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            ids = [np.frombuffer(own.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every row of docs (doc_id, text, ...)."""
    return _texts(docs).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of every row of coded (doc_id, ids)."""
    small_batches(coded.sparkSession)
    return coded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Counts and digests of each text's ids and of what they decode to, in one pass."""
    return _texts(docs).mapInArrow(_coded(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
