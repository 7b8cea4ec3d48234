"""Splitting texts where a byte-level BPE vocabulary never merges, so that equal pieces are encoded once.

A single space between two characters that aren't white space always starts a new pre-token, so the text between two
such spaces is encoded alone, with its space in front. Such a chunk recurs far more often than a text does.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import regex

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256  # fixed values of the vocabulary
_TWO = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LONG = 80
_SPLIT = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def chunks(text: str) -> list[str]:
    """The text's chunks; all but the first stand for themselves with a space in front."""
    return _SAFE.split(text) if _TWO.search(text) else text.split(" ")


def pre_tokens(text: str) -> list[str]:
    """The vocabulary's own pre-tokens of a text without special strings."""
    return _SPLIT.findall(text)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, from a function for lists of pre-tokens.

    What it has learned is kept for later texts: chunks, and the pre-tokens that chunks consist of. Long ones aren't
    kept, and a table that has grown too large is emptied.
    """

    def __init__(self, of: Callable[[list[str]], list[bytes]], chunk_limit: int = 400_000, piece_limit: int = 700_000):
        self.of, self.chunk_limit, self.piece_limit = of, chunk_limit, piece_limit
        self.chunks: dict[str, bytes] = {}  # by the chunk without its space
        self.pieces: dict[str, bytes] = {}
        self.special = SPECIAL_ID.to_bytes(4, "little")

    def of_pieces(self, split: list[list[str]]) -> list[bytes]:
        """Ids of each list of pre-tokens."""
        known = self.pieces
        if len(known) > self.piece_limit:
            known.clear()
        new = list({p for pieces in split for p in pieces if p not in known})
        if new:
            known.update(zip(new, self.of(new), strict=True))
        got = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > _LONG:
                del known[p]
        return got

    def segment(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = chunks(text)
        known = self.chunks
        if len(known) > self.chunk_limit:
            known.clear()
        new = list({c for c in rest if c not in known})
        split = [_SPLIT.findall(first), *(_SPLIT.findall(" " + c) for c in new)]
        start, *ids = self.of_pieces(split)
        known.update(zip(new, ids, strict=True))
        whole = start + b"".join(map(known.__getitem__, rest))
        for c in new:
            if len(c) > _LONG:
                del known[c]
        return whole

    def __call__(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self.segment(text)
        return self.special.join(map(self.segment, text.split(SPECIAL)))
