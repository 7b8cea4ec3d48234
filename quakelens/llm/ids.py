"""Token ids of whole texts under a byte-level vocabulary file, at the speed of a compiled encoder.

The pattern that cuts pre-tokens looks ahead after white space and so keeps a place for each of its characters; long runs
of white space are therefore cut off first. A run is one pre-token, without its last character unless the text ends there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

from quakelens.llm.bpe import byte_letters
from quakelens.llm.pretokens import SPECIAL, SPECIAL_ID

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: White space of this many characters is cut off before the pattern sees it.
LONG_RUN = 2_000
_RUN = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in enumerate(byte_letters())}
    ids = model["vocab"]
    merged = [ids["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
    if merged != sorted(merged) or any(ids[c] > merged[0] for c in back):
        raise ValueError(f"the ids in {path} are no merge ranks")
    return {bytes(back[c] for c in word): i for word, i in ids.items() if word != SPECIAL}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under a byte-level vocabulary file; its ids must follow the order of its merges, as ranks."""
    import tiktoken

    own = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={SPECIAL: SPECIAL_ID})

    def with_runs(segment: str) -> list[np.ndarray]:
        parts, at = [], 0
        for run in _RUN.finditer(segment):
            end = run.end() if run.end() == len(segment) else run.end() - 1
            parts += [own.encode_to_numpy(segment[at : run.start()]), np.array(own._encode_single_piece(segment[run.start() : end].encode("utf-8")), np.uint32)]
            at = end
        return [*parts, own.encode_to_numpy(segment[at:])]

    def encode(text: str) -> np.ndarray:
        if not _RUN.search(text):
            return own.encode_to_numpy(text, allowed_special="all")
        parts: list[np.ndarray] = []
        for i, segment in enumerate(text.split(SPECIAL)):
            parts += ([np.array([SPECIAL_ID], np.uint32)] if i else []) + with_runs(segment)
        return np.concatenate(parts)

    return encode
