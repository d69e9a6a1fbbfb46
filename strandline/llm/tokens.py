"""Token ids of a public byte-level BPE, whole texts, with a bounded cache of words."""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np

#: Words that a Python worker remembers; beyond it words are encoded each time.
CACHE = 300_000
_ODD = re.compile(r"\s\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as `tokenizers` gives them for the vocabulary file `path` (byte_bpe_50k.json, add_special_tokens=False, special strings as ordinary text).

    Where no two white-space characters meet, the pre-tokenizer never joins anything across a single space or line break, so
    a text is cut there and each piece is looked up in a cache; other texts are encoded in one go. Missing pieces are encoded
    with the ranks file beside `path`, which holds the same vocabulary and merges.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        lines = map(bytes.split, Path(path).with_suffix(".tiktoken").read_bytes().splitlines())
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: Bytes of each id.
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.lengths[list(ranks.values())] = [len(k) for k in ranks]
        encode = self.encode

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = np.array(encode(word if word[:1] == "\n" else " " + word), dtype="<u4").tobytes()
                if len(self) < CACHE and len(word) < 64:
                    self[word] = ids
                return ids

        self.words = Words()

    def ids(self, text: str | None) -> np.ndarray:
        """All ids of the text, little-endian unsigned 32-bit."""
        text = text or ""
        if _ODD.search(text):
            return np.array(self.encode(text), dtype="<u4")
        first, *rest = text.replace("\n", " \n").split(" ")
        head = np.array(self.encode(first), dtype="<u4").tobytes()
        return np.frombuffer(head + b"".join(map(self.words.__getitem__, rest)), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
