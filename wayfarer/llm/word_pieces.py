"""Subword ids of single words from a byte-level vocabulary, many words at a time.

Words are joined by spaces and cut together: no word holds a space, and the vocabulary's pattern puts every space in
front of what follows, so the ids of a word are those from one that begins with a space up to the next such one.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken

_made: dict[str, WordPieces] = {}


class WordPieces:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for raw, i in ranks.items() if raw.startswith(b" ")]] = True

    @classmethod
    def of(cls, path: str) -> WordPieces:
        """One per Python worker."""
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def cut(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``n`` words of ``joined``, which single spaces part, one after another, and how many each has."""
        if not n:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        ids = np.array(self.encoding.encode_ordinary(" " + joined), np.uint16)
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) != n:  # white space beyond ASCII has joined two words
            each = [self.encoding.encode_ordinary(" " + w) for w in joined.split(" ")]
            return np.array([i for e in each for i in e], np.uint16), np.array([len(e) for e in each], np.int64)
        return ids, np.diff(begin, append=len(ids))
