"""Ids of whole texts from a vocabulary that drops white space: looked up stretch by stretch.

No token of such a vocabulary crosses white space, so a text's ids are the ids of its white-space
stretches, one after another. Words repeat much; each is tokenized once and kept. A plain word with
punctuation behind it is taken apart; every other stretch goes through the whole tokenizer.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

#: Stretches kept by one Python worker; about 200 bytes each.
CACHED = 250_000

#: Letters that normalisation only lower-cases, then punctuation that makes one pre-token.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([^A-Za-z0-9\\s'<|>\x80-\U0010ffff]*)")


#: Separators that Python takes for white space and the vocabulary's pattern doesn't.
_NO_SPACES = "\x1c\x1d\x1e\x1f"
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")


def byte_letters() -> dict[int, str]:
    """Code point of a byte-level vocabulary for each byte: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = [byte_letters()[b] for b in range(256)]
_made: dict[str, WordIds] = {}


class _Words(dict):
    """Lower-case word of plain letters to its ids as 32-bit little-endian bytes."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.model = tokenizer.model

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join([_LETTERS[b] for b in word.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(self) >= CACHED:
            self.clear()
        self[word] = ids
        return ids


class _Stretches(dict):
    """White-space stretch to its ids."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.words = tokenizer, _Words(tokenizer)

    def __missing__(self, stretch: str) -> bytes:
        plain = _PLAIN.fullmatch(stretch) if len(stretch) <= 64 else None
        if plain:
            ids = self.words[plain[1].lower()]
            if plain[2]:
                ids += self[plain[2]]
        else:
            ids = array("I", self.tokenizer.encode(stretch, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHED:
            self.clear()
        if len(stretch) <= 64:
            self[stretch] = ids
        return ids


class WordIds:
    def __init__(self, path: str) -> None:
        self.cache = _Stretches(Tokenizer.from_file(path))

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One per Python worker, so tasks share what they have looked up."""
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def forget(self) -> None:
        """Gives the memory of what was looked up back to the worker, for whatever task comes next."""
        self.cache.words.clear()
        self.cache.clear()

    def ids(self, text: str) -> bytes:
        odd = any(c in text for c in _NO_SPACES)
        return b"".join(map(self.cache.__getitem__, _SPACES.split(text) if odd else text.split()))
