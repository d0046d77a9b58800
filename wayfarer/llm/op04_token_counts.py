"""Token counts of whole texts with a byte-level vocabulary, by rank-synchronous array merging.

A text is cut where a single space stands between two visible characters: no pre-token crosses such a
place. The counts of these stretches are kept; those of new stretches come from their pre-tokens, all
of a slice at once, as ragged arrays of symbols (see ``ragged_merges``). A text with other white-space
runs is cut into pre-tokens as a whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as
one token each, as the library has it; repeated rows count alike; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from . import textbytes as tb
from .ragged_merges import Merges, merge
from .word_ids import byte_letters

VOCAB = "byte_bpe_50k.json"
LIMIT = 512
#: Stretches and pre-tokens that one Python worker keeps, about 150 bytes each, and characters in all of them.
CACHED, CACHED_CHARS = 500_000, 32_000_000

#: The vocabulary's pre-token pattern; white space is the Unicode property.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_EDGE = regex.compile(r"\A\p{White_Space}|\p{White_Space}\Z|\A\Z")

_made: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges])
        self.table = Merges(left, right, np.arange(len(merges)), np.array([vocab[a + b] for a, b in merges]))
        self.byte_id = np.array([vocab[byte_letters()[b]] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pretokens: dict[str, int] = {}
        self.stretches: dict[str, int | None] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def _learn(self, words: set[str]) -> None:
        """Counts of new pre-tokens: byte symbols end to end, merged together."""
        words = [w for w in words if w not in self.pretokens]
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        symbols = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        _, counts = merge(symbols, np.array([len(b) for b in raw], np.int64), self.table)
        self.pretokens.update(zip(words, counts.tolist(), strict=True))
        self.held += sum(map(len, words))

    def _whole(self, text: str) -> int:
        found = PRETOKEN.findall(text)
        self._learn(set(found))
        return sum(map(self.pretokens.__getitem__, found))

    def _stretch(self, new: set[str]) -> None:
        parts = {s: None if _EDGE.search(s) else PRETOKEN.findall(" " + s) for s in new}
        self._learn({w for p in parts.values() if p for w in p})
        self.held += sum(map(len, new))
        for s, p in parts.items():
            self.stretches[s] = None if p is None else sum(map(self.pretokens.__getitem__, p))

    def counts(self, texts: list[str]) -> list[int]:
        if max(len(self.stretches), len(self.pretokens)) > CACHED or self.held > CACHED_CHARS:
            self.stretches.clear()
            self.pretokens.clear()
            self.held = 0
        cut, known, out = [], self.stretches, []
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            cut.append([p.split(" ") for p in parts])
        new: set[str] = set()
        for parts in cut:
            for pieces in parts:
                new.update(pieces[1:])
        self._stretch(new.difference(known))
        heads = {pieces[0] for parts in cut for pieces in parts}
        heads = {h: PRETOKEN.findall(h) for h in heads}
        self._learn({w for p in heads.values() for w in p})
        for parts in cut:
            total = len(parts) - 1
            for pieces in parts:
                try:
                    total += sum(map(known.__getitem__, pieces[1:])) + sum(map(self.pretokens.__getitem__, heads[pieces[0]]))
                except TypeError:  # a stretch begins or ends with white space
                    total += self._whole(" ".join(pieces))
            out.append(total)
        return out


def token_counts(docs: DataFrame, vocab_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs(doc_id, text, ...)``."""
    path = vocab_path or public_tokenizers.path(VOCAB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for at, to, _, offsets in tb.slices(texts):
                n = counter.counts(texts.slice(at, to - at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(tables.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
