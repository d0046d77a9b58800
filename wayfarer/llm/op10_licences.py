"""Licence scans with a generalised suffix automaton of licence words.

The automaton is built from the words of short licence notices. A text's words are streamed through it
and give matching statistics: for each word the length of the longest run ending there that occurs in
some notice, and the notices that hold it. Matches that cannot be extended are chained, notice by
notice, into covered spans; a notice whose words are covered enough gives its label. Base phrases
are found as runs of consecutive words as well, whatever the chains say.

Words that no notice knows reset the automaton, so only runs of known words are streamed; they are
found by hashing all words of a slice at once.

Defined cases: a null or empty text has no words, empty labels and score 0; texts of any length are
streamed whole; repeated rows give the same; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from . import textbytes as tb

#: Base phrases and their labels.
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: Notices by label, short forms in general use.
NOTICES: dict[str, list[str]] = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "lgpl": ["licensed under the gnu lesser general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}

#: A match of fewer words than this is no evidence; a notice needs this share of its words covered.
LEAST_MATCH = 3
COVERED = 0.75
#: Matches of one notice chain if no more words than this lie between them.
CHAIN_GAP = 4

_CHUNK = 1 << 20
#: Words of a run that are streamed at a time.
_PIECE = 4096


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; every state knows the notices that hold its runs."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owners = [-1], [0], [set()]
        for owner, words in enumerate(sequences):
            last = 0
            for w in words:
                last = self._extend(last, w)
                self.owners[last].add(owner)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.owners[self.link[state]] |= self.owners[state]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(set())
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.owners[copy] = set()
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def matches(self, words: list[int] | np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Matching statistics: (state, longest match ending at the word, word position) per word, streamed: the state goes on from
        one piece of words to the next."""
        state, size = 0, 0
        for at in range(0, len(words), _PIECE):
            for i, w in enumerate(np.asarray(words[at : at + _PIECE]).tolist(), at):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if w in self.next[state]:
                    state, size = self.next[state][w], size + 1
                yield state, size, i


class Scanner:
    """Finds base phrases and notices in slices of text."""

    def __init__(self, notices: dict[str, list[str]], base: dict[tuple[str, ...], str]) -> None:
        self.labels = [label for label, texts in notices.items() for _ in texts]
        words = [t.split() for texts in notices.values() for t in texts]
        vocab = sorted({w for ws in words for w in ws} | {w for p in base for w in p})
        hashes = tb.hash_words([w.encode() for w in vocab])
        order = np.argsort(hashes)
        self.hashes, self.word_of = hashes[order], order.astype(np.int32)
        number = {w: i for i, w in enumerate(vocab)}
        self.sizes = [len(ws) for ws in words]
        self.automaton = SuffixAutomaton([[number[w] for w in ws] for ws in words])
        self.base = [([number[w] for w in p], label) for p, label in base.items()]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word in the vocabulary (-1: none) and the first word of each row, with the end behind."""
        h, first = tb.word_hashes(data, offsets, tb.ALNUM)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.word_of[at], -1), first

    def base_places(self, words: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Start of each place of each base phrase; no place crosses two rows."""
        row_end = np.repeat(first[1:], np.diff(first))
        out = []
        for phrase, label in self.base:
            n = len(words) - len(phrase) + 1
            if n <= 0:
                out.append((np.zeros(0, np.int64), label))
                continue
            hit = row_end[:n] >= np.arange(n) + len(phrase)
            for k, w in enumerate(phrase):
                hit &= words[k : k + n] == w
            out.append((np.flatnonzero(hit), label))
        return out

    def notices_in(self, words: np.ndarray) -> dict[str, tuple[float, int, int]]:
        """Labels whose notice is covered, with the share covered and the span of the best chain."""
        known = words >= 0
        edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
        runs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        chains: dict[int, tuple[int, int, int]] = {}  # notice -> (start, end, words covered)
        best: dict[str, tuple[float, int, int]] = {}
        long = runs[1] - runs[0] >= LEAST_MATCH
        for lo, hi in zip(runs[0][long].tolist(), runs[1][long].tolist(), strict=True):
            # A match counts where the next word doesn't make it longer.
            for (state, size, i), (_, longer, _) in pairwise(chain(self.automaton.matches(words[lo:hi]), [(0, 0, 0)])):
                if size < LEAST_MATCH or longer == size + 1:
                    continue
                start, end = lo + i + 1 - size, lo + i + 1
                for notice in self.automaton.owners[state]:
                    held = chains.get(notice)
                    if held and start - held[1] <= CHAIN_GAP:
                        fresh = max(0, end - max(start, held[1]))
                        held = (held[0], max(end, held[1]), held[2] + fresh)
                    else:
                        held = (start, end, size)
                    chains[notice] = held
                    share = min(1.0, held[2] / self.sizes[notice])
                    label = self.labels[notice]
                    if share >= COVERED and share > best.get(label, (0.0, 0, 0))[0]:
                        best[label] = (share, held[0], held[1])
        return best


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None, base: dict[tuple[str, ...], str] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: words, base places, labels, score and chained spans."""
    scanner = Scanner(notices or NOTICES, base or BASE)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in tb.slices(batch.column(1), _CHUNK):
                words, first = scanner.words(data, offsets)
                n = to - at
                count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
                base_labels: list[set[str]] = [set() for _ in range(n)]
                for places, label in scanner.base_places(words, first):
                    row = np.searchsorted(first, places, "right") - 1
                    np.add.at(count, row, 1)
                    np.minimum.at(low, row, places - first[row])
                    np.maximum.at(high, row, places - first[row])
                    for r in np.unique(row).tolist():
                        base_labels[r].add(label)
                labels, scores, spans = [], [], []
                for r in range(n):
                    found = scanner.notices_in(words[first[r] : first[r + 1]])
                    labels.append(",".join(sorted(base_labels[r] | set(found))))
                    scores.append(max([s for s, _, _ in found.values()] + [1.0] * bool(base_labels[r]) + [0.0]))
                    spans.append([f"{label}:{a}-{b}" for label, (_, a, b) in sorted(found.items())])
                none = count == 0
                cols = [batch.column(0).slice(at, n), np.diff(first), count, pa.array(low, mask=none), pa.array(high, mask=none), [",".join(sorted(x)) for x in base_labels], labels, scores, spans]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence words and notices in all documents."""
    return scan(tables.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_licences": op10_licences}
SQL: dict[str, str] = {}
