"""Byte-level helpers shared by the text operators: views of Arrow strings, words, hashes.

They run inside Arrow tasks on slices of a megabyte of whole texts. A longer text is a slice of its own,
whose words are hashed piece by piece, so its scratch memory stays that of a piece and some eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that end a word: space and the ASCII controls 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of alphanumeric words; every byte of a multi-byte character belongs to a word.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets) for runs of rows of about ``limit`` bytes.

    Null texts count as empty. A longer text makes a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every maximal run of ``in_word`` bytes; no run crosses two rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = in_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    after[edges] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES + 1)
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial modulo 2**64; equal bytes hash equal."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _long_word_hash(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """``span_hashes`` of one span of any length, a piece at a time."""
    total, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    up = _power_tables(SLICE_BYTES + 1)[0]
    for at in range(start, end, SLICE_BYTES):
        piece = data[at : min(end, at + SLICE_BYTES)].astype(np.uint64) + np.uint64(1)
        total += factor * (piece * up[: len(piece)]).sum(dtype=np.uint64)
        factor = factor * up[SLICE_BYTES]
    return mix64(total + np.uint64(end - start))


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a slice, letters A-Z lowered, and the first word of each row, with the end behind."""
    if len(data) <= 2 * SLICE_BYTES:
        low = lower_ascii(data)
        starts, ends, row = word_spans(low, offsets, in_word)
        return span_hashes(low, starts, ends), np.searchsorted(row, np.arange(len(offsets)))
    # One long text: pieces end at bytes that belong to no word; a word longer than a piece is hashed alone.
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + SLICE_BYTES)
        if to < len(data):
            outside = np.flatnonzero(~in_word[data[at:to]])
            if len(outside):
                to = at + int(outside[-1]) + 1
            else:
                end = to
                while end < len(data) and len(outside) == 0:
                    outside = np.flatnonzero(~in_word[data[end : end + SLICE_BYTES]])
                    end = end + int(outside[0]) if len(outside) else min(len(data), end + SLICE_BYTES)
                parts.append(_long_word_hash(lower_ascii(data[at:end]), 0, end - at))
                at = end
                continue
        low = lower_ascii(data[at:to])
        starts, ends, _ = word_spans(low, np.array([0, to - at]), in_word)
        parts.append(span_hashes(low, starts, ends))
        at = to
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hashes for given words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return span_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends)


def take_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, glued: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans end to end and where each begins, with the end behind; a space follows spans that are ``glued``."""
    sizes = ends - starts if glued is None else ends - starts + glued
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    place = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
    if glued is None:
        return data[place], at
    out = data[np.minimum(place, len(data) - 1)] if len(data) else data
    out[at[1:][glued] - 1] = 32
    return out, at


def strings(data: np.ndarray, at: np.ndarray) -> pa.StringArray:
    """An Arrow array of the texts that begin at ``at``."""
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    return strings(*take_spans(data, starts, ends))


def runs(data: np.ndarray, apart: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end behind a byte of ``apart``; where none comes for longer, the range goes on."""
    at = 0
    while at < len(data):
        to = min(len(data), at + limit)
        if to < len(data):
            found = np.flatnonzero(apart[data[at:to]])
            if len(found):
                to = at + int(found[-1]) + 1
            while not len(found) and to < len(data):
                found = np.flatnonzero(apart[data[to : to + limit]])
                to = to + int(found[0]) + 1 if len(found) else min(len(data), to + limit)
        yield at, to
        at = to
