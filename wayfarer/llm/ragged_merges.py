"""Byte-pair merging of many short sequences at once, held as one ragged array.

In each round every unfinished sequence applies its lowest-rank pair (the leftmost of equals), all at
the same time; only pairs next to a merge are looked up again. Sequences that are too long for rounds
are merged one by one with a heap, with the same result.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 192
_NONE = np.int64(1) << np.int64(62)
_POS_BITS = np.int64(10)
_POS_MASK = (np.int64(1) << _POS_BITS) - 1


class Merges:
    """Pairs of symbols with rank and result, in an open-addressing table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray) -> None:
        self.keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.rank, self.result = rank.astype(np.int64), result.astype(np.int64)
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(left), dtype=np.int32), self._slot(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, or -1."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.slots[at[todo]]
            found = out[todo]
            todo = todo[(found >= 0) & (self.keys[found] != keys[todo])]
        return out

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        return np.where(pairs >= 0, self.rank[pairs], _NONE >> _POS_BITS)


def merge_long(symbols: list[int], table: Merges) -> list[int]:
    """The same merges of one sequence, with a heap of (rank, position)."""
    sym: list[int | None] = list(symbols)
    after, before = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
    pairs = table.find(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)).tolist()
    heap = [(int(table.rank[p]), i, p) for i, p in enumerate(pairs) if p >= 0]
    heapq.heapify(heap)

    def push(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            p = int(table.find(np.array([sym[i]], np.int64), np.array([sym[after[i]]], np.int64))[0])
            if p >= 0:
                heapq.heappush(heap, (int(table.rank[p]), i, p))

    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i]
        if sym[i] is None or j < 0 or (sym[i] << 32 | sym[j]) != int(table.keys[p]):
            continue
        sym[i], sym[j] = int(table.result[p]), None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(before[i])
        push(i)
    return [s for s in sym if s is not None]


def merge(symbols: np.ndarray, lengths: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merges sequences of ``lengths`` >= 1 symbols laid end to end; returns survivors and new lengths, in order."""
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        return _with_long(symbols, lengths, table, long)
    n = len(lengths)
    out_len = np.zeros(n, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    who = np.arange(n)
    sym, lens = symbols.astype(np.int64), lengths.astype(np.int64)
    starts = np.cumsum(lens) - lens
    pair = np.full(len(sym), -1, np.int32)
    if len(sym) > 1:
        pair[:-1] = table.find(sym[:-1], sym[1:])
    pair[starts + lens - 1] = -1
    rank = table.ranks(pair)
    while len(who):
        local = np.arange(len(sym)) - np.repeat(starts, lens)
        low = np.minimum.reduceat((rank << _POS_BITS) | local, starts)
        alive = low < (_NONE - _POS_MASK)
        if not alive.all():
            kept = np.repeat(alive, lens)
            out_len[who[~alive]] = lens[~alive]
            done.append((np.repeat(who[~alive], lens[~alive]), sym[~kept]))
            sym, pair, rank, who, lens, low = sym[kept], pair[kept], rank[kept], who[alive], lens[alive], low[alive]
            starts = np.cumsum(lens) - lens
            if not len(who):
                break
        at = starts + (low & _POS_MASK)
        sym[at] = table.result[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        at -= np.arange(len(at))  # each merge before it took one symbol away
        sym, pair, rank = sym[keep], pair[keep], rank[keep]
        lens = lens - 1
        starts = np.cumsum(lens) - lens
        ends = starts + lens - 1
        for i in (at, at - 1):
            has = (i >= starts) & (i < ends)
            j = i[has]
            pair[j] = table.find(sym[j], sym[j + 1])
            rank[j] = table.ranks(pair[j])
        last = at == ends
        pair[at[last]] = -1
        rank[at[last]] = _NONE >> _POS_BITS
    if not done:
        return sym, out_len
    owner = np.concatenate([o for o, _ in done])
    return np.concatenate([s for _, s in done])[np.argsort(owner, kind="stable")], out_len


def _with_long(symbols: np.ndarray, lengths: np.ndarray, table: Merges, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(lengths) - lengths
    is_long = np.zeros(len(lengths), bool)
    is_long[long] = True
    short_sym, short_len = merge(symbols[~np.repeat(is_long, lengths)], lengths[~is_long], table) if not is_long.all() else (symbols[:0], lengths[:0])
    merged = {i: merge_long(symbols[starts[i] : starts[i] + lengths[i]].tolist(), table) for i in long.tolist()}
    parts, at, k = [], 0, 0
    out_len = np.zeros(len(lengths), np.int64)
    for i, isl in enumerate(is_long.tolist()):
        if isl:
            parts.append(np.array(merged[i], np.int64))
            out_len[i] = len(merged[i])
        else:
            out_len[i] = short_len[k]
            parts.append(short_sym[at : at + short_len[k]])
            at, k = at + int(short_len[k]), k + 1
    return np.concatenate(parts), out_len
