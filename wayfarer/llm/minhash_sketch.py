"""Word shingles, b-bit MinHash signatures and band keys of document texts, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import textbytes as tb


@dataclass(frozen=True)
class MinHashParams:
    """``bands * rows`` minima; their low ``bits`` bits are packed into the signature.

    ``slack`` is how far below the threshold an estimate may lie before its pair is discarded, in
    standard deviations of the estimator at the threshold.
    """

    words: int = 5
    threshold: float = 0.8
    bands: int = 38
    rows: int = 5
    bits: int = 4
    seed: int = 20240229
    slack: float = 6.0

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        t, c = self.threshold, 2.0**-self.bits
        seen = t + (1 - t) * c  # expected share of equal packed minima
        return t - self.slack * (seen * (1 - seen) / self.hashes) ** 0.5 / (1 - c)


def constants(p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 1 << 32, p.hashes, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, p.hashes, dtype=np.uint32)
    return a, b


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its shingles of ``words`` consecutive words.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    h, first = tb.word_hashes(data, offsets, ~tb.SPACES)
    n = len(offsets) - 1
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = tb.mix64(rolled * np.uint64(3) + h[k : k + len(rolled)])
    out = []
    for i in range(n):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            x = np.zeros(1, np.uint64)
            for k in range(lo, hi):
                x = tb.mix64(x * np.uint64(3) + h[k : k + 1])
            out.append(tb.mix64(x + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set, as 32-bit integers."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        block = x[None, at : at + 512] * a[:, None]
        block += b[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return low


def _finish32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def packed(low: np.ndarray, bits: int) -> bytes:
    """Low ``bits`` bits of every (mixed) minimum: all lowest bits first, then all second ones, and so on."""
    kept = _finish32(low)
    planes = np.zeros((bits, -(-len(low) // 64) * 64), np.uint8)
    for k in range(bits):
        planes[k, : len(low)] = (kept >> np.uint32(k)) & np.uint32(1)
    return np.packbits(planes, axis=1).tobytes()


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    m = low.reshape(bands, rows).astype(np.uint64)
    for k in range(rows):
        keys = tb.mix64(keys + m[:, k])
    return keys.view(np.int64)


def estimates(left: np.ndarray, right: np.ndarray, p: MinHashParams) -> np.ndarray:
    """Collision-corrected similarity of signatures (rows of packed bytes), by bit counts.

    Words of 64 minima are combined by exclusive or, one for each kept bit; minima differ where any bit does.
    """
    differ = (np.ascontiguousarray(left).view(np.uint64) ^ np.ascontiguousarray(right).view(np.uint64)).reshape(len(left), p.bits, -1)
    same = p.hashes - np.bitwise_count(np.bitwise_or.reduce(differ, axis=1)).sum(axis=1, dtype=np.int64)
    c = 2.0**-p.bits
    return (same / p.hashes - c) / (1 - c)
