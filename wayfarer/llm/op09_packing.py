"""Packing documents into training sequences, online and in bounded space.

Each partition keeps a fixed number of open windows. A document longer than a window fills whole
sequences first; its remainder goes to the open window that it fits best. When none fits, the fullest
window is emitted: as it is if its gap is small, else filled to the brim with the head of the
arriving piece. Windows that are still open at the end of a partition are merged in groups of
partitions and cut anew, their last one into lengths that are powers of two, which need no padding.

Defined cases: a null or empty text has the end id alone; repeated rows are packed one by one; a text
of any length is cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .word_ids import WordIds

WINDOW = 2048
OPEN_WINDOWS = 64
#: A window with at most this gap is emitted as it is.
SMALL_GAP = 16
#: Partitions whose open windows are merged by one task.
MERGED = 64
VOCAB = "word_bpe_49k.json"
END_ID = 1

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.binary())])

#: A piece: (doc_id, start, ids as little-endian bytes, tokens of the document).
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Open windows of one partition; ``place`` yields the sequences that are finished."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, small_gap: int = SMALL_GAP) -> None:
        self.window, self.most, self.small = window, open_windows, small_gap
        self.open: list[list[Piece]] = []
        self.free: list[int] = []

    def place(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            yield [(doc_id, at, ids[4 * at : 4 * (at + self.window)], total)]
            at += self.window
        while at < total:
            size = total - at
            fits = [(gap - size, i) for i, gap in enumerate(self.free) if gap >= size]
            if fits:
                self._add(min(fits)[1], (doc_id, at, ids[4 * at :], total))
                at = total
            elif len(self.open) < self.most:
                self.open.append([])
                self.free.append(self.window)
                continue
            else:
                i = min(range(len(self.free)), key=self.free.__getitem__)
                if self.free[i] > self.small:
                    cut = at + self.free[i]
                    self._add(i, (doc_id, at, ids[4 * at : 4 * cut], total))
                    at = cut
                yield self._take(i)
                continue
            full = [i for i, gap in enumerate(self.free) if gap == 0]
            for i in reversed(full):
                yield self._take(i)

    def _add(self, i: int, piece: Piece) -> None:
        self.open[i].append(piece)
        self.free[i] -= len(piece[2]) // 4

    def _take(self, i: int) -> list[Piece]:
        self.free.pop(i)
        return self.open.pop(i)

    def rest(self) -> list[list[Piece]]:
        return [w for w in self.open if w]


def merged(pieces: list[Piece], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Cuts pieces into full windows; what is left at the end into lengths that are powers of two."""
    left = sum(len(p[2]) // 4 for p in pieces)
    want, now, has = 0, [], 0
    for doc_id, start, ids, total in pieces:
        at, size = 0, len(ids) // 4
        while at < size:
            if not now:
                want = window if left >= window else 1 << (left.bit_length() - 1)
            take = min(size - at, want - has)
            now.append((doc_id, start + at, ids[4 * at : 4 * (at + take)], total))
            at, has, left = at + take, has + take, left - take
            if has == want:
                yield now
                now, has = [], 0


def _rows(sequences: Iterator[tuple[int, list[Piece]]], left: bool = False) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(8)]
    for sequence_id, pieces in sequences:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for c, v in zip(cols, (doc_id, start, n, zlib.crc32(ids), total, sequence_id, offset, ids if left else None), strict=True):
                c.append(v)
            offset += n
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def pack(docs: DataFrame, vocab_path: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece of ``docs(doc_id, text, ...)``: where it starts in its document and in its sequence."""
    path = vocab_path or public_tokenizers.path(VOCAB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordIds.of(path), Packer(window, open_windows)
        part, count, done, size = TaskContext.get().partitionId(), 0, [], 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                ids = words.ids(texts[row].as_py() or "") + end
                for pieces in packer.place(doc_ids[row].as_py(), ids):
                    done.append(((part << 33) + 2 * count, pieces))
                    count += 1
                    size += len(pieces)
                if size >= 20_000:
                    yield _rows(iter(done))
                    done, size = [], 0
        words.forget()
        yield _rows(iter(done))
        yield _rows(((part << 33, w) for w in packer.rest()), left=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, pieces = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            pieces += [(r["doc_id"], r["start"], r["left"], r["doc_tokens"]) for r in batch.to_pylist()]
        done = []
        for sequence in merged(pieces, window):
            done.append(((part << 33) + 2 * count + 1, sequence))
            count += 1
        yield _rows(iter(done))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = tables.stored(rows.mapInArrow(run, f"{_PIECE}, left binary"))
    names = [c.split()[0] for c in _PIECE.split(", ")]
    rest = placed.where("left IS NOT NULL")
    parts = rest.agg(F.max(F.shiftright("sequence_id", 33))).first()[0]
    # At most OPEN_WINDOWS windows come from a partition, and MERGED partitions meet in a task.
    groups = 1 if parts is None else int(parts) // MERGED + 1
    again = rest.repartition(groups, F.expr(f"sequence_id DIV {(1 << 33) * MERGED}")).sortWithinPartitions("sequence_id", "doc_id", "start")
    return placed.where("left IS NULL").select(names).unionByName(again.mapInArrow(merge, f"{_PIECE}, left binary").select(names))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(tables.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
