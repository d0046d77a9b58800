"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation walks the compiled character map of the model (a double-array trie) by longest prefix
and records, for every byte it writes, the byte of the text that it comes from. The normalised text is
cut before each run of word marks; no piece crosses such a place, so every segment is merged by itself
(many at once, see ``ragged_merges``) and kept for later texts. Each piece is then projected through
the alignment to its span of bytes in the text. Decoding joins pieces and byte pieces.

Defined cases: a null or empty text has the begin and end ids alone, with empty spans; characters
outside the vocabulary become byte pieces, each with the span of its byte; repeated rows are encoded
alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from . import tables
from . import textbytes as tb
from .ragged_merges import Merges, merge

MODEL = "piece_bpe_32k.model"
#: Segments that one Python worker keeps, about 300 bytes each, and characters in all of them.
CACHED, CACHED_CHARS = 400_000, 16_000_000
MARK = "▁"

#: Begins the kept form of a segment that isn't a mark and unmarked characters; no text has this code point.
_OWN = "\ud800"
_NORMAL, _BYTE = 1, 6
_made: dict[str, Pieces] = {}


class CharMap:
    """The compiled character map: trie units, then zero-terminated replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``data[at:]`` in the map and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


class Pieces:
    """A model's pieces, merges and normalisation."""

    def __init__(self, path: str) -> None:
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self._load(proto)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def _load(self, proto: model_pb2.ModelProto) -> None:
        spec = proto.normalizer_spec
        self.chars = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.byte_id = np.zeros(256, np.int64)
        self.raw: list[bytes] = []
        is_byte = set()
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                is_byte.add(i)
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.raw.append(p.piece.encode() if p.type == _NORMAL else b"")
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        # Single characters that only occur inside pieces get symbols of their own; -1 never merges.
        self.symbol = {c: i for c, i in normal.items() if len(c) == 1}
        self.known = len(self.raw)
        for piece in normal:
            for c in piece:
                self.symbol.setdefault(c, self.known + len(self.symbol))
        left, right, result = [], [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = (normal.get(x) if len(x) > 1 else self.symbol[x] for x in (piece[:k], piece[k:]))
                if a is not None and b is not None:
                    left.append(a), right.append(b), result.append(i)
        scores = np.array([proto.pieces[i].score for i in result])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.table = Merges(np.array(left), np.array(right), rank, np.array(result))
        self.symbol_of = np.full(0x110000, 1 << 31, np.int64)
        for c, i in self.symbol.items():
            self.symbol_of[ord(c)] = i
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.shown = [r if i in is_byte else r.replace(MARK.encode(), b" ") for i, r in enumerate(self.raw)]
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.held = 0

    # -- normalisation -------------------------------------------------------------------------

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and the source byte of each of its UTF-8 bytes, with the source's length behind."""
        raw = text.encode()
        if not self.chars.units and not self.squeeze:
            return self._plain(text, raw)
        out, source, at = bytearray(), [], 0
        while at < len(raw):
            found = self.chars.longest(raw, at)
            if found:
                size, new = found
            else:
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                new = raw[at : at + size]
            for i, byte in enumerate(new):
                if byte == 32 and self.squeeze and (not out or out[-1] == 32):
                    continue
                out.append(byte)
                source.append(at + (i if not found else 0))
            at += size
        if self.squeeze:
            while out and out[-1] == 32:
                out.pop()
                source.pop()
        if not out:
            return "", np.zeros(1, np.int64) + len(raw)
        if self.prefix:
            out.insert(0, 32)
            source.insert(0, source[0])
        where = np.array(source, np.int64)
        data = np.frombuffer(bytes(out), np.uint8)
        if self.escape:
            where = np.repeat(where, np.where(data == 32, 3, 1))
            return bytes(out).decode().replace(" ", MARK), np.append(where, len(raw))
        return bytes(out).decode(), np.append(where, len(raw))

    def _plain(self, text: str, raw: bytes) -> tuple[str, np.ndarray]:
        """Without a character map only spaces change."""
        if not raw:
            return "", np.zeros(1, np.int64)
        spaced = b" " + raw if self.prefix else raw
        where = np.arange(len(spaced)) - (1 if self.prefix else 0)
        where[0] = 0
        data = np.frombuffer(spaced, np.uint8)
        where = np.repeat(where, np.where(data == 32, 3, 1)) if self.escape else where
        text = spaced.decode()
        return (text.replace(" ", MARK) if self.escape else text), np.append(where, len(raw))

    # -- encoding ------------------------------------------------------------------------------

    def _segments_of(self, text: str) -> list[str]:
        """Segments that concatenate to the normalised text."""
        if not self.chars.units and not self.squeeze and self.prefix and self.escape and text and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        norm = self.normalize(text)[0]
        # A leading mark is understood in the kept form; other segments carry a sign of their own.
        return [s[1:] if s[0] == MARK and MARK not in s[1:] and len(s) > 1 else _OWN + s for s in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", norm)]

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        self.held += sum(map(len, new))
        full = [s[1:] if s[:1] == _OWN else MARK + s for s in new]
        symbols = self.symbol_of[np.frombuffer("".join(full).encode("utf-32-le"), np.uint32)]
        merged, counts = merge(symbols, np.array([len(s) for s in full], np.int64), self.table)
        packed, merged, at, shown = merged.astype("<u4").tobytes(), merged.tolist(), 0, self.shown
        for name, seg, n in zip(new, full, counts.tolist(), strict=True):
            own = merged[at : at + n]
            if max(own) < self.known:
                ids = packed[4 * at : 4 * (at + n)]
            else:
                own = self._bytes_for_strangers(own, seg)
                ids = array("I", own).tobytes()
            at += n
            self.ids[name], self.texts[name] = ids, b"".join([shown[i] for i in own])

    def _bytes_for_strangers(self, symbols: list[int], segment: str) -> list[int]:
        ids, char = [], 0
        for sym in symbols:
            if sym < self.known:
                ids.append(sym)
                char += len(self.raw[sym].decode())
            else:
                ids += [int(self.byte_id[b]) for b in segment[char].encode()]
                char += 1
        return ids

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Segments of each text, all of them known afterwards."""
        if len(self.ids) > CACHED or self.held > CACHED_CHARS:
            self.ids.clear()
            self.texts.clear()
            self.held = 0
        parts = [self._segments_of(t) for t in texts]
        new: set[str] = set()
        for p in parts:
            new.update(p)
        self._learn(list(new.difference(self.ids)))
        return parts

    def encode(self, segments: list[str]) -> bytes:
        """Ids with begin and end, as little-endian 32-bit integers."""
        return array("I", [self.begin]).tobytes() + b"".join(map(self.ids.__getitem__, segments)) + array("I", [self.end]).tobytes()

    def spans(self, text: str, segments: list[str]) -> np.ndarray:
        """Start and end byte in ``text`` of each piece, begin and end pieces included."""
        sizes = self.size[np.frombuffer(b"".join(map(self.ids.__getitem__, segments)), np.uint32)]
        where = self.normalize(text)[1]
        ends = np.cumsum(sizes)
        total = len(text.encode())
        span = np.stack([where[ends - sizes], where[ends]], axis=1) if len(sizes) else np.zeros((0, 2), np.int64)
        return np.concatenate([[[0, 0]], span, [[total, total]]]).astype(np.int64)

    def decode(self, segments: list[str]) -> bytes:
        """Text of the pieces: the first mark stands for the dummy prefix and goes."""
        out = b"".join(map(self.texts.__getitem__, segments))
        return out[1:] if self.prefix and out[:1] == b" " else out


def encode_documents(docs: DataFrame, model_path: str | None = None, with_spans: bool = True, with_text: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids binary, starts, ends, decoded, ids_sha256, decoded_sha256, n_spans, spans_sha256)`` of each document.

    ids are little-endian 32-bit integers; the digest of spans is of all starts, then all ends, as little-endian
    64-bit integers. Every piece is projected; lists of spans, ids and the decoded text are null unless asked for.
    """
    path = model_path or public_tokenizers.path(MODEL)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_spans", pa.int64()), ("spans_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for at, to, _, _ in tb.slices(texts):
                rows = texts.slice(at, to - at).to_pylist()
                cols: list[list] = [[] for _ in range(9)]
                for text, segments in zip(rows, pieces.prepare(rows), strict=True):
                    ids, decoded = pieces.encode(segments), pieces.decode(segments)
                    span = pieces.spans(text, segments)
                    row = (len(ids) // 4, ids if with_text else None, span[:, 0] if with_spans else None, span[:, 1] if with_spans else None, decoded.decode(errors="replace") if with_text else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(span), hashlib.sha256(span.astype("<i8").tobytes("F")).hexdigest())
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, starts array<long>, ends array<long>, decoded string, ids_sha256 string, decoded_sha256 string, n_spans long, spans_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with begin and end ids, each piece with its span of bytes, and decoded again."""
    out = encode_documents(tables.read(spark, sf_dir, "documents"), with_spans=False, with_text=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_spans", "spans_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_sentencepiece": op3_sentencepiece}
SQL: dict[str, str] = {}
