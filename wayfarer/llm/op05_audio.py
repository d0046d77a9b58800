"""Media columns: texts stored as 8-bit sound, and audio features of what is read back.

A text's bytes, filled up with bytes 255 to a positive multiple of 576, become the samples of a mono
8-bit WAVE file. The file is parsed again; its samples are resampled with a polyphase filter, cut into
overlapping frames and turned into log-mel energies. Frames whose energy rises over the upper
threshold open a segment, which lasts until the energy falls below the lower one (hysteresis). The
log-mel frames are stored as one Arrow fixed-shape tensor per window of frames, with its time span.

Defined cases: a null or empty text is a payload of 576 bytes 255; equal texts give equal values; a
text of any length is one file, its frames are made block by block; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

UNIT = 576


@dataclass(frozen=True)
class AudioParams:
    rate: int = 16_000
    #: Resampling by up / down with this many filter taps on either side per phase.
    up: int = 1
    down: int = 2
    taps: int = 8
    frame: int = 256
    hop: int = 128
    mels: int = 20
    #: Frames of one tensor.
    window: int = 32
    #: Hysteresis in standard deviations of the file's frame energy, above and below its mean.
    rise: float = 0.5
    fall: float = -0.5
    floor: float = 1e-10

    @property
    def new_rate(self) -> int:
        return self.rate * self.up // self.down


# -- stored form ---------------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wave(samples: bytes, rate: int) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def from_wave(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a mono 8-bit file, found chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit samples")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


# -- features ------------------------------------------------------------------------------------


def lowpass(p: AudioParams) -> np.ndarray:
    """Windowed sinc at the narrower of both bands, on the raised rate."""
    half = p.taps * max(p.up, p.down)
    n = np.arange(-half, half + 1)
    cut = 1.0 / max(p.up, p.down)
    return (p.up * cut * np.sinc(cut * n) * np.kaiser(len(n), 6.0)).astype(np.float32)


def resample(x: np.ndarray, p: AudioParams) -> np.ndarray:
    """Polyphase: output k takes every ``up``-th tap from the phase ``k * down % up``, no zeros are multiplied."""
    taps = lowpass(p)
    half = len(taps) // 2
    count = -(-len(x) * p.up // p.down)
    out = np.zeros(count, np.float32)
    for phase in range(p.up):
        k = np.arange(phase, count, p.up)  # outputs of one phase lie ``down`` inputs apart
        if not len(k):
            continue
        at = k[0] * p.down + half
        own = taps[at % p.up :: p.up]
        first = at // p.up
        pad = np.concatenate([np.zeros(len(own), np.float32), x, np.zeros(first + len(own) + p.down, np.float32)])
        lo = first + 1  # sample x[first - j] lies at pad[first + len(own) - j]
        span = pad[lo : lo + (len(k) - 1) * p.down + len(own)]
        rows = np.lib.stride_tricks.as_strided(span, (len(k), len(own)), (span.strides[0] * p.down, span.strides[0]))
        out[k] = rows @ own[::-1]
    return out


def mel_bank(p: AudioParams) -> np.ndarray:
    """Triangles over the frequencies of a frame's spectrum, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(p.new_rate / 2), p.mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(p.frame, 1 / p.new_rate)
    rise = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, p: AudioParams, bank: np.ndarray, taper: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x mels) and log energy of each frame. The last frame is filled with silence."""
    frames = max(1, 1 + -(-(len(y) - p.frame) // p.hop))
    pad = np.zeros((frames - 1) * p.hop + p.frame, np.float32)
    pad[: len(y)] = y[: len(pad)]
    rows = np.lib.stride_tricks.as_strided(pad, (frames, p.frame), (pad.strides[0] * p.hop, pad.strides[0]))
    mel, energy = np.empty((frames, p.mels), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, block):
        cut = rows[at : at + block] * taper
        spectrum = np.fft.rfft(cut, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at : at + block] = np.log(power @ bank.T + p.floor)
        energy[at : at + block] = np.log((cut * cut).sum(axis=1) + p.floor)
    return mel, energy


def segments(energy: np.ndarray, p: AudioParams) -> list[tuple[int, int]]:
    """Runs of frames that open at the upper threshold and close below the lower one."""
    mean, spread = float(energy.mean(dtype=np.float64)), float(energy.std(dtype=np.float64))
    mark = np.where(energy >= mean + p.rise * spread, 1, np.where(energy < mean + p.fall * spread, -1, 0)) if spread > 1e-6 else np.zeros(len(energy), int)
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def tensors(mel: np.ndarray, p: AudioParams) -> bytes:
    """Arrow stream with a fixed-shape tensor (window x mels) per row, its first and last second, and its frames."""
    count = -(-len(mel) // p.window)
    pad = np.full((count * p.window, p.mels), np.float32(np.log(p.floor)), np.float32)
    pad[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (p.window, p.mels))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(pad.reshape(-1)), p.window * p.mels)
    first = np.arange(count) * p.window
    size = np.minimum(p.window, len(mel) - first)
    table = pa.table({
        "log_mel": pa.ExtensionArray.from_storage(kind, flat),
        "start_s": first * p.hop / p.new_rate,
        "end_s": ((first + size - 1) * p.hop + p.frame) / p.new_rate,
        "frames": size,
    })
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


class Features:
    def __init__(self, p: AudioParams) -> None:
        self.p, self.bank = p, mel_bank(p)
        self.taper = np.hanning(p.frame + 1)[:-1].astype(np.float32)

    def of(self, samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]], str]:
        """Log-mel frames, segments in seconds, and a line that sums them up."""
        p = self.p
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        mel, energy = log_mel(resample(x, p), p, self.bank, self.taper)
        spans = [(a * p.hop / p.new_rate, ((b - 1) * p.hop + p.frame) / p.new_rate) for a, b in segments(energy, p)]
        mean = mel.mean(axis=0, dtype=np.float64)
        line = f"frames={len(mel)};segments={len(spans)};active={sum(b - a for a, b in spans):.3f};energy={energy.mean(dtype=np.float64):.3f};mel=" + ",".join(f"{v:.2f}" for v in mean)
        return mel, spans, line


_COLUMNS = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    "tensor_bytes": pa.int64(), "tensors_sha256": pa.string(),
    "media": pa.binary(), "tensors": pa.binary(), "segment_starts": pa.list_(pa.float64()), "segment_ends": pa.list_(pa.float64()),
}
_SQL_TYPES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.float64()): "array<double>"}
DIGEST = list(_COLUMNS)[:10]


def media_columns(docs: DataFrame, p: AudioParams = AudioParams(), columns: list[str] | None = None) -> DataFrame:
    """Stored file, tensors, segments and digests per row of ``docs(doc_id, text, ...)``, as far as asked for."""
    names = columns or list(_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {n: [] for n in names}
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    n, payload = payload_of(text.as_py())
                    media = to_wave(payload, p.rate)
                    _, back = from_wave(media)
                    mel, spans, line = features.of(back)
                    stream = tensors(mel, p)
                    row = {"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": line, "tensor_bytes": len(stream), "tensors_sha256": hashlib.sha256(stream).hexdigest(), "media": media, "tensors": stream, "segment_starts": [a for a, _ in spans], "segment_ends": [b for _, b in spans]}
                    for k, v in out.items():
                        v.append(row[k])
                yield pa.RecordBatch.from_arrays([pa.array(out[k], _COLUMNS[k]) for k in names], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, ", ".join(f"{k} {_SQL_TYPES[_COLUMNS[k]]}" for k in names))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored form, the audio features and the tensors of all documents."""
    return media_columns(tables.read(spark, sf_dir, "documents"), columns=DIGEST)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_media_columns": op5_media_columns}
SQL: dict[str, str] = {}
