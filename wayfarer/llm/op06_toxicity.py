"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, everything but letters and digits becomes a space, and its distinct byte
n-grams are hashed to buckets. Buckets get the smoothed log ratio of their frequencies in toxic and
clean texts, of either sign; those whose frequencies differ by ``least_apart`` standard errors are kept,
and logistic regression is trained on the presence of a bucket times its ratio. Without that choice of
buckets the chance differences of rare ones, of which a long text has thousands, outweigh a few toxic words.

The model is fitted on a bounded sample of labelled rows: at most ``sample`` texts of each class in
hash order, of at most ``longest`` bytes each. Every text is scored whole, a piece at a time.

Defined cases: null and empty texts have no features and get the score of the intercept; unlabelled
and held-out rows teach nothing; without labelled rows of both classes every score is the share of
toxic labels (0 without labels); repeated rows score alike and teach once; equal scores need no order, as
a score of exactly 0.5 counts as toxic; clashing extra columns are ignored.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


@dataclass(frozen=True)
class ToxicityParams:
    orders: tuple[int, ...] = (4, 5, 6, 7, 8)
    bits: int = 21
    kept: int = 20_000
    least_kept: int = 300
    sample: int = 2500
    longest: int = 200_000
    least_df: int = 5
    least_apart: float = 3.0
    penalty: float = 1e-3
    rounds: int = 400
    #: Bytes of a text that are looked at together.
    piece: int = 1 << 18


_GRAM = np.uint64(0xD6E8FEB86659FD93)
_TEXT_CLASS = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _TEXT_CLASS[_b] = _b


def held_out(doc_id: Column) -> Column:
    """Rows that never teach."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


class Features:
    """Distinct buckets of texts. One scratch array tells first from later occurrences."""

    def __init__(self, p: ToxicityParams) -> None:
        self.p = p
        self.last = np.zeros(1 << p.bits, np.int32)

    def of(self, text: str) -> np.ndarray:
        raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
        size, more = self.p.piece, max(self.p.orders) - 1
        parts = [self._of_piece(raw[at : at + size + more], at + size < len(raw)) for at in range(0, len(raw), size)]
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))

    def _of_piece(self, raw: np.ndarray, goes_on: bool) -> np.ndarray:
        """Buckets of the n-grams that start in a piece, which holds the bytes that its last ones need."""
        x = _TEXT_CLASS[raw].astype(np.uint64)
        shift = np.uint64(64 - self.p.bits)
        parts = []
        for n in self.p.orders:
            m = self.p.piece if goes_on and len(x) >= self.p.piece + n - 1 else len(x) - n + 1
            if m > 0:
                packed = np.full(m, n, np.uint64)
                for k in range(n):
                    packed = (packed << np.uint64(8)) | x[k : k + m]
                parts.append(((packed * _GRAM) >> shift).astype(np.int32))
        if not parts:
            return np.zeros(0, np.int32)
        buckets = np.concatenate(parts)
        order = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = order
        return buckets[self.last[buckets] == order]


@dataclass
class ToxicityModel:
    """Weight of each bucket (zero where it isn't kept) and intercept."""

    params: ToxicityParams
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.params.bits, np.float64)
        out[self.buckets] = self.weights
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def train(texts: list[str], labels: np.ndarray, p: ToxicityParams = ToxicityParams(), toxic_share: float | None = None) -> ToxicityModel:
    """``toxic_share``: of all labelled rows, if the sample has another one."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        z = 40.0 if share == 1 else -40.0
        return ToxicityModel(p, np.zeros(0, np.int64), np.zeros(0), z)
    make, size = Features(p), 1 << p.bits
    df = np.zeros((2, size), np.int32)
    for text, label in zip(texts, y, strict=True):
        df[int(label), make.of(text)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    some = np.flatnonzero(df.sum(axis=0) >= p.least_df)
    toxic, clean = df[1, some], df[0, some]
    ratio = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    share = (toxic + clean) / len(y)
    apart = np.abs(toxic / n1 - clean / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    best = np.argsort(-apart, kind="stable")[: p.kept]
    best = best[(apart[best] > 0) & ((apart[best] >= p.least_apart) | (np.arange(len(best)) < p.least_kept))]
    best = np.sort(best)
    keep, ratio = some[best], ratio[best]
    place = np.full(size, -1, np.int32)
    place[keep] = np.arange(len(keep))
    # Texts are read again, so that their other buckets needn't be held.
    cols = []
    for text in texts:
        c = place[make.of(text)]
        cols.append(c[c >= 0])
    col = np.concatenate(cols) if cols else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    r = ratio
    share = n1 / len(y) if toxic_share is None else toxic_share
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    w, b = np.zeros(len(keep)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, p.rounds + 1):
        z = np.bincount(row, (w * r)[col], minlength=len(y)) + b
        g = (_sigmoid(z) - y) * weight
        gw = np.bincount(col, g[row], minlength=len(w)) * r + p.penalty * w / len(w)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.05 / (1 + t / 100)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return ToxicityModel(p, keep.astype(np.int64), w * r, float(b))


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Trains on the bounded sample of ``labels(doc_id, toxic)`` that ``held_out`` leaves."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(p.sample).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(p.sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(f"octet_length(text) <= {p.longest}")
    # One text of an id, the smallest, so that at most 2 * sample rows arrive whatever repeats.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), p, share)


def score(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1); every other column as it is."""
    p, spark = model.params, docs.sparkSession
    shared = spark.sparkContext.broadcast((model.buckets, model.weights, model.intercept))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, weights, intercept = shared.value
        table, make = ToxicityModel(p, buckets, weights, intercept).table(), Features(p)
        for texts in batches:
            z = np.array([table[make.of(t or "")].sum() for t in texts.tolist()], np.float64) + intercept
            yield pd.Series(_sigmoid(z))

    return docs.withColumn(name, toxicity(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a model of the labelled ones."""
    docs = tables.read(spark, sf_dir, "documents")
    model = fit(docs, tables.read(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
