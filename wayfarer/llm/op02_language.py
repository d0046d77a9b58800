"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained on the driver from a bounded sample: ``per_language`` distinct texts of each language in
the order of their hashes, of at most ``longest`` bytes each, ``windows`` windows of each. A text is read whole, in windows of ``window`` bytes; every
position gets label probabilities, and their mean over all positions of the text is its distribution.

Defined cases: a null text and a text without any letter get ``und`` with score 0; without labelled
rows everything is ``und``; with one language that one is predicted; a text of any length is read
window by window; equal probabilities go to the first language by name; repeated rows teach once, under whatever id, and
clashing extra columns change nothing.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from . import textbytes as tb
from .byte_gru import ByteGru, train

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    per_language: int = 300
    windows: int = 6
    window: int = 64
    hidden: int = 8
    epochs: int = 6
    longest: int = 200_000
    #: Windows computed together.
    block: int = 2048


_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Rows that never teach."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


@dataclass
class LanguageModel:
    params: LanguageParams
    languages: list[str]
    net: ByteGru | None

    def distributions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean label probabilities (rows x languages) over all positions of each row of a slice."""
        p, n = self.params, len(offsets) - 1
        sizes = np.diff(offsets)
        if self.net is None:
            return np.ones((n, len(self.languages)))
        count = -(-sizes // p.window)
        row = np.repeat(np.arange(n), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][row] + nth * p.window
        fill = np.minimum(p.window, offsets[1:][row] - start)
        sums = np.zeros((n, len(self.languages)))
        padded = np.concatenate([data, np.zeros(p.window, np.uint8)])
        order = np.argsort(-fill, kind="stable")  # short last windows come together
        for at in range(0, len(order), p.block):
            own = order[at : at + p.block]
            steps = int(fill[own[0]])
            x = padded[np.arange(steps)[:, None] + start[own][None]]
            inside = np.arange(steps)[:, None] < fill[own][None]
            whole = inside.all()
            prob = self.net.position_probabilities(x, None if whole else inside)
            if not whole:
                prob *= inside[:, None]
            each = prob.sum(axis=0)
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(row[own], each[k], n)
        return sums / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for at, to, data, offsets in tb.slices(texts):
            dist = self.distributions(data, offsets) if self.languages else np.zeros((to - at, 0))
            best = dist.argmax(axis=1) if self.languages else np.zeros(to - at, int)
            for i in range(to - at):
                text = texts[at + i].as_py()
                if self.languages and text and _LETTER.search(text):
                    names.append(self.languages[best[i]])
                    scores[at + i] = min(1.0, float(dist[i, best[i]]))
                else:
                    names.append(UNKNOWN)
        return names, scores


def windows_of(raw: bytes, p: LanguageParams, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Some windows of a text and the mask of their bytes."""
    starts = np.arange(0, max(1, len(raw)), p.window)
    starts = rng.permutation(starts)[: p.windows]
    x, mask = np.zeros((len(starts), p.window), np.uint8), np.zeros((len(starts), p.window), np.float32)
    for i, s in enumerate(starts):
        own = np.frombuffer(raw[s : s + p.window], np.uint8)
        x[i, : len(own)], mask[i, : len(own)] = own, 1
    return x, mask


def fit_sample(sample: list[tuple[str, str]], p: LanguageParams = LanguageParams()) -> LanguageModel:
    """Trains on (text, language) pairs."""
    sample = [(t.encode(), lang) for t, lang in sample if t]
    languages = sorted({lang for _, lang in sample})
    if len(languages) < 2:
        return LanguageModel(p, languages, None)
    rng = np.random.default_rng(11)
    parts = [(*windows_of(raw, p, rng), languages.index(lang)) for raw, lang in sample]
    x, mask = np.concatenate([a for a, _, _ in parts]), np.concatenate([b for _, b, _ in parts])
    y = np.concatenate([np.full(len(a), k) for a, _, k in parts])
    # Few windows are read more often, so that small tables teach as many steps.
    epochs = max(p.epochs, min(40, int(np.ceil(p.epochs * 3000 / len(y)))))
    return LanguageModel(p, languages, train(x, mask, y, len(languages), p.hidden, epochs))


def fit(docs: DataFrame, p: LanguageParams = LanguageParams()) -> LanguageModel:
    """Trains on the bounded sample of rows of ``docs(doc_id, text, lang, ...)`` that ``held_out`` leaves.

    A text counts by the hash of its whole, once a language. Some more than ``per_language`` hashes of each language are let
    through, by the number of its distinct ones, then the first ones are taken.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.octet_length("text").between(1, p.longest))
    known = known.withColumn("place", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()}
    share = lambda n: min(1.0, 1.5 * p.per_language / n + 20 / n)
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (F.col("place") <= min(2**63 - 1, int((2 * share(n) - 1) * 2**63))))
    first = known.where(chosen).groupBy("lang", "place").agg(F.min("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("place")
    sample = first.withColumn("k", F.row_number().over(w)).where(F.col("k") <= p.per_language).orderBy("lang", "place").collect() if counts else []
    return fit_sample([(r["text"], r["lang"]) for r in sample], p)


def identify(docs: DataFrame, model: LanguageModel, name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name`` (name, score); every other column as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("name string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = shared.value.predict(pa.array(texts, pa.large_string(), from_pandas=True))
            yield pd.DataFrame({"name": names, "score": scores})

    return docs.withColumn(name, language(F.col("text").cast("string")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, by a network trained on the others."""
    docs = tables.read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.name").alias("lang_pred"), F.col("language.score").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
