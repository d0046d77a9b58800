"""The corpus pipeline: documents are judged, deduplicated and packed, stage after stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the next one works on all rows that it
kept. All stages but the last return the columns of ``documents`` as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import op02_language, op06_toxicity, op08_minhash, op09_packing, tables

#: A document goes if it is at least this toxic.
TOXIC = 0.5
#: A document goes if it has no language, or if none of its positions' languages reaches this share.
LEAST_LANGUAGE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. Null and empty texts stay."""
    tables.bounded_batches(spark)
    model = op06_toxicity.fit(docs, tables.read(spark, sf_dir, "labels"))
    name = tables.free_name(docs, "toxicity")
    return op06_toxicity.score(docs, model, name).where(F.col(name) < TOXIC).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Texts that are null or have no letter go."""
    tables.bounded_batches(spark)
    name = tables.free_name(docs, "language")
    known = op02_language.identify(docs, op02_language.fit(docs), name)
    return known.where((F.col(f"{name}.name") != op02_language.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_LANGUAGE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more: the one with the smallest id."""
    tables.bounded_batches(spark)
    return op08_minhash.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    tables.bounded_batches(spark)
    return op09_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = tables.stored(out)
    return out
