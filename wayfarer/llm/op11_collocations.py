"""Collocations of each language by prefix-free parsing.

Pieces of text are cut into chunks where the hash of two words triggers; neighbouring chunks share these
two words. Distinct chunks with their frequencies are the dictionary. Words, pairs and triples are counted
inside distinct chunks, weighted by frequency, and belong to the chunk in which their first word is not one
of the two shared last ones, so each occurrence counts once. Pairs are counted only of words that are
frequent enough themselves, triples only of such pairs: a table of bits of fixed size tells these from the
others in tasks, and what it wrongly lets through is still counted exactly.

Defined cases: null and empty texts have no words; a null language is ``und``, as a given ``und`` is; repeated
rows count each; equal scores and frequencies are told apart by the phrase; other columns are ignored;
an empty table has no rows; a text of any length is parsed a run of bytes at a time, and where a piece is
longer than that, the cut is one more chunk border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from . import textbytes as tb
from .grouped import many

UNKNOWN = "und"
#: Words that neighbouring chunks share, so that no phrase of one word more is lost at a border.
SHARED = 2
#: One pair of words in so many ends a chunk.
MODULUS = 12
#: Bits of the table that tells frequent phrases.
BITS = 26
#: Dictionary rows that a task counts together, parts of a language that are ranked apart first.
TOGETHER, PARTS = 40_000, 32


@dataclass(frozen=True)
class CollocationParams:
    least: int = 10
    top: int = 2000
    #: A phrase goes if a longer one that holds it has this many hundredths of its occurrences.
    covered: int = 50


_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_IN_WORD = ~_PIECE_END
_IN_WORD[[9, 32]] = False
_IN_CHUNK = np.ones(256, bool)
_IN_CHUNK[32] = False
_FIRST, _SECOND = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def parse(data: np.ndarray, offsets: np.ndarray, goes_on: bool = False, modulus: int = MODULUS) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Row, number of shared last words and text of each chunk of lowered bytes; words are joined by one space.

    ``goes_on``: the bytes are one piece that continues, whose last two words come again.
    """
    starts, ends, row = tb.word_spans(data, offsets, _IN_WORD)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    ended = np.cumsum(_PIECE_END[data])
    first = np.ones(n, bool)
    first[1:] = (row[1:] != row[:-1]) | (ended[starts[1:]] != ended[ends[:-1] - 1])
    h = tb.span_hashes(data, starts, ends)
    cut = first.copy()
    cut[:-1] |= (tb.mix64(h[:-1] * _FIRST + h[1:] * _SECOND) % np.uint64(modulus) == 0) & ~first[1:]
    begin = np.flatnonzero(cut)
    to = np.append(begin[1:], n)
    tail = np.append(np.where(first[begin[1:]], 0, SHARED), 0)
    to += tail
    if goes_on:
        tail[-1] = SHARED
        kept = to - begin > tail
        begin, to, tail = begin[kept], to[kept], tail[kept]
    size = to - begin
    at = np.cumsum(size) - size
    word = np.arange(size.sum()) + np.repeat(begin - at, size)
    glued = np.ones(len(word), bool)
    glued[at + size - 1] = False
    text, place = tb.take_spans(data, starts[word], ends[word], glued)
    return row[begin], tail, tb.strings(text, np.append(place[at], place[-1]))


def _long_runs(data: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, bool]]:
    """A long text in runs that end behind pieces; a longer piece in runs whose last two words come again."""
    for lo, hi in tb.runs(data, _PIECE_END, limit):
        size = limit
        while hi - lo > size + limit:
            starts, ends, _ = tb.word_spans(data[lo : lo + size], np.array([0, size]), _IN_WORD)
            whole = ends < size
            if whole.sum() <= SHARED:
                size *= 2
                continue
            yield data[lo : lo + int(ends[whole][-1])], True
            lo, size = lo + int(starts[whole][-SHARED]), limit
        yield data[lo:hi], False


def _chunks(texts: pa.Array, langs: pa.Array, modulus: int, limit: int) -> Iterator[pa.Table]:
    for at, to, raw, offsets in tb.slices(texts, limit):
        parts = [(raw, offsets, False)] if to - at > 1 else [(r, np.array([0, len(r)]), on) for r, on in _long_runs(raw, limit)]
        for data, where, goes_on in parts:
            row, tail, chunk = parse(tb.lower_ascii(data), where, goes_on, modulus)
            yield pa.table({"lang": langs.take(pa.array(row + at)), "tail": pa.array(tail, pa.int32()), "chunk": chunk})


def dictionary(docs: DataFrame, modulus: int = MODULUS, limit: int = tb.SLICE_BYTES) -> DataFrame:
    """``(lang, tail, chunk, n)``: distinct chunks of each language with their frequencies, counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for found in _chunks(batch.column(1), langs, modulus, limit):
                counts = found.group_by(["lang", "tail", "chunk"]).aggregate([([], "count_all")])
                yield from counts.select(["lang", "tail", "chunk", "count_all"]).rename_columns(["lang", "tail", "chunk", "n"]).to_batches()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "lang string, tail int, chunk string, n long")
    return found.groupBy("lang", "tail", "chunk").agg(F.sum("n").alias("n"))


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    """A number of each row's language that phrases' hashes are mixed with."""
    coded = langs.dictionary_encode()
    each = tb.hash_words([x.encode() + b"\n" for x in coded.dictionary.to_pylist()])
    return each[coded.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def frequent_bits(phrases: DataFrame) -> np.ndarray:
    """A table of 2**BITS bits, where those of the hashes of ``phrases(lang, phrase)`` are set; 8 MB whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch.column(1))
            place = _places(tb.mix64(tb.span_hashes(data, offsets[:-1], offsets[1:]) ^ _lang_hashes(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.left_shift(np.int64(1), place & 63))], ["at", "bit"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


def count_phrases(chunks: DataFrame, words: int, parts: np.ndarray | None = None) -> DataFrame:
    """``(lang, phrase, f)`` of the phrases of so many words in ``dictionary``; of those whose two parts of one word
    less have their bits set in ``parts``, if that is given."""
    shared = None if parts is None else chunks.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in many(batches, TOGETHER):
            langs, n = table["lang"].combine_chunks(), table["n"].to_numpy()
            data, offsets = _bytes_of(table["chunk"].combine_chunks())
            starts, ends, row = tb.word_spans(data, offsets, _IN_CHUNK)
            after = np.searchsorted(row, np.arange(len(n)), "right")
            at = np.flatnonzero(np.arange(len(row)) < np.minimum(after[row] - table["tail"].to_numpy()[row], after[row] - words + 1))
            if shared is not None:
                h = tb.span_hashes(data, starts[: len(starts) - words + 2], ends[words - 2 :])
                place = _places(tb.mix64(h ^ _lang_hashes(langs)[row[: len(h)]]))
                known = (shared.value[place >> 6] >> (place & 63)) & 1 == 1
                at = at[known[at] & known[at + 1]]
            found = pa.table({"lang": langs.take(pa.array(row[at])), "phrase": tb.span_strings(data, starts[at], ends[at + words - 1]), "f": n[row[at]]})
            yield from found.group_by(["lang", "phrase"]).aggregate([("f", "sum")]).select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"]).to_batches()

    return chunks.select("lang", "tail", "chunk", "n").mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """Floor of a million times a * a / (left * right), in decimals."""
    exact = lambda c: c.cast("decimal(19,0)")
    product = (exact(a) * exact(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", product, exact(left) * exact(right))


def _scored(pairs: DataFrame, triples: DataFrame, words: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` by the cut that scores lowest, of equal ones the first."""
    word = F.split("phrase", " ")
    both = lambda i, j: F.concat_ws(" ", word[i], word[j])
    part = lambda side, text: F.struct(F.lit(side).alias("side"), text.alias("part"))
    wanted = pairs.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(part("l1", word[0]), part("r1", word[1]))).alias("w")).unionByName(
        triples.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(part("l1", word[0]), part("r1", both(1, 2)), part("l2", both(0, 1)), part("r2", word[2]))).alias("w"))
    )
    wanted, total = tables.counted(wanted.select("lang", "phrase", "a", "w.side", "w.part"))
    known = words.unionByName(pairs).select("lang", F.col("phrase").alias("part"), F.col("f"))
    uses = wanted.groupBy("lang", "part").agg(F.count("*").alias("n"))
    rows = tables.join_skewed(wanted, uses.join(known, ["lang", "part"]), ["lang", "part"], "n", total, "phrase")
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("f"))).alias(side)
    out = rows.groupBy("lang", "phrase", "a").agg(*[pick(s) for s in ("l1", "r1", "l2", "r2")])
    out = out.withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", F.when(F.col("l2").isNotNull(), _score(F.col("a"), F.col("l2"), F.col("r2"))))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    of = lambda one, two: F.when(second, F.col(two)).otherwise(F.col(one))
    return out.select("lang", "phrase", "a", of("l1", "l2").alias("l"), of("r1", "r2").alias("r"), of("s1", "s2").alias("score"))


def _uncovered(scored: DataFrame, triples: DataFrame, p: CollocationParams) -> DataFrame:
    """Candidates without those that a longer one covers."""
    word = F.split("phrase", " ")
    inside = F.explode(F.array_distinct(F.array(F.concat_ws(" ", word[0], word[1]), F.concat_ws(" ", word[1], word[2])))).alias("phrase")
    longer = triples.select("lang", "f", inside).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(p.covered) * F.col("a"), F.lit(False))
    return scored.join(longer, ["lang", "phrase"], "left").where(~covered).drop("longer")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their ``rank``: the best of each part of a language first, then of these."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top).drop("_part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, p: CollocationParams = CollocationParams(), modulus: int = MODULUS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of ``docs(text, lang, ...)``."""
    chunks = tables.stored(dictionary(docs, modulus))
    words = tables.stored(count_phrases(chunks, 1))
    often = words.where(F.col("f") >= p.least)
    pairs = tables.stored(count_phrases(chunks, 2, frequent_bits(often)).where(F.col("f") >= p.least))
    triples = tables.stored(count_phrases(chunks, 3, frequent_bits(pairs)).where(F.col("f") >= p.least))
    best = _best(_uncovered(_scored(pairs, triples, often), triples, p), p.top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language of all documents."""
    return collocations(tables.read(spark, sf_dir, "documents"))


_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words),
grams AS (SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM places WINDOW p AS (PARTITION BY id ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM grams GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL
), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS m, w FROM cand),
scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.m, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.k = c.m AND x.phrase = array_to_string(c.w[1 : c.m], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - c.m AND y.phrase = array_to_string(c.w[c.m + 1 :], ' ')
), one AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1),
inside AS (
  SELECT lang, part AS phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT o.* FROM one o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * o.a
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_collocations": op11_collocations}
SQL: dict[str, str] = {"op11_collocations": _SQL}
