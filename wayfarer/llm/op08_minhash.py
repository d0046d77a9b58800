"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

Steps:

1. every document gets its shingle set, MinHash minima, band keys and a fingerprint of the set;
2. documents with equal sets share one representative, so exact copies cost nothing later;
3. the members of all buckets (representatives with a band key in common) that have the same smallest
   member form a *family*; candidates are families, never lists of pairs;
4. families are cut into blocks of bounded size. Inside a task the packed b-bit signatures of a block
   are compared by counting bits; pairs whose collision-corrected estimate may reach the
   threshold are confirmed on the full sets, and only a spanning set of links leaves the task;
5. in a family of a few blocks every block meets every other. Larger ones first go through two linear
   rounds with different block layouts; then only blocks that hold different components meet.

Keys that many rows share (a bucket, a family, a set of shingles, the centre of a star) are joined apart
from the others, see ``tables.join_skewed``.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a text with fewer
words than a shingle is one shingle; repeated rows and equal texts share a component; an id with several
texts stands for each of them, in the component of each; rows with a null id stay and have a null
component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash_sketch as ms
from . import tables
from . import textbytes as tb
from .grouped import by_first_column
from .minhash_sketch import MinHashParams

#: Documents in a block of a family.
BLOCK = 256
#: A family of more blocks than this goes through the linear rounds.
HUGE = 16
#: Representatives whose id another one has too are numbered from here on.
SURROGATE = 1 << 62

CONTRACT = MinHashParams(words=3, threshold=0.85)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """``(doc_id, n_shingles, fp, keys)`` of each row; keys is null for an empty set, whose fp stands for the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ms.constants(p)
        for batch in batches:
            ids = batch.column(0)
            for at, to, data, offsets in tb.slices(batch.column(1)):
                counts, prints, keys = [], [], []
                for i, s in enumerate(ms.shingle_sets(data, offsets, p.words)):
                    counts.append(len(s))
                    prints.append(fingerprint(s) if len(s) else b"empty " + str(ids[at + i]).encode())
                    keys.append(ms.band_keys(ms.minima(s, a, b), p.bands, p.rows) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "fp", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, fp binary, keys array<long>")


def document_sets(docs: DataFrame, wanted: DataFrame, most: int, p: MinHashParams) -> DataFrame:
    """``(node, shingles, signature)`` of the documents in ``wanted(doc_id, fp, node)``, which has ``most`` rows at most.

    A row whose set has another fingerprint than the one wanted is another text of that id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ms.constants(p)
        for batch in batches:
            for at, to, data, offsets in tb.slices(batch.column(1)):
                rows = [[], [], []]
                for s, fp, node in zip(ms.shingle_sets(data, offsets, p.words), batch.column(2).slice(at, to - at).to_pylist(), batch.column(3).slice(at, to - at).to_pylist(), strict=True):
                    if len(s) and fingerprint(s) == fp:
                        for c, v in zip(rows, (node, s.tobytes(), ms.packed(ms.minima(s, a, b), p.bits)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "shingles", "signature"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = tables.attach(texts, wanted, ["doc_id"], most, "text")
    return rows.select("doc_id", "text", "fp", "node").mapInArrow(run, "node long, shingles binary, signature binary")


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= round(100 * threshold) * (len(a) + len(b) - both)


class _Sets:
    """Union-find over the rows of one task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def block_links(ids: np.ndarray, side: np.ndarray, group: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, p: MinHashParams) -> list[tuple[int, int]]:
    """A spanning set of the links of one block (all sides 0) or between two blocks (sides 0 and 1).

    ``group`` holds components that are known already; pairs inside one need no look.
    """
    known, first = _Sets(len(ids)), {}
    for i, g in enumerate(group.tolist()):
        known.join(first.setdefault(g, i), i)
    size = np.array([len(s) for s in sets], np.int64)
    out, crossed = [], bool((side == 1).any())
    left = np.flatnonzero(side == 0)
    for i in left.tolist():
        right = np.flatnonzero(side == 1) if crossed else np.arange(i + 1, len(ids))
        if not len(right):
            continue
        least, most = np.minimum(size[right], size[i]), np.maximum(size[right], size[i])
        right = right[least >= p.threshold * most * (1 - 1e-9)]
        if not len(right):
            continue
        guess = ms.estimates(sigs[right], sigs[i][None], p)
        for j in right[np.argsort(-guess, kind="stable")][: int((guess >= p.least_estimate).sum())].tolist():
            if known.find(i) != known.find(j) and _linked(sets[i], sets[j], p.threshold):
                known.join(i, j)
                out.append((int(ids[i]), int(ids[j])))
    return out


def links_by_task(rows: DataFrame, p: MinHashParams) -> DataFrame:
    """Links of ``rows(task, side, node, group, shingles, signature)``; a task has at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: pa.Table) -> pa.RecordBatch:
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            sigs = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint8).reshape(len(sets), -1)
            found = block_links(t["node"].to_numpy(), t["side"].to_numpy(), t["group"].to_numpy(), sets, sigs, p)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        yield from by_first_column(batches, links)

    cols = ["task", "side", "node", "group", "shingles", "signature"]
    return rows.select(*cols).repartition("task").sortWithinPartitions("task", "side", "node").mapInArrow(run, "a long, b long")


def _block(rows: DataFrame, salt: int, members: str = "size") -> DataFrame:
    """``rows`` with a block number in their family."""
    return rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col(members) / (BLOCK * 3 // 4))))


def _meeting(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both blocks of each of ``pairs(family, block, other)``, by task. A block is a bounded number of rows."""
    pairs = pairs.withColumn("task", F.xxhash64("family", "block", "other", F.lit(4)))
    one = placed.join(pairs.select("family", "block", "task"), ["family", "block"]).withColumn("side", F.lit(0))
    two = placed.join(pairs.where("block != other").select("family", F.col("other").alias("block"), "task"), ["family", "block"]).withColumn("side", F.lit(1))
    return one.unionByName(two)


def _large_family_links(rows: DataFrame, p: MinHashParams) -> DataFrame:
    """Links of families of a few blocks: every block meets every other. ``rows``: node, family, size, shingles, signature."""
    placed = _block(rows, 3).withColumn("group", F.col("node"))
    last = F.ceil(F.col("size") / (BLOCK * 3 // 4)) - 1
    sizes = rows.select("family", "size").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pairs = sizes.select("family", "block", F.explode(F.sequence("block", last)).alias("other"))
    return links_by_task(_meeting(placed, pairs), p)


def _huge_family_links(rows: DataFrame, total: int, p: MinHashParams) -> DataFrame:
    """Links of families of many blocks: two linear rounds connect most, then only blocks that hold different components meet."""
    rows = tables.stored(rows)
    families = total // (HUGE * BLOCK)
    found: DataFrame | None = None
    labels = rows.select("family", "node", F.col("node").alias("group"))
    for salt in (1, 2):  # every document meets one block
        placed = _block(rows, salt).join(labels, ["family", "node"]).withColumn("task", F.xxhash64("family", "block", F.lit(salt))).withColumn("side", F.lit(0))
        new = tables.stored(links_by_task(placed, p))
        found = new if found is None else tables.stored(found.unionByName(new))
        parts = tables.components(found).withColumnRenamed("id", "node")
        labels = tables.stored(rows.select("family", "node").join(parts, "node", "left").select("family", "node", F.coalesce("component", "node").alias("group")))
    placed = rows.join(labels, ["family", "node"])
    weight = labels.groupBy("family", "group").agg(F.count("*").alias("weight"))
    top = weight.groupBy("family").agg(F.max(F.struct("weight", "group")).alias("top")).select("family", F.col("top.group").alias("main"))
    placed = tables.attach(placed, top, ["family"], families, "node").withColumn("rest", F.col("group") != F.col("main"))
    count = tables.attach(labels, top, ["family"], families, "node").groupBy("family", (F.col("group") != F.col("main")).alias("rest")).agg(F.count("*").alias("members"))
    placed = _block(tables.attach(placed, count, ["family", "rest"], 2 * families, "node"), 3, "members").withColumn("block", F.col("block") * 2 + F.col("rest").cast("int"))
    placed = tables.stored(placed.select("family", "block", "rest", "node", "group", "shingles", "signature"))
    blocks = placed.select("family", "block", "rest").distinct()
    right = blocks.select("family", F.col("block").alias("other"), F.col("rest").alias("other_rest"))
    # A block of the rest meets those of the main component, of the rest, and itself.
    pairs = blocks.where("rest").join(right, "family").where("NOT other_rest OR block <= other").select("family", "block", "other")
    return found.unionByName(links_by_task(_meeting(placed, pairs), p))


def representative_links(docs: DataFrame, reps: DataFrame, n_reps: int, p: MinHashParams) -> DataFrame:
    """Confirmed links ``(a, b)`` between representatives ``reps(node, doc_id, fp, keys)``, enough to connect what belongs together.

    A family is all members of the buckets that have the same smallest member; two documents of one
    bucket share a family, and a document may be in several.
    """
    keyed = reps.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("family"), F.count("*").alias("n")).where("n > 1")
    members, total = tables.counted(tables.join_skewed(keyed, hubs, ["key"], "n", n_reps * p.bands, "node").select("node", "family").distinct())
    sizes = members.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") > 2 * BLOCK)
    sizes, n_large = tables.counted(sizes)
    most = min(total, n_reps)
    wanted = reps.select("doc_id", "fp", "node").join(members.select("node").distinct(), "node", "left_semi").select("doc_id", "fp", "node")
    sets = document_sets(docs, wanted, most, p)
    placed = sets.join(F.broadcast(members) if total <= tables.BROADCAST_ROWS else members, "node")
    rows = tables.stored(tables.attach(placed, sizes, ["family"], n_large, "node", "left"))
    plain = rows.where("size IS NULL").select(F.col("family").alias("task"), F.lit(0).alias("side"), "node", F.col("node").alias("group"), "shingles", "signature")
    links = links_by_task(plain, p)
    if n_large:
        links = links.unionByName(_large_family_links(rows.where(F.col("size") <= HUGE * BLOCK), p))
        if sizes.where(F.col("size") > HUGE * BLOCK).count():
            links = links.unionByName(_huge_family_links(rows.where(F.col("size") > HUGE * BLOCK), total, p))
    return links


def _representatives(sketch: DataFrame) -> tuple[DataFrame, int, bool]:
    """``(node, doc_id, fp, keys, n)`` of each different set, how many there are, and whether some id has several.

    The node is the smallest id with that set; an id's second and further sets get numbers of their own.
    """
    known = sketch.where("doc_id IS NOT NULL")
    reps = known.groupBy("fp").agg(F.min(F.struct("doc_id", "keys")).alias("r"), F.count("*").alias("n")).select(F.col("r.doc_id").alias("node"), "r.doc_id", "fp", "r.keys", "n")
    reps, n = tables.counted(reps)
    again, n_again = tables.counted(reps.groupBy("doc_id").agg(F.min("fp").alias("first"), F.count("*").alias("c")).where("c > 1").select("doc_id", "first"))
    if not n_again:
        return reps, n, False
    rows = tables.attach(reps, again, ["doc_id"], n_again, "fp", "left")
    other = F.monotonically_increasing_id() + F.lit(SURROGATE)
    node = F.when(F.col("first").isNotNull() & (F.col("first") != F.col("fp")), other).otherwise(F.col("doc_id"))
    return tables.stored(rows.select(node.alias("node"), "doc_id", "fp", "keys", "n")), n, True


def _labelled(docs: DataFrame, p: MinHashParams) -> tuple[DataFrame, int, DataFrame, int]:
    """Sketches of all rows and how many, and ``(fp, n, node, doc_id, component, component_id)`` of the different sets and how many."""
    sketch, total = tables.counted(sketches(docs, p))
    reps, n_reps, several = _representatives(sketch)
    links = representative_links(docs, reps.where("keys IS NOT NULL"), n_reps, p)
    # Stored first: a stage then runs one Python worker a task, for the links or for the components.
    found = tables.components(tables.stored(links)).withColumnRenamed("id", "node")
    labels = reps.select("node", "doc_id", "fp", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not several:
        return sketch, total, labels.withColumn("component_id", F.col("component")), n_reps
    labels = tables.stored(labels)
    low = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    return sketch, total, tables.join_skewed(labels, low, ["component"], "members", n_reps, "fp").drop("members"), n_reps


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs(doc_id, text, ...)``; the component is its smallest doc_id."""
    sketch, total, labels, _ = _labelled(docs, p)
    rows = sketch.where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "fp")
    joined = tables.join_skewed(rows, labels.select("fp", "n", "component_id"), ["fp"], "n", total, "doc_id").select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(sketch.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def one_of_each(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest id; rows without an id stay.

    An id with several texts keeps those that no other group's smallest row stands for. Texts aren't shuffled:
    the ids that go are few enough to broadcast, or are joined beyond that bound.
    """
    sketch, total, labels, n_reps = _labelled(docs, p)
    best = labels.groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("b")).select("b.doc_id", "b.fp", F.lit(True).alias("stays"))
    rows = sketch.where("doc_id IS NOT NULL").groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    judged = rows.join(best, ["doc_id", "fp"], "left")
    per_id = judged.groupBy("doc_id").agg(F.sum("n").alias("rows"), F.count("stays").alias("stay"))
    gone, n_gone = tables.counted(per_id.where("stay = 0").select("doc_id"))
    again, n_again = tables.counted(per_id.where("stay > 0 AND rows > 1").select("doc_id"))
    mark = lambda t: t.select(F.col("doc_id").alias("_gone"))
    out = _without(docs, mark(gone), n_gone)
    if not n_again:
        return out
    stays = judged.join(again, "doc_id", "left_semi").where("stays").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    prints = _fingerprints(p)

    repeated = docs.join(F.broadcast(mark(again)) if n_again <= tables.BROADCAST_ROWS else mark(again), F.col("doc_id").cast("long") == F.col("_gone"), "left_semi")
    repeated = repeated.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_fp", prints(F.col("text").cast("string"), F.col("_id")))
    repeated = repeated.join(stays, ["_id", "_fp"], "left_semi").dropDuplicates(["_id", "_fp"]).select(*docs.columns)
    return _without(out, mark(again), n_again).unionByName(repeated)


def _without(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``ids(_gone)``."""
    return docs.join(F.broadcast(ids) if n <= tables.BROADCAST_ROWS else ids, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").select(*docs.columns)


def _fingerprints(p: MinHashParams):
    """The fingerprint of a text's set, as ``sketches`` gives it."""

    @F.pandas_udf("binary")
    def prints(texts: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for at, _, data, offsets in tb.slices(pa.array(texts, pa.large_string(), from_pandas=True)):
            out += [fingerprint(s) if len(s) else b"empty " + str(int(ids.iloc[at + i])).encode() for i, s in enumerate(ms.shingle_sets(data, offsets, p.words))]
        return pd.Series(out)

    return prints


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, Jaccard 0.85 or more."""
    out = near_duplicates(tables.read(spark, sf_dir, "documents"), CONTRACT)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_minhash_near_dedup": op8_minhash_near_dedup}

_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS shingle FROM w
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN size sa ON sa.doc_id = a.doc_id JOIN size sb ON sb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (first(sa.n) + first(sb.n) - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
), component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN component c ON d.doc_id = c.id LEFT JOIN size ON size.doc_id = d.doc_id
"""
SQL: dict[str, str] = {"op8_minhash_near_dedup": _SQL}
