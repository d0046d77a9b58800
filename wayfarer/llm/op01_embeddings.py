"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector kept per group.

Equal vectors of a label share one representative. The centres of a label are fitted on a bounded sample
of its representatives; each of these belongs to the cell of its nearest centre. A vector is also a
*guest* in every cell whose boundary is nearer than half the threshold's angle: of two vectors within
that angle on either side of the plane between two centres, at least one is within half of it, and is
compared as a guest in the other one's cell. So no link is lost between cells, at any size.

A cell's own vectors are multiplied, block by block, with its own and guest vectors. A task returns the
number of links of each vector and a spanning set of links, never all pairs. Where both vectors of a pair
are guests at each other's, the pair counts in the cell with the smaller number.

Defined cases: null and zero vectors, vectors with null, infinite or NaN components and vectors without
a label link with nothing; vectors of different lengths are never compared; repeated rows link with
one another; rows with a null id stay, without links; labels of any type are compared by their text; finite vectors of any
size count; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .grouped import by_first_column

THRESHOLD = 0.98
#: Vectors a cell is meant to hold, most cells of a label, vectors that a label's centres are fitted on.
CELL, MOST_CELLS, SAMPLE = 1024, 4096, 20_000
#: Vectors placed by one task at a time, vectors of a cell in one task, rows of a product.
CHUNK, TASK, BLOCK = 50_000, 8192, 512


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision (rows x length) of an array column whose rows have one length."""
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(n, -1)
    # By a power of two first, so that no square leaves the range of doubles.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / norm, norm[:, 0]


def _element(df: DataFrame) -> str:
    """``float`` where vectors have single precision, else ``double``; products are always of doubles."""
    return "float" if df.select("embedding").dtypes[0][1] == "array<float>" else "double"


def usable(df: DataFrame) -> DataFrame:
    """``(vec_id, label, fp, embedding)`` of the rows that can link at all. fp stands for label and vector."""
    kind = _element(df)
    single = kind == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for vec_id, vector, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not vector or None in vector:
                    continue
                x = np.array(vector, np.float32 if single else np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                x = x + x.dtype.type(0)  # no negative zeros
                for c, v in zip(rows, (vec_id, label, hashlib.blake2b(x.tobytes() + str(label).encode(), digest_size=16).digest(), x), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.float32() if single else pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["vec_id", "label", "fp", "embedding"])

    rows = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"), F.col("label").cast("string")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return rows.mapInArrow(run, f"vec_id long, label string, fp binary, embedding array<{kind}>")


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centres (k x length) of unit vectors: assignment by largest cosine, centre = direction of the sum."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return np.unique(centres, axis=0)


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each unit vector, and which cells (rows x cells) it is a guest in."""
    if len(centres) < 2:
        return np.zeros(len(x), np.int64), np.zeros((len(x), 1), bool)
    cos = x @ centres.T
    home = cos.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))
    beyond = (cos[np.arange(len(x)), home][:, None] - cos) / apart[home]  # sine of the angle to the plane between
    guest = beyond <= np.sqrt((1 - threshold) / 2) + 1e-7
    guest[np.arange(len(x)), home] = False
    return home, guest


def linked_pairs(cell: int, home: np.ndarray, guests: list[list[int]], x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (left, right) of rows whose product reaches the threshold, and which of them count in this cell.

    Left rows are the cell's own. A pair of two own vectors appears in both orders and counts for its left
    one; a pair with a guest appears once and counts for both, unless it counts in the guest's own cell.
    """
    for at in range(0, len(left), BLOCK):
        own = left[at : at + BLOCK]
        i, j = np.nonzero(x[own] @ x[right].T >= threshold)
        i, j = own[i], right[j]
        apart = i != j
        i, j = i[apart], j[apart]
        counts = np.ones(len(i), bool)
        for k in np.flatnonzero((home[j] != cell) & (home[j] < cell)).tolist():
            counts[k] = int(home[j[k]]) not in guests[i[k]]
        yield i, j, counts


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows(task, left, right, rep, mult, cell, home, guests, embedding)`` -> ``(rep, links, low)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(t: pa.Table) -> pa.RecordBatch:
            x, _ = units(t["embedding"].combine_chunks())
            ids, mult, home, cell = t["rep"].to_numpy(), t["mult"].to_numpy(), t["home"].to_numpy(), int(t["cell"][0].as_py())
            left, right = np.flatnonzero(t["left"].to_numpy(zero_copy_only=False)), np.flatnonzero(t["right"].to_numpy(zero_copy_only=False))
            links, low, seen = np.zeros(len(ids)), ids.copy(), np.zeros(len(ids), bool)
            for i, j, counts in linked_pairs(cell, home, t["guests"].to_pylist(), x, left, right, threshold):
                seen[i] = seen[j] = True
                guest = counts & (home[j] != cell)
                links += np.bincount(i[counts], mult[j[counts]], len(ids)) + np.bincount(j[guest], mult[i[guest]], len(ids))
                while len(i):  # the smallest id spreads along links
                    before = low.copy()
                    m = np.minimum(low[i], low[j])
                    np.minimum.at(low, i, m)
                    np.minimum.at(low, j, m)
                    if (low == before).all():
                        break
            return pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(links[seen].astype(np.int64)), pa.array(low[seen])], ["rep", "links", "low"])

        yield from by_first_column(batches, each)

    cols = ["task", "left", "right", "rep", "mult", "cell", "home", "guests", "embedding"]
    return rows.select(*cols).repartition("task").sortWithinPartitions("task").mapInArrow(run, "rep long, links long, low long")


def _centres(reps: DataFrame) -> DataFrame:
    """``(label, n, total, centres)``: the centres of each label's vectors of one length, end to end, from a sample of some SAMPLE of them."""

    def fit(t: pa.Table) -> pa.Table:
        x, _ = units(t["embedding"].combine_chunks())
        order = np.argsort(t["rep"].to_numpy(), kind="stable")
        wanted = int(min(MOST_CELLS, max(2, -(-t["total"][0].as_py() // CELL))))
        centres = spherical_kmeans(x[order], wanted)
        return t.select(["label", "n", "total"]).slice(0, 1).append_column("centres", pa.array([centres.ravel()], pa.list_(pa.float64())))

    some = reps.where(F.pmod(F.xxhash64("rep", F.lit(7)), "total") < SAMPLE)
    return some.groupBy("label", "n").applyInArrow(fit, "label string, n int, total long, centres array<double>")


def _placed(reps: DataFrame, centres: DataFrame, threshold: float, kind: str) -> DataFrame:
    """A row per representative and cell: ``(rep, label, mult, embedding, n, cell, home, guests)``.

    A label's representatives are dealt over tasks of some CHUNK rows, each with the label's centres.
    """
    parts = F.ceil(F.col("total") / CHUNK)
    dealt = reps.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(11)), parts))
    copies = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select("label", "n", "part", "centres")
    schema = f"rep long, label string, mult long, embedding array<{kind}>, n int, cell long, home long, guests array<long>"

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["rep", "label", "mult", "embedding", "n"]
        if not left.num_rows:
            return left.select(names).append_column("cell", pa.array([], pa.int64())).append_column("home", pa.array([], pa.int64())).append_column("guests", pa.array([], pa.list_(pa.int64())))
        length = left["n"][0].as_py()
        c = right["centres"].combine_chunks().flatten().to_numpy().reshape(-1, length)
        out = []
        for at in range(0, left.num_rows, 4096):
            part = left.select(names).slice(at, 4096)
            home, guest = cells_of(units(part["embedding"].combine_chunks())[0], c, threshold)
            row, cell = np.nonzero(guest)
            which = np.concatenate([np.arange(len(home)), row])
            ends = np.concatenate([[0], np.cumsum(guest.sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell.astype(np.int64)))
            taken = pa.array(which)
            out.append(part.take(taken).append_column("cell", pa.array(np.concatenate([home, cell]).astype(np.int64))).append_column("home", pa.array(home[which].astype(np.int64))).append_column("guests", lists.take(taken)))
        return pa.concat_tables(out)

    return dealt.groupBy("label", "n", "part").cogroup(copies.groupBy("label", "n", "part")).applyInArrow(place, schema)


def direct_links(reps: DataFrame, total: int, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(rep, links, low)`` rows of ``total`` ``reps(rep, label, mult, embedding)``: to be summed, and links of a spanning set."""
    reps = reps.withColumn("n", F.size("embedding"))
    sizes, n_sizes = tables.counted(reps.groupBy("label", "n").agg(F.count("*").alias("total")))
    reps = tables.attach(reps, sizes, ["label", "n"], n_sizes, "rep")
    placed, n_placed = tables.counted(_placed(reps, _centres(reps), threshold, kind))
    key = ["label", "n", "cell"]
    cells = placed.groupBy(*key).agg(F.count_if(F.col("home") == F.col("cell")).alias("own"), F.count("*").alias("rows"), F.ceil(F.count("*") / TASK).alias("blocks")).where("own > 0 AND rows > 1")
    rows = tables.join_skewed(placed, cells, key, "rows", n_placed, "rep")
    # Every block of a cell meets every block; a row is left in its own block's tasks if it is at home, and right in all that look at its block.
    block = F.pmod(F.xxhash64("rep", F.lit(1)), "blocks")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("b", block).withColumn("at_home", F.col("home") == F.col("cell"))
    task = lambda l, r: F.xxhash64(*key, l, r).alias("task")
    cols = ["rep", "mult", "cell", "home", "guests", "embedding"]
    within = rows.select(task(F.col("b"), F.col("b")), F.col("at_home").alias("left"), F.lit(True).alias("right"), *cols)
    wide = rows.where("blocks > 1").withColumn("o", others).where("o != b")
    left = wide.where("at_home").select(task(F.col("b"), F.col("o")), F.lit(True).alias("left"), F.lit(False).alias("right"), *cols)
    right = wide.select(task(F.col("o"), F.col("b")), F.lit(False).alias("left"), F.lit(True).alias("right"), *cols)
    return _compare(within.unionByName(left).unionByName(right), threshold)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``df(vec_id, embedding, label, ...)``."""
    kind = _element(df)
    rows, n_rows = tables.counted(usable(df))
    reps = rows.groupBy("fp").agg(F.min(F.struct("vec_id", "label", "embedding")).alias("r"), F.count("*").alias("mult"))
    reps, n_reps = tables.counted(reps.select("fp", F.col("r.vec_id").alias("rep"), "r.label", "r.embedding", "mult"))
    found = tables.stored(direct_links(reps.drop("fp"), n_reps, kind, threshold))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = tables.components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    known = reps.select("fp", "rep", "mult").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("fp", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = tables.join_skewed(rows.select("vec_id", "fp"), known, ["fp"], "mult", n_rows, "vec_id").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    ids = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("e"), F.col("label").cast("string").alias("label"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    can = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("e", lambda v: v != 0), F.lit(False))
    alone = ids.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors within their labels."""
    return near_duplicates(tables.read(spark, sf_dir, "embeddings"))


_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
), component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON e.vec_id = c.id LEFT JOIN degree d ON d.a = e.vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_embedding_near_dedup": op1_embedding_near_dedup}
SQL: dict[str, str] = {"op1_embedding_near_dedup": _SQL}
