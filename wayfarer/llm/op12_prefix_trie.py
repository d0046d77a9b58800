"""The trie of conversation prefixes, by van Emde Boas recursion.

A tree of height 2**k is cut at half depth, again and again. Going up, the turns of aligned segments of twice
the length get one digest from those of their halves. Going down, the scale of each cut halves: a prefix that
ends at a cut is named by the name of the prefix that its tree hangs from and the digest of the segment between
them, for upper trees and lower forests alike and at once, so all prefixes have names after as many rounds
as the depth has binary digits. Then totals go up, from the smallest trees to the largest: the sum of
each lower tree is grafted upon its cut node and upon that one's ancestors in the upper tree.

A node is known by its smallest member and its depth. No conversation is gathered: turns are numbered by ranges,
and segments, names and sums are rows. The members that end at a node are hashed in order by ranges of
rows; only nodes that cross a range pass on blocks of ids.

Defined cases: a null role or text is empty; turns come in order, null first, and those of one turn by the SHA-256
of role and text; rows without a conv_id belong to no conversation; repeated rows are turns of their own; a
conversation may be left without a turn and ends at the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables

#: Turns at the head of every hundred's first conversation that the others may take over.
MOST_HEAD, HUNDRED = 6, 100
#: Depths of one conversation that a task grafts upon together, and ids in a block of a node that crosses ranges.
TOGETHER, BLOCK = 4096, 20_000
_NOTHING = hashlib.sha256(b"").hexdigest()
_BLOCK = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string()), ("whole", pa.bool_())])
_HASH = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("sha256", pa.string())])


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, i, digest, n_chars)`` of the turns of ``turns(conv_id, turn, role, text)``, ``i`` from 0, and
    ``(conv_id, n)``: ranges of turns are numbered apart and carry on from the ranges before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tables.stored(rows.repartitionByRange(parts, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("part")
    sizes = sizes.withColumn("before", F.sum("n").over(w) - F.col("n"))
    own = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = ranged.withColumn("i", F.row_number().over(own) - 1).join(sizes.select("conv_id", "part", "before"), ["conv_id", "part"])
    return placed.select("conv_id", (F.col("before") + F.col("i")).alias("i"), "digest", "n_chars"), sizes.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, digest, n_chars)`` of the rebuilt conversations, depths from 1, and ``(conv_id, size)`` of all of them."""
    placed, sizes = numbered(turns)
    placed, sizes = tables.stored(placed), tables.stored(sizes)
    heads = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD).alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"))
    lengths = sizes.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = heads.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = tables.stored(heads.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")))
    first = placed.where((F.col("conv_id") % HUNDRED == 0) & (F.col("i") < MOST_HEAD)).withColumnRenamed("conv_id", "base")
    taken = heads.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where(F.col("i") < F.col("taken"))
    # One row a conversation on one side, but a conversation of any length on the other: by blocks of its turns.
    block = F.floor(F.col("i") / TOGETHER)
    blocks = heads.join(sizes, "conv_id").where("n > h").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TOGETHER))).alias("block"))
    own = placed.withColumn("block", block).join(blocks, ["conv_id", "block"]).where(F.col("i") >= F.col("h"))
    rows = taken.select("conv_id", (F.col("i") + 1).alias("depth"), "digest", "n_chars").unionByName(own.select("conv_id", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"), "digest", "n_chars"))
    return rows, heads.select("conv_id", "size")


def _digest(*parts: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def named(turns: DataFrame, deepest: int) -> DataFrame:
    """``(conv_id, depth, name)`` of all prefixes of ``turns(conv_id, depth, digest)`` that have a turn, by cuts at half depth."""
    rounds = max(1, int(deepest).bit_length())
    # Digests of aligned segments of 2**k turns; ``q`` numbers them within their conversation.
    segments = [turns.select("conv_id", (F.col("depth") - 1).alias("q"), "digest")]
    half = lambda odd: F.max(F.when(F.col("q") % 2 == odd, F.col("digest")))
    for k in range(1, rounds):
        pairs = segments[-1].groupBy("conv_id", F.floor(F.col("q") / 2).alias("q")).agg(half(0).alias("a"), half(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        segments.append(tables.stored(pairs.select("conv_id", "q", _digest("a", "b").alias("digest"))))
    # Names of the prefixes that trees of the present scale hang from; at first that is the root alone.
    roots, out = None, []
    for k in range(rounds - 1, -1, -1):
        upper = segments[k].where("q % 2 = 0").select("conv_id", F.floor(F.col("q") / 2).alias("tree"), "digest")
        if roots is None:
            cut = upper.select("conv_id", F.col("tree"), _digest("digest").alias("name"))
            hung = cut.select("conv_id", (F.col("tree") * 2 + 1).alias("tree"), "name")
            roots = tables.stored(hung)
            out.append(roots.select("conv_id", (F.col("tree") * (1 << k)).alias("depth"), "name"))
            continue
        # Trees at the root of a conversation have no name to go on from.
        cut = upper.join(roots, ["conv_id", "tree"], "left").where("tree = 0 OR name IS NOT NULL")
        cut = tables.stored(cut.select("conv_id", "tree", F.when(F.col("tree") == 0, _digest("digest")).otherwise(_digest("name", "digest")).alias("name")))
        roots = roots.select("conv_id", (F.col("tree") * 2).alias("tree"), "name").unionByName(cut.select("conv_id", (F.col("tree") * 2 + 1).alias("tree"), "name"))
        out.append(cut.select("conv_id", ((F.col("tree") * 2 + 1) * (1 << k)).alias("depth"), "name"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def paths(turns: DataFrame, sizes: DataFrame, deepest: int) -> DataFrame:
    """``(conv_id, depth, node, up, n_convs, n_ends, n_chars)`` of each conversation and depth from 0: the smallest members of
    the node there and of the one above, members that pass and that end there."""
    names = named(turns.select("conv_id", "depth", "digest"), deepest).join(turns.select("conv_id", "depth", "n_chars"), ["conv_id", "depth"])
    # Lengths reach the rows as rows: a conversation's last one.
    ends = sizes.select("conv_id", F.col("size").alias("depth"), F.lit(1).cast("long").alias("ends"))
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("name"), F.lit(0).cast("long").alias("n_chars"))
    rows = names.unionByName(root).join(ends, ["conv_id", "depth"], "left").withColumn("ends", F.coalesce("ends", F.lit(0)))
    rows, total = tables.counted(rows)
    nodes = rows.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.sum("ends").alias("n_ends"))
    met = tables.stored(tables.join_skewed(rows.drop("ends"), nodes, ["depth", "name"], "n_convs", total, "conv_id").drop("name"))
    above = met.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
    return met.join(above, ["conv_id", "depth"], "left")


def subtree_sums(steps: DataFrame, deepest: int) -> DataFrame:
    """``(node, depth, n_leaves, saved)`` summed over the subtrees of all nodes of ``paths`` but the root, in parts that add up."""
    nodes = steps.where("conv_id = node AND depth > 0")
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    sums = nodes.select("node", "depth", "up", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    upper = steps.where("depth > 0").select("conv_id", "depth", "node", "up")
    for k in range(max(0, int(deepest - 1).bit_length())):
        half = 1 << k
        # What hangs from a cut node: the sums of its children, whose lower trees are complete up to this scale.
        lower = sums.where((F.col("depth") - 1) % (2 * half) == half).groupBy("up", (F.col("depth") - 1).alias("cut")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        blocks = F.sequence(F.lit(0).cast("long"), F.lit((half - 1) // TOGETHER).cast("long"))
        lower = lower.select(F.col("up").alias("conv_id"), "cut", "n_leaves", "saved", F.explode(blocks).alias("block"))
        # Its ancestors in the upper tree lie on the path of its smallest member.
        above = F.floor((F.col("depth") - 1) / half)
        path = upper.where(above % 2 == 0).select("conv_id", ((above + 1) * half).alias("cut"), F.floor(((F.col("depth") - 1) % half) / TOGETHER).alias("block"), "node", "depth", "up")
        grafted = path.join(lower, ["conv_id", "cut", "block"]).groupBy("node", "depth", "up").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        sums = sums.unionByName(tables.stored(grafted).select("node", "depth", "up", "n_leaves", "saved"))
    return sums


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(node, depth, conv_id)`` as blocks of ids of one node; ``whole`` if the node surely has no other block."""
    key, ids, cut, opening = None, [], False, True

    def row(whole: bool) -> tuple:
        return (*key, ids[0], ",".join(map(str, ids)), whole)

    for batch in batches:
        node, depth, conv = (batch.column(i).to_numpy() for i in range(3))
        edges = (np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1).tolist()
        rows = []
        for lo, hi in zip([0, *edges], [*edges, len(node)], strict=True):
            if lo == hi:
                continue
            now = (int(node[lo]), int(depth[lo]))
            if key is not None and now != key:
                rows.append(row(not cut and not opening))
                ids, cut, opening = [], False, False
            key = now
            for at in range(lo, hi, BLOCK):
                if len(ids) >= BLOCK:
                    rows.append(row(False))
                    ids, cut = [], True
                ids += conv[at : min(hi, at + BLOCK)].tolist()
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, r, strict=True)) for r in rows], _BLOCK)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, row(False), strict=True))], _BLOCK)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node whose blocks come in order."""
    key, state = None, None
    for batch in batches:
        rows = []
        for node, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (node, depth) != key:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([{"node": a, "depth": b, "sha256": c} for a, b, c in rows], _HASH)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"node": key[0], "depth": key[1], "sha256": state.hexdigest()}], _HASH)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(node, depth, sha256)`` of ``ends(node, depth, conv_id)``: the ids of each node's rows, ascending, with commas."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select("node", "depth", "conv_id").repartitionByRange(parts, "node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    blocks = tables.stored(ranged.mapInArrow(_blocks, "node long, depth long, first long, ids string, whole boolean"))
    whole = blocks.where("whole").select("node", "depth", F.sha2("ids", 256).alias("sha256"))
    others = blocks.where("NOT whole").repartition(parts, "node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "ids")
    return whole.unionByName(others.mapInArrow(_hashed, "node long, depth long, sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``turns(conv_id, turn, role, text, ...)``."""
    rows, sizes = rebuilt(turns)
    rows, sizes = tables.stored(rows), tables.stored(sizes)
    deepest = sizes.agg(F.max("size")).first()[0] or 0
    steps = tables.stored(paths(rows, sizes, deepest))
    nodes = steps.where("conv_id = node")
    sums = subtree_sums(steps, deepest)
    zero, none, text = F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string")

    def part(df: DataFrame, node: str = "node", depth: Column = F.col("depth"), parent: Column = none, convs: Column = none, children: Column = zero, leaves: Column = zero, saved: Column = zero, digest: Column = text) -> DataFrame:
        columns = {"conv_id": F.col(node), "depth": depth, "parent_conv_id": parent, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digest}
        return df.select(*[c.alias(n) for n, c in columns.items()])

    root_leaf = ((F.col("depth") == 0) & (F.col("n_ends") == F.col("n_convs"))).cast("long")
    parts = part(nodes, parent=F.col("up"), convs=F.col("n_convs"), leaves=root_leaf)
    parts = parts.unionByName(part(nodes.where("depth > 0"), "up", F.col("depth") - 1, children=F.lit(1).cast("long")))
    parts = parts.unionByName(part(sums, leaves=F.col("n_leaves"), saved=F.col("saved")))
    parts = parts.unionByName(part(sums.where("depth = 1"), "up", zero, leaves=F.col("n_leaves"), saved=F.col("saved")))
    ends = sizes.select("conv_id", F.col("size").alias("depth")).join(steps.select("conv_id", "depth", "node"), ["conv_id", "depth"])
    parts = parts.unionByName(part(end_digests(ends), digest=F.col("sha256")))
    total = lambda c: F.sum(c).alias(c)
    out = parts.groupBy("conv_id", "depth").agg(F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return prefix_trie(tables.read(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT)"
_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
heads AS (
  SELECT s.conv_id, s.conv_id - s.conv_id % 100 AS base, s.n, s.h, least(s.h, coalesce(b.n, 0)) AS taken
  FROM (SELECT *, {_CRC} % 6 AS h FROM sizes) s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 100
), r AS (
  SELECT h.conv_id, t.i + 1 AS depth, t.role, t.text FROM heads h JOIN t ON t.conv_id = h.base AND t.i < h.taken
  UNION ALL SELECT h.conv_id, h.taken + t.i - h.h + 1, t.role, t.text FROM heads h JOIN t ON t.conv_id = h.conv_id AND t.i >= h.h
), m AS (
  SELECT conv_id, 0 AS depth, '' AS key, 0 AS chars FROM sizes
  UNION ALL SELECT conv_id, depth, sha256(string_agg(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth)), length(text) FROM r
), p AS (
  SELECT *, min(conv_id) OVER g AS node, count(*) OVER g AS n_convs, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM m WINDOW g AS (PARTITION BY depth, key)
), v AS (
  SELECT node, depth, any_value(n_convs) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256, bool_and(ends) AS leaf
  FROM p GROUP BY node, depth
), u AS (SELECT v.*, p.node AS parent FROM v LEFT JOIN p ON p.conv_id = v.node AND p.depth = v.depth - 1),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM u WHERE depth > 0 GROUP BY ALL),
sums AS (SELECT p.node, p.depth, sum(CAST(u.leaf AS INTEGER)) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved FROM u JOIN p ON p.conv_id = u.node AND p.depth <= u.depth GROUP BY ALL)
SELECT u.node AS conv_id, u.depth, u.parent AS parent_conv_id, u.n_convs, coalesce(k.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, u.ends_sha256
FROM u JOIN sums s ON s.node = u.node AND s.depth = u.depth LEFT JOIN kids k ON k.parent = u.node AND k.depth = u.depth
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_prefix_trie": op12_prefix_trie}
SQL: dict[str, str] = {"op12_prefix_trie": _SQL}
