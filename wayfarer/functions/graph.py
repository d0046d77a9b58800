"""Joins on skewed keys and connected components of links that lie in no single task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.readers import stored

#: Nodes that one task contracts at a time; about 150 bytes each.
MOST_NODES = 500_000
#: Rows that may be broadcast (some 60 bytes each), rows of a key beyond which it is joined apart, tasks of a salted key.
BROADCAST_ROWS, HOT, SALTS = 1_000_000, 500, 16


def attach(rows: DataFrame, table: DataFrame, key: list[str], most: int, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and ``most`` rows at most.

    Within the bound the table is broadcast. Beyond it rows of a key are dealt over several tasks, by a
    hash of their column ``spread``.
    """
    if most <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS))).join(salted, [*key, "_salt"], how).drop("_salt")


def join_skewed(rows: DataFrame, table: DataFrame, key: list[str], n: str, total: int, spread: str) -> DataFrame:
    """``rows`` joined with ``table``, whose column ``n`` says how many of the ``total`` rows share its key.

    Keys of more than HOT rows, of which there can't be more than total / HOT, are attached apart; what is
    left has no key that one task could choke on.
    """
    if total <= HOT:
        return rows.join(table, key)
    hot, most = table.where(F.col(n) > HOT), total // HOT
    marks = hot.select(*key, F.lit(True).alias("_hot"))
    cold = attach(rows, marks, key, most, spread, "left").where("_hot IS NULL").drop("_hot")
    return cold.join(table.where(F.col(n) <= HOT), key).unionByName(attach(rows, hot, key, most, spread))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as rows ``(id, component)``, with the smallest id.

    Every partition first replaces its links by stars around the smallest ids that it can see. Then
    large-star and small-star steps alternate: each is one grouped minimum joined back, so no node's
    neighbours are ever gathered; nodes with many neighbours are joined apart. Each round is written to the
    shared folder; a round that changes nothing ends. Nodes without links don't appear, links of a node to
    itself count for nothing.
    """
    now, mark = _round(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b"))
    for _ in range(max_rounds):
        if not mark[0]:
            break
        now, new = _round(_small_star(_large_star(now, mark[0]), mark[0]))
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Contracts within partitions and stores; returns the stored links and a mark of their set."""
    seen = Observation()
    stars = edges.mapInArrow(_contract, "a long, b long").observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    out = stored(stars)
    return out, (seen.get["n"], seen.get["s"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the links of a partition, with bounded memory: after MOST_NODES nodes they are given out and forgotten."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def stars() -> pa.RecordBatch:
        nodes = [x for x in up if find(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])
        up.clear()
        return out

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > MOST_NODES:
            yield stars()
    yield stars()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour, or to itself if it is smaller."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n")).where("n > 0").select("a", F.least("a", "low").alias("low"), "n")
    return join_skewed(both.where("b > a"), low, ["a"], "n", n, "b").select(F.col("low").alias("a"), "b").where("a != b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Smaller neighbours of a node move to the smallest of them."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"), F.count("*").alias("n"))
    moved = join_skewed(edges, low, ["b"], "n", n, "a").where("a != low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(low.select(F.col("low").alias("a"), "b")).distinct()
