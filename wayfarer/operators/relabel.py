"""Intents by how often a user visits a place: ranks of cells or clusters, then new labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_METRES, cell_floor, haversine
from ..functions.graph import BROADCAST_ROWS, components
from ..sources.readers import counted, stored
from .anchors import intent

#: Distinct places of a user that one task links; about 100 bytes each.
MOST_PLACES = 100_000


def rank_cells(stays: DataFrame, degrees: float = 0.001) -> DataFrame:
    """The two most visited degree cells of each user with visits and mean coordinates; a user's only cell is both."""
    cells = stays.groupBy("user_id", cell_floor("lng", degrees).alias("cx"), cell_floor("lat", degrees).alias("cy")).agg(F.count("*").alias("n"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.min(F.struct("date", "start_min", "seq")).alias("seen"))
    top = cells.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "seen"))).where("r <= 2")
    return _two(top, ["cx", "cy", "n", "lng", "lat"])


def _two(top: DataFrame, cols: list[str]) -> DataFrame:
    """One row per user; the second falls back to the first."""
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    first = [pick(c, 1).alias(f"p_{c}") for c in cols]
    second = [F.coalesce(pick(c, 2), pick(c, 1)).alias(f"s_{c}") for c in cols]
    return top.groupBy("user_id").agg(*first, *second)


def eps_components(lng: np.ndarray, lat: np.ndarray, metres: float) -> np.ndarray:
    """Labels of the graph that joins points within ``metres``, in order of first point.

    Points of a box whose diagonal is shorter are linked at once. Boxes near enough to hold a link are then
    joined by their first points, and only those still apart compare all their points.
    """
    if not len(lng):
        return np.zeros(0, int)
    degree = np.radians(1) * 6371000.0
    side = 0.999 * metres / np.sqrt(2) / degree
    y, x = np.floor(lat / side).astype(np.int64), np.floor(lng / side).astype(np.int64)
    reach = 1.001 * metres / degree
    wide = int(np.ceil(reach / side / max(0.01, float(np.cos(np.radians(np.abs(lat).max() + reach))))))
    width = int(np.ptp(x)) + 2 * wide + 1
    keys, first, box, size = np.unique((y - y.min()) * width + x - x.min() + wide, return_index=True, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(box, kind="stable"), np.cumsum(size)[:-1])
    up = list(range(len(keys)))

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = np.radians(lat[a]), np.radians(lat[b])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lng[b] - lng[a]) / 2) ** 2
        return 2 * 6371000.0 * np.arcsin(np.minimum(1, np.sqrt(h)))

    def near(a: np.ndarray, b: np.ndarray) -> bool:
        rows = max(1, 65_536 // len(b))
        return any((distance(a[at : at + rows, None], b[None]) <= metres).any() for at in range(0, len(a), rows))

    # Offsets to boxes that hold a link; in rows, less than three boxes off.
    offsets = sorted(((dy, dx) for dy in (0, 1, 2) for dx in range(-wide, wide + 1) if (dy, dx) > (0, 0)), key=lambda o: o[0] ** 2 + o[1] ** 2)
    for dy, dx in offsets:
        want = keys + dy * width + dx
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        a = np.flatnonzero(keys[at] == want)
        b = at[a]
        sure = distance(first[a], first[b]) <= metres
        for i, j, linked in zip(a.tolist(), b.tolist(), sure.tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q and (linked or near(members[i], members[j])):
                up[max(p, q)] = min(p, q)
    roots = np.array([find(i) for i in range(len(keys))])[box]
    _, start, label = np.unique(roots, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(start))[label]


def rank_clusters(stays: DataFrame, metres: float = 300.0, most: int = MOST_PLACES) -> DataFrame:
    """The two largest clusters of each user: components of the graph of places within ``metres``, visits counted.

    Only distinct coordinates of a user with their visits count. Users of up to ``most`` of them are one group each; the
    places of others are linked across tasks (``far_clusters``), with the same result.
    """
    places = stays.groupBy("user_id", "lng", "lat").agg(F.count("*").alias("n"), F.min(F.struct("date", "start_min", "seq")).alias("seen"))
    places = stored(places.select("user_id", "lng", "lat", "n", F.struct(F.unix_date(F.col("seen.date").cast("date")).alias("d"), F.col("seen.start_min").alias("m"), F.col("seen.seq").alias("s")).alias("seen")))
    large, n = counted(places.groupBy("user_id").count().where(F.col("count") > most).select("user_id"))
    found = near_clusters(places if not n else places.join(large, "user_id", "left_anti"), metres)
    if n:
        # Users with so many places are few; their rows are spread by place, whatever the user.
        found = found.unionByName(far_clusters(places.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "user_id"), metres))
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "seen"))).where("r <= 2")
    return _two(top, ["n", "lng", "lat"])


def near_clusters(places: DataFrame, metres: float) -> DataFrame:
    """``(user_id, n, lng, lat, seen)`` of the clusters of ``places(user_id, lng, lat, n, seen)``, each user a group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d", "m", "s"], kind="stable")
        lng, lat, n = (pdf[c].to_numpy() for c in ("lng", "lat", "n"))
        label = eps_components(lng, lat, metres)
        visits, first = np.bincount(label, n), np.unique(label, return_index=True)[1]
        return pd.DataFrame({"user_id": key[0], "n": visits.astype(np.int64), "lng": np.bincount(label, lng * n) / visits, "lat": np.bincount(label, lat * n) / visits, **{c: pdf[c].to_numpy()[first] for c in "dms"}})

    # Few bytes but much work: as many tasks as set, not as few as the bytes would fill.
    spread = places.select("user_id", "lng", "lat", "n", "seen.*").repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")
    kinds = {f.name: f.dataType.simpleString() for f in places.schema["seen"].dataType}
    found = spread.groupBy("user_id").applyInPandas(run, f"user_id string, n long, lng double, lat double, d {kinds['d']}, m {kinds['m']}, s {kinds['s']}")
    return found.select("user_id", "n", "lng", "lat", F.struct("d", "m", "s").alias("seen"))


def far_clusters(places: DataFrame, metres: float) -> DataFrame:
    """``near_clusters`` for users of any number of places: no user is a group.

    Places of a box whose diagonal is shorter than ``metres`` are linked at once. Boxes near enough to hold a link meet by their
    places in the grid; those whose first places are near are linked, and components of these are formed. Only
    boxes that are still apart then compare the places that lie near the other box, and what they link is joined once more.
    """
    degree = math.radians(1) * 6371000.0
    side, reach = 0.999 * metres / math.sqrt(2) / degree, 1.001 * metres / degree
    cell = lambda c: F.floor(F.col(c) / F.lit(side))
    rows = places.withColumn("y", cell("lat")).withColumn("x", cell("lng"))
    boxes = rows.groupBy("user_id", "y", "x").agg(
        F.sum("n").alias("n"), F.sum(F.col("lng") * F.col("n")).alias("sx"), F.sum(F.col("lat") * F.col("n")).alias("sy"), F.min("seen").alias("seen"), F.min(F.struct("lng", "lat")).alias("one"),
        *[f(c).alias(f"{k}_{c}") for c in ("lng", "lat") for k, f in (("lo", F.min), ("hi", F.max))],
    )
    boxes = stored(boxes.withColumn("id", F.monotonically_increasing_id()))
    # Offsets to boxes that may hold a link: up to two rows on, and as many columns as the reach has where the row is narrowest.
    wide = F.ceil(F.lit(reach / side) / F.greatest(F.lit(0.01), F.cos(F.radians((F.abs(F.col("y")) + 3) * side + reach))))
    there = boxes.select("user_id", F.col("id").alias("b"), "y", "x", *[F.col(c).alias(f"b_{c}") for c in ("one", "lo_lng", "hi_lng", "lo_lat", "hi_lat")])
    here = boxes.select("user_id", F.col("id").alias("a"), F.col("y").alias("a_y"), F.col("x").alias("a_x"), wide.alias("wide"), *[F.col(c).alias(f"a_{c}") for c in ("one", "lo_lng", "hi_lng", "lo_lat", "hi_lat")])
    here = here.withColumn("dy", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 1, 2)]))).withColumn("dx", F.explode(F.sequence(F.when(F.col("dy") == 0, F.lit(1)).otherwise(-F.col("wide")).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("wide")))))
    pairs = here.withColumn("y", F.col("a_y") + F.col("dy")).withColumn("x", F.col("a_x") + F.col("dx")).join(there, ["user_id", "y", "x"])
    near = haversine("a_one.lat", "a_one.lng", "b_one.lat", "b_one.lng", R_METRES) <= metres
    pairs = stored(pairs.select("user_id", "a", "b", near.alias("near"), *[f"{s}_{k}_{c}" for s in "ab" for k in ("lo", "hi") for c in ("lng", "lat")]))
    first = stored(components(pairs.where("near").select("a", "b")))
    of = lambda key: first.select(F.col("id").alias(key), F.col("component").alias(f"{key}_root"))
    apart = pairs.where("NOT near").join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"a_root": F.coalesce("a_root", "a"), "b_root": F.coalesce("b_root", "b")}).where("a_root != b_root")
    # Of the places of a box, those that the other one's extent is within reach of.
    at = rows.select("user_id", "y", "x", "lng", "lat").join(boxes.select("user_id", "y", "x", "id"), ["user_id", "y", "x"]).select("id", "lng", "lat")
    across = F.lit(reach) / F.greatest(F.lit(0.01), F.cos(F.radians(F.greatest(F.abs("a_hi_lat"), F.abs("b_hi_lat"), F.abs("a_lo_lat"), F.abs("b_lo_lat")) + reach)))

    def close(c: str, s: str) -> Column:
        room = F.lit(reach) if c == "lat" else F.col("across")
        return F.col(c).between(F.col(f"{s}_lo_{c}") - room, F.col(f"{s}_hi_{c}") + room)

    open_ = stored(apart.withColumn("across", across))
    some = lambda own, other: open_.join(at.withColumnRenamed("id", own), own).where(close("lng", other) & close("lat", other)).select("a", "b", "a_root", "b_root", F.col("lng").alias(f"{own}_lng"), F.col("lat").alias(f"{own}_lat"))
    met = some("a", "b").join(some("b", "a").drop("a_root", "b_root"), ["a", "b"]).where(haversine("a_lat", "a_lng", "b_lat", "b_lng", R_METRES) <= metres)
    second = stored(components(met.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()))
    labelled = boxes.join(of("id"), "id", "left").withColumn("id_root", F.coalesce("id_root", "id")).join(second.select(F.col("id").alias("id_root"), "component"), "id_root", "left")
    clusters = labelled.groupBy("user_id", F.coalesce("component", "id_root").alias("label")).agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.min("seen").alias("seen"))
    return clusters.select("user_id", "n", (F.col("sx") / F.col("n")).alias("lng"), (F.col("sy") / F.col("n")).alias("lat"), "seen")


def relabel_by_cell(stays: DataFrame, ranks: DataFrame, degrees: float = 0.001) -> DataFrame:
    """``intent_class`` from equal cells; users without ranks keep theirs."""
    cols = ["p_cx", "p_cy", "s_cx", "s_cy"]
    rows = stays.join(ranks.select("user_id", *cols), "user_id", "left").withColumn("_x", cell_floor("lng", degrees)).withColumn("_y", cell_floor("lat", degrees))
    at = lambda k: (F.col("_x") == F.col(f"{k}_cx")) & (F.col("_y") == F.col(f"{k}_cy"))
    return rows.withColumn("intent_class", F.when(F.col("p_cx").isNull(), F.col("intent_class")).otherwise(intent(at("p"), at("s")))).drop("_x", "_y", *cols)


def relabel_by_distance(stays: DataFrame, ranks: DataFrame, metres: float = 300.0, compat: bool = False) -> DataFrame:
    """``intent_class`` from the distance to the ranked places. ``compat`` takes longitude for latitude."""
    cols = ["p_lng", "p_lat", "s_lng", "s_lat"]
    rows = stays.join(ranks.select("user_id", *cols), "user_id", "left")
    y, x = ("lng", "lat") if compat else ("lat", "lng")
    near = lambda k: haversine(y, x, f"{k}_{y}", f"{k}_{x}", R_METRES) <= metres
    return rows.withColumn("intent_class", F.when(F.col("p_lng").isNull(), F.col("intent_class")).otherwise(intent(near("p"), near("s")))).drop(*cols)


def anchors_from_ranks(ranks: DataFrame) -> DataFrame:
    """``(user_id, t1_lng, t1_lat, t2_lng, t2_lat)``: the two ranked places as home and work."""
    return ranks.select("user_id", F.col("p_lng").alias("t1_lng"), F.col("p_lat").alias("t1_lat"), F.col("s_lng").alias("t2_lng"), F.col("s_lat").alias("t2_lat"))


def label_shares(stays: DataFrame) -> DataFrame:
    """``(label, n, percent)``."""
    total = stays.agg(F.count("*").alias("total"))
    return stays.groupBy(F.col("intent_class").alias("label")).agg(F.count("*").alias("n")).join(F.broadcast(total)).select("label", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))
