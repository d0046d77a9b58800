"""Grid vocabulary of a city: cells that stays occupy, numbered by how often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid_meta(stays: DataFrame, degrees: float = 0.005) -> DataFrame:
    """One row ``(snap_deg, lng_min, lat_min, n_rows, n_cols)``: the box of all stays, snapped outwards."""
    d = F.lit(degrees)
    down = lambda c: F.floor(F.min(c) / d) * d
    up = lambda c: F.ceil(F.max(c) / d) * d
    box = stays.agg(down("lng").alias("lng_min"), down("lat").alias("lat_min"), up("lng").alias("lng_max"), up("lat").alias("lat_max"))
    count = lambda c: F.rint((F.col(f"{c}_max") - F.col(f"{c}_min")) / d).cast("long")
    return box.where("lng_min IS NOT NULL").select(d.alias("snap_deg"), "lng_min", "lat_min", count("lat").alias("n_rows"), count("lng").alias("n_cols"))


def with_city_cell(stays: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds ``city_cell`` (row * columns + column), null outside the box; the far edges belong to the last cells."""
    rows = stays.join(F.broadcast(meta))
    at = lambda c, n: F.least(((F.col(c) - F.col(f"{c}_min")) / F.col("snap_deg")).cast("long"), F.col(n) - 1)
    inside = F.col("lng").between(F.col("lng_min"), F.col("lng_min") + F.col("n_cols") * F.col("snap_deg")) & F.col("lat").between(F.col("lat_min"), F.col("lat_min") + F.col("n_rows") * F.col("snap_deg"))
    return rows.withColumn("city_cell", F.when(inside, at("lat", "n_rows") * F.col("n_cols") + at("lng", "n_cols"))).drop(*meta.columns)


def build_vocab(stays: DataFrame, meta: DataFrame, min_count: int = 1) -> DataFrame:
    """``(cell_id, city_cell, lng, lat, cnt)``: ids by falling count, ties by cell; centres of cells.

    Only the vocabulary itself, far smaller than the stays, is ranked in one window.
    """
    cells = with_city_cell(stays, meta).where("city_cell IS NOT NULL").groupBy("city_cell").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)
    ranked = cells.withColumn("cell_id", (F.row_number().over(Window.orderBy(F.desc("cnt"), "city_cell")) - 1).cast("int")).join(F.broadcast(meta))
    return ranked.select("cell_id", "city_cell", (F.col("lng_min") + (F.col("city_cell") % F.col("n_cols") + 0.5) * F.col("snap_deg")).alias("lng"), (F.col("lat_min") + (F.floor(F.col("city_cell") / F.col("n_cols")) + 0.5) * F.col("snap_deg")).alias("lat"), "cnt")


def with_cell_id(stays: DataFrame, vocab: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds ``cell_id``, -1 outside the box or the vocabulary."""
    known = vocab.select("city_cell", "cell_id")
    return with_city_cell(stays, meta).join(known, "city_cell", "left").withColumn("cell_id", F.coalesce("cell_id", F.lit(-1))).drop("city_cell")
