"""Home and work of users, intents of stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_METRES, cell_floor, cell_round, haversine


def detect_home_work(raw: DataFrame, degrees: float = 0.005) -> DataFrame:
    """Anchors by time spent in cells: ``raw(user_id, seq, lng, lat, t_in, t_out)``.

    Home is the cell with most time in stays that start from 22 to 6 h, or most time at all without such;
    work the one with most time from 9 to 17 h apart from home, or most time at all apart from home. Ties
    go to the cell seen first. Coordinates are means of the cell's stays. Users without a second cell go.
    """
    hour = F.floor(F.pmod(F.col("t_in").cast("long") + 28800, F.lit(86400)) / 3600)
    long = F.col("t_out") - F.col("t_in")
    cells = raw.groupBy("user_id", cell_round("lng", degrees).alias("cx"), cell_round("lat", degrees).alias("cy")).agg(
        F.sum(long).alias("total"),
        F.sum(F.when((hour >= 22) | (hour < 6), long).otherwise(0)).alias("night"),
        F.sum(F.when((hour >= 9) & (hour < 17), long).otherwise(0)).alias("day"),
        F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.min(F.struct("t_in", "seq")).alias("seen"),
    )

    def best(df: DataFrame, first: str) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy((F.col(first) > 0).desc(), F.when(F.col(first) > 0, F.col(first)).otherwise(F.col("total")).desc(), "seen")
        return df.withColumn("_r", F.row_number().over(w)).where("_r = 1")

    home = best(cells, "night").select("user_id", F.col("cx").alias("hx"), F.col("cy").alias("hy"), F.col("lng").alias("t1_lng"), F.col("lat").alias("t1_lat"))
    other = cells.join(home.select("user_id", "hx", "hy"), "user_id").where("NOT (cx = hx AND cy = hy)")
    work = best(other, "day").select("user_id", F.col("lng").alias("t2_lng"), F.col("lat").alias("t2_lat"))
    return home.join(work, "user_id").select("user_id", "t1_lng", "t1_lat", "t2_lng", "t2_lat")


def anchors_from_hints(stays: DataFrame, hints: DataFrame, degrees: float = 0.001) -> DataFrame:
    """Anchors of the users of ``stays`` that have a home hint, with their cells; work may be null."""
    users = stays.select("user_id").distinct()
    rows = users.join(hints.where("home IS NOT NULL"), "user_id")
    cell = lambda p, k: cell_floor(F.col(f"{p}.{k}"), degrees)
    return rows.select("user_id", F.col("home.lng").alias("t1_lng"), F.col("home.lat").alias("t1_lat"), F.col("work.lng").alias("t2_lng"), F.col("work.lat").alias("t2_lat"), cell("home", "lng").alias("t1_cx"), cell("home", "lat").alias("t1_cy"), cell("work", "lng").alias("t2_cx"), cell("work", "lat").alias("t2_cy"))


def frequent_cells(celled: DataFrame) -> DataFrame:
    """``(user_id, home_cell, work_cell)``: the commonest known cell from 20 to 8 h, and from 8 to 18 h apart from home.

    ``celled(user_id, date, start_min, seq, cell_id)``, -1 for unknown cells. Ties go to the cell seen first.
    """
    hour = F.pmod(F.floor(F.col("start_min") / 60), F.lit(24))
    period = F.when((hour >= 20) | (hour < 8), "night").when(hour < 18, "day")
    counts = celled.where("cell_id >= 0").withColumn("period", period).where("period IS NOT NULL").groupBy("user_id", "period", "cell_id").agg(F.count("*").alias("n"), F.min(F.struct("date", "start_min", "seq")).alias("seen"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "seen")
    home = counts.where("period = 'night'").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("user_id", F.col("cell_id").alias("home_cell"))
    users = celled.select("user_id").distinct().join(home, "user_id", "left")
    rest = counts.where("period = 'day'").join(home, "user_id", "left").where("home_cell IS NULL OR cell_id != home_cell")
    work = rest.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("user_id", F.col("cell_id").alias("work_cell"))
    return users.join(work, "user_id", "left")


def intent(at_home: Column, at_work: Column) -> Column:
    return F.when(F.coalesce(at_home, F.lit(False)), "t1").when(F.coalesce(at_work, F.lit(False)), "t2").otherwise("other")


def intent_by_distance(stays: DataFrame, anchors: DataFrame, metres: float = 1000.0) -> DataFrame:
    """Adds ``intent_class``: near home, else near work, else other."""
    rows = stays.join(anchors.select("user_id", "t1_lng", "t1_lat", "t2_lng", "t2_lat"), "user_id")
    near = lambda k: haversine("lat", "lng", f"{k}_lat", f"{k}_lng", R_METRES) <= metres
    return rows.withColumn("intent_class", intent(near("t1"), near("t2"))).drop("t1_lng", "t1_lat", "t2_lng", "t2_lat")


def intent_by_cell(stays: DataFrame, anchors: DataFrame, degrees: float = 0.001) -> DataFrame:
    """Adds ``intent_class`` by equal degree cells; a missing work cell never matches."""
    cells = ["t1_cx", "t1_cy", "t2_cx", "t2_cy"]
    rows = stays.join(anchors.select("user_id", *cells), "user_id").withColumn("_x", cell_floor("lng", degrees)).withColumn("_y", cell_floor("lat", degrees))
    at = lambda k: (F.col("_x") == F.col(f"{k}_cx")) & (F.col("_y") == F.col(f"{k}_cy"))
    return rows.withColumn("intent_class", intent(at("t1"), at("t2"))).drop("_x", "_y", *cells)
