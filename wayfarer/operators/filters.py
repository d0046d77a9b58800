"""Which users, days and stays stay. Every filter keeps columns and is a semi-join or a predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_KM, R_METRES, haversine
from ..functions.hashing import draw

#: The box around the city and the thresholds in use.
BOX = (115.4, 117.5, 39.4, 41.1)
FAR_KM, LEAST_STAYS, MAX_STEP_KM, LEAST_SPAN_MIN = 2000.0, 2, 50.0, 240.0


def home_in_box(stays: DataFrame, anchors: DataFrame, box: tuple[float, float, float, float] = BOX) -> DataFrame:
    """Stays of users whose home lies in the box, edges included. Null ``box`` edges don't occur."""
    inside = anchors.where(F.col("t1_lng").between(box[0], box[1]) & F.col("t1_lat").between(box[2], box[3]))
    return stays.join(inside.select("user_id"), "user_id", "left_semi")


def near_home(stays: DataFrame, anchors: DataFrame, km: float = FAR_KM) -> DataFrame:
    home = anchors.select("user_id", F.col("t1_lng").alias("h_lng"), F.col("t1_lat").alias("h_lat"))
    far = haversine("lat", "lng", "h_lat", "h_lng", R_KM) > km
    return stays.join(home, "user_id").where(~far).drop("h_lng", "h_lat")


def full_days(stays: DataFrame, least: int = LEAST_STAYS) -> DataFrame:
    """User-days with enough stays."""
    n = F.count("*").over(Window.partitionBy("user_id", "date"))
    return stays.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def observed_users(stays: DataFrame, least_days: int) -> DataFrame:
    """Users with enough days."""
    days = stays.select("user_id", "date").distinct().groupBy("user_id").count().where(F.col("count") >= least_days)
    return stays.join(days.select("user_id"), "user_id", "left_semi")


def plausible_steps(stays: DataFrame, max_median_km: float = MAX_STEP_KM) -> DataFrame:
    """Drops users whose exact median step, over all days in time order, is too long. Users without steps stay.

    Whether a median lies beyond a bound is told by counts and by the two values next to the bound, so no
    user's steps are gathered.
    """
    w = Window.partitionBy("user_id").orderBy("date", "start_min", "seq")
    step = haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng", R_METRES) / 1000
    within = F.col("km") <= max_median_km
    sums = stays.select("user_id", step.alias("km")).where("km IS NOT NULL").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(within).alias("short"), F.max(F.when(within, F.col("km"))).alias("low"), F.min(F.when(~within, F.col("km"))).alias("high")
    )
    twice = 2 * F.col("short")
    bad = sums.where((twice < F.col("n")) | ((twice == F.col("n")) & ((F.col("low") + F.col("high")) / 2 > max_median_km)))
    return stays.join(bad, "user_id", "left_anti")


def long_days(stays: DataFrame, least_min: float = LEAST_SPAN_MIN) -> DataFrame:
    """User-days that span enough time from the first start to the end of the stay that starts last."""
    w = Window.partitionBy("user_id", "date")
    span = F.max_by("end_min", F.struct("start_min", "seq")).over(w) - F.min("start_min").over(w)
    return stays.withColumn("_span", span).where(F.col("_span") >= least_min).drop("_span")


def few_stays_a_day(stays: DataFrame, most: int = 20) -> DataFrame:
    """Users who never have more stays than ``most`` in a day."""
    bad = stays.groupBy("user_id", "date").count().where(F.col("count") > most).select("user_id").distinct()
    return stays.join(bad, "user_id", "left_anti")


def sample_users(stays: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """All stays of ``n`` users, the first in the order of their draws: the same users on every run and cluster."""
    users = stays.select("user_id").distinct().orderBy(draw("user_id", seed=seed), "user_id").limit(n)
    return stays.join(users, "user_id", "left_semi")


def with_anchor(stays: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stays of users that have anchors, and the users that have none."""
    known = anchors.select("user_id")
    return stays.join(known, "user_id", "left_semi"), stays.select("user_id").distinct().join(known, "user_id", "left_anti")
