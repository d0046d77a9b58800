"""Trajectories derived from the ``events`` table, so that every job has input that grows with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.readers import wall_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stays(spark: SparkSession, sf_dir: str, jitter: bool = True) -> DataFrame:
    """``(user_id, date, seq, start_min, end_min, lng, lat, t_in, t_out)``, one stay per event.

    Each user moves between a home-like place, a work-like place and others. ``jitter`` spreads a
    place over neighbouring coordinates; without it consecutive stays often share theirs.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    e = e.withColumn("loc", F.expr("CASE WHEN k < 40 THEN (user_id * 37 + 5) % 100 WHEN k < 65 THEN (user_id * 53 + 11) % 100 ELSE (k * 17 + user_id) % 100 END"))
    j5, j3 = ("(event_id % 5) * 300", "(event_id % 3) * 200") if jitter else ("0", "0")
    minute = "hour(ts) * 60 + minute(ts)"
    return e.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.to_date("ts").alias("date"),
        F.col("event_id").alias("seq"),
        F.expr(f"CAST({minute} AS DOUBLE)").alias("start_min"),
        F.expr(f"CAST(least({minute} + floor(value * 3), 1440) AS DOUBLE)").alias("end_min"),
        F.expr(f"CAST(116200000 + (loc % 10) * (loc % 10) * 4000 + {j5} AS DOUBLE) / 1000000").alias("lng"),
        F.expr(f"CAST(39750000 + (loc DIV 10) * (loc DIV 10) * 3000 + {j3} AS DOUBLE) / 1000000").alias("lat"),
        (wall_seconds(F.col("ts")) - 28800).cast("long").alias("t_in"),
        (wall_seconds(F.col("ts")) - 28800 + F.expr("CAST(floor(value * 3) AS BIGINT) * 60")).cast("long").alias("t_out"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(date, day_type)`` of the days that have events: weekends, the first of January, workdays."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    return days.select("date", F.expr("CASE WHEN month(date) = 1 AND day(date) = 1 THEN 'holiday' WHEN dayofweek(date) IN (1, 7) THEN 'weekend' ELSE 'workday' END").alias("day_type"))


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, home struct<lng,lat>, work struct<lng,lat>)``: some users have no work place, some no row."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 11 != 0")

    def place(loc: str) -> str:
        return f"named_struct('lng', CAST(116200000 + ({loc} % 10) * ({loc} % 10) * 4000 AS DOUBLE) / 1000000, 'lat', CAST(39750000 + ({loc} DIV 10) * ({loc} DIV 10) * 3000 AS DOUBLE) / 1000000)"

    home, work = "((user_id * 37 + 5) % 100)", "((user_id * 53 + 11) % 100)"
    return users.select(F.col("user_id").cast("string").alias("user_id"), F.expr(place(home)).alias("home"), F.expr(f"CASE WHEN user_id % 7 != 0 THEN {place(work)} END").alias("work"))


def points(stay_rows: DataFrame) -> DataFrame:
    """``(user_id, ts, lng, lat)``: each stay as points a minute apart, in one place."""
    n = F.floor((F.col("t_out") - F.col("t_in")) / 300).cast("int")
    return stay_rows.select("user_id", "lng", "lat", F.explode(F.sequence(F.lit(0), n)).alias("i"), "t_in", "seq").select("user_id", (F.col("t_in") + F.col("i") * 60).cast("double").alias("ts"), (F.col("lng") + (F.col("i") % 3) * 1e-5).alias("lng"), "lat", "seq")


# The same fixtures in SQL, for the queries' oracles.

STAYS_SQL = """stays AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS date, event_id AS seq,
    CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS start_min, CAST(least(hour(ts) * 60 + minute(ts) + floor(value * 3), 1440) AS DOUBLE) AS end_min,
    CAST(116200000 + (loc % 10) * (loc % 10) * 4000 + (event_id % 5) * 300 AS DOUBLE) / 1000000 AS lng,
    CAST(39750000 + (loc // 10) * (loc // 10) * 3000 + (event_id % 3) * 200 AS DOUBLE) / 1000000 AS lat,
    CAST(floor(epoch(ts)) AS BIGINT) - 28800 AS t_in, CAST(floor(epoch(ts)) AS BIGINT) - 28800 + CAST(floor(value * 3) AS BIGINT) * 60 AS t_out
  FROM (SELECT *, CASE WHEN k < 40 THEN (user_id * 37 + 5) % 100 WHEN k < 65 THEN (user_id * 53 + 11) % 100 ELSE (k * 17 + user_id) % 100 END AS loc
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)))"""

CALENDAR_SQL = """calendar AS (
  SELECT date, CASE WHEN month(date) = 1 AND day(date) = 1 THEN 'holiday' WHEN dayofweek(date) IN (0, 6) THEN 'weekend' ELSE 'workday' END AS day_type
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events))"""

HINTS_SQL = """hints AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id,
    CAST(116200000 + (h % 10) * (h % 10) * 4000 AS DOUBLE) / 1000000 AS home_lng, CAST(39750000 + (h // 10) * (h // 10) * 3000 AS DOUBLE) / 1000000 AS home_lat,
    CASE WHEN user_id % 7 != 0 THEN CAST(116200000 + (w % 10) * (w % 10) * 4000 AS DOUBLE) / 1000000 END AS work_lng,
    CASE WHEN user_id % 7 != 0 THEN CAST(39750000 + (w // 10) * (w // 10) * 3000 AS DOUBLE) / 1000000 END AS work_lat
  FROM (SELECT DISTINCT user_id, (user_id * 37 + 5) % 100 AS h, (user_id * 53 + 11) % 100 AS w FROM events WHERE user_id % 11 != 0))"""


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str, radius: float = 6371.0) -> str:
    up, across = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lng2} - {lng1}) / 2)"
    a = f"({up} * {up} + cos(radians({lat1})) * cos(radians({lat2})) * {across} * {across})"
    return f"({2 * radius} * asin(CASE WHEN {a} > 1 THEN 1 ELSE sqrt({a}) END))"
