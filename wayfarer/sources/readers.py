"""Readers and writers: GPS text, cell-tower text, home/work hints, daily records, metrics, vocabularies."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..operators.reports import Ledger

UTC8_SECONDS = 28800
#: Lines before the points of a file, and where its path names the user.
GPS_HEADER, _GPS_USER = 6, "([^/]+)/Trajectory/[^/]*$"

STAY = T.StructType([
    T.StructField("start_min", T.DoubleType()),
    T.StructField("end_min", T.DoubleType()),
    T.StructField("coord", T.ArrayType(T.DoubleType())),
    T.StructField("intent_class", T.StringType()),
])
DAILY = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("day_type", T.StringType()), T.StructField("stays", T.ArrayType(STAY))])
POINT = T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])


def read_gps(spark: SparkSession, root: str) -> DataFrame:
    """Points of all ``<root>/<user>/Trajectory/*.plt`` files. Large files are read in splits, line by line."""
    lines = spark.read.text(f"{root}/*/Trajectory/*.plt").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    kept = lines.mapInArrow(_behind_headers, "value string, path string")
    return parse_gps_lines(kept.select(F.regexp_extract("path", _GPS_USER, 1).alias("user_id"), F.rtrim("value").alias("line")))


def _behind_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines without the first GPS_HEADER ones of each file; the lines of a split come one after another."""
    key, left = None, 0
    for batch in batches:
        path, start = batch.column(1).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
        names = batch.column(1)
        keep = np.ones(batch.num_rows, bool)
        edges = (np.flatnonzero((path[1:] != path[:-1]) | (start[1:] != start[:-1])) + 1).tolist()
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if lo == hi:
                continue
            now = (names[lo].as_py(), int(start[lo]))
            if now != key:
                key, left = now, GPS_HEADER if now[1] == 0 else 0
            n = min(left, hi - lo)
            keep[lo : lo + n], left = False, left - n
        yield batch.select([0, 1]).filter(pa.array(keep))


def gps_users(spark: SparkSession, root: str) -> DataFrame:
    """``(user_id)`` of all folders with files of ``read_gps``, whether they hold points or not; no file is opened."""
    files = spark.read.format("binaryFile").load(f"{root}/*/Trajectory/*.plt")
    return files.select(F.regexp_extract("path", _GPS_USER, 1).alias("user_id")).distinct()


def parse_gps(files: DataFrame) -> DataFrame:
    """``parse_gps_lines`` of whole ``files(path, value)``, behind their header lines."""
    lines = files.select(F.regexp_extract("path", _GPS_USER, 1).alias("user_id"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return parse_gps_lines(lines.where(F.col("at") >= GPS_HEADER))


def parse_gps_lines(lines: DataFrame) -> DataFrame:
    """``(user_id, lng, lat, ts)`` of ``lines(user_id, line)`` of comma-separated fields.

    Lines with fewer than seven fields, numbers or times that don't parse and zero coordinates go. Times are UTC+8.
    """
    f = lines.select("user_id", F.split("line", ",").alias("f")).where(F.size("f") >= 7)
    text = F.concat_ws(" ", F.trim(F.col("f")[5]), F.trim(F.col("f")[6]))
    local = F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), text).try_cast("timestamp_ntz")
    out = f.select("user_id", F.col("f")[1].try_cast("double").alias("lng"), F.col("f")[0].try_cast("double").alias("lat"), (wall_seconds(local) - UTC8_SECONDS).cast("double").alias("ts"))
    return out.where("lng != 0 AND lat != 0 AND ts IS NOT NULL")


def wall_seconds(local: Column) -> Column:
    """Seconds since 1970 of a time without a zone, whatever the session's zone is."""
    return F.datediff(F.to_date(local), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def parse_tower(lines: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """``(user_id, seq, lng, lat, t_in, t_out)`` of ``lines(value)``: a user, a tab, then ``[(lng, lat, t_in, t_out), …]``.

    Zero coordinates and stays that don't last go; blank lines and lists that don't parse too. A ``ledger`` counts them.
    """
    rows = lines.where(F.trim("value") != "").select(F.split("value", "\t", 2).alias("f"))
    rows = rows.select(F.trim(F.col("f")[0]).alias("user_id"), F.from_json(F.translate(F.get("f", F.lit(1)), "()", "[]"), "array<array<double>>").alias("stays"))
    out = rows.select("user_id", F.posexplode_outer("stays").alias("seq", "s"))
    out = out.select("user_id", "seq", F.size("s").alias("fields"), *[F.get("s", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate((("lng", "double"), ("lat", "double"), ("t_in", "long"), ("t_out", "long")))])
    usable, nowhere = F.col("fields") == 4, (F.col("lng") == 0) & (F.col("lat") == 0)
    if ledger is not None:
        lasts = F.col("t_in") < F.col("t_out")
        out = ledger.watch(
            out,
            n_lines=F.count_if(F.coalesce(F.col("seq"), F.lit(0)) == 0),
            n_dropped_unparsed=F.count_if(~F.coalesce(usable, F.lit(False))),
            n_dropped_coord=F.count_if(usable & nowhere),
            n_dropped_duration=F.count_if(usable & ~nowhere & ~lasts),
            n_stays_loaded=F.count_if(usable & ~nowhere & lasts),
        )
    return out.where(usable & ~nowhere & (F.col("t_in") < F.col("t_out"))).drop("fields")


def parse_hints(lines: DataFrame) -> DataFrame:
    """``(user_id, home, work)`` of ``lines(value)`` with one dictionary literal each; unusable coordinates become null."""
    json = F.regexp_replace("value", r"\bNone\b", "null")
    row = F.from_json(json, "user_id string, home array<double>, work array<double>", {"allowSingleQuotes": "true"})

    def place(x: Column) -> Column:
        return F.when((F.size(x) == 2) & (F.get(x, F.lit(0)) != 0), F.struct(F.get(x, F.lit(0)).alias("lng"), F.get(x, F.lit(1)).alias("lat")))

    return lines.where(F.trim("value") != "").select(row.alias("r")).where("r.user_id IS NOT NULL").select("r.user_id", place(F.col("r.home")).alias("home"), place(F.col("r.work")).alias("work"))


def to_daily(long: DataFrame) -> DataFrame:
    """Nested daily records of ``long(user_id, date, day_type, seq, start_min, end_min, lng, lat, intent_class)``."""
    stay = F.struct("start_min", "seq", "end_min", "lng", "lat", "intent_class")
    days = long.groupBy("user_id", "date").agg(F.first("day_type").alias("day_type"), F.array_sort(F.collect_list(stay)).alias("s"))
    one = lambda s: F.struct(s["start_min"].alias("start_min"), s["end_min"].alias("end_min"), F.array(s["lng"], s["lat"]).alias("coord"), s["intent_class"].alias("intent_class"))
    return days.select("user_id", "date", "day_type", F.transform("s", one).alias("stays"))


def to_long(daily: DataFrame) -> DataFrame:
    """One row per stay; ``seq`` is its place in the day."""
    rows = daily.select("user_id", "date", "day_type", F.posexplode("stays").alias("seq", "s"))
    return rows.select("user_id", "date", "day_type", "seq", F.col("s.start_min").alias("start_min"), F.col("s.end_min").alias("end_min"), F.col("s.coord")[0].alias("lng"), F.col("s.coord")[1].alias("lat"), F.col("s.intent_class").alias("intent_class"))


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAILY).json(path)


def write_daily(daily: DataFrame, path: str) -> None:
    """JSON lines, one record each."""
    daily.write.mode("overwrite").json(path)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that ``spark.checkpoint.dir`` names, which all executors see.

    Where none is named, a local session gets a temporary one; on a cluster that would be a folder of the
    driver alone, so the job stops.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-wayfarer-")
        spark.conf.set(key, folder)
    return f"{folder.rstrip('/')}/wayfarer-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: the plan behind starts anew, and lost executors
    cost only what came after."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``stored(df)`` and its number of rows, from the same pass."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def forget_stored(spark: SparkSession) -> None:
    """Deletes all steps that this application has stored; for the end of a job, when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Anchors, vocabularies, mixtures, reports and metrics as Parquet."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def load_vocab(vocab: DataFrame, meta: DataFrame) -> DataFrame:
    """A stored vocabulary ``(cell_id, city_cell, cnt)`` with centres computed again from its grid."""
    if "city_cell" not in vocab.columns:
        raise ValueError("a stored vocabulary must carry city_cell")
    v = vocab.select("cell_id", "city_cell", "cnt").join(F.broadcast(meta))
    return v.select("cell_id", "city_cell", (F.col("lng_min") + (F.col("city_cell") % F.col("n_cols") + 0.5) * F.col("snap_deg")).alias("lng"), (F.col("lat_min") + (F.floor(F.col("city_cell") / F.col("n_cols")) + 0.5) * F.col("snap_deg")).alias("lat"), "cnt")


# -- shapes of trajectories to compare -------------------------------------------------------------


def shape_of(df: DataFrame) -> str:
    """The shape of ``df(traj_id, points)`` by the type of its points; lists of text are told apart row by row."""
    element = df.schema["points"].dataType.elementType
    if not isinstance(element, T.StructType):
        return "list"
    if "start_min" in element.names:
        return "stay"
    return "slot" if {"t_i", "l_i"} <= set(element.names) else "named"


def normalise_points(df: DataFrame, shape: str | None, side: str) -> DataFrame:
    """``pts`` rows of trajectories ``df(traj_id, points)`` in one of the declared shapes, or in that of their type.

    ``stay``: struct(start_min, end_min, coord or coord_snapped, intent_semantic or intent_class);
    ``slot``: struct(t_i, l_i array<lng, lat>, o_i); ``named``: struct(lat or latitude; lng, lon or longitude;
    time, t_start or t_i; category, activity or intent). These may have t_end and poi_id as well.
    ``span``: array<string> of t0, t1, name, id, lon, lat; ``visit``: array<string> of t, poi, lat, lng;
    ``list``: either, by length. Times above 1.5 are slots of ten minutes.
    Points without a valid coordinate and trajectories without points go.
    """
    shape = shape or shape_of(df)
    if shape == "list":
        size = lambda keep: df.withColumn("points", F.filter("points", keep))
        return normalise_points(size(lambda p: F.size(p) >= 6), "span", side).unionByName(normalise_points(size(lambda p: F.size(p) < 6), "visit", side))
    rows = df.select("traj_id", F.posexplode("points").alias("seq", "p"))
    element = df.schema["points"].dataType.elementType
    names = set(element.names) if isinstance(element, T.StructType) else set()
    num = lambda i: F.get("p", F.lit(i)).try_cast("double")
    slot = lambda t: F.when(t > 1.5, t / 144).otherwise(t)
    none = F.lit("")

    def field(*aliases: str, other: Column) -> Column:
        """The first of the fields that the points have, else ``other``."""
        return F.coalesce(*[F.col(f"p.{a}") for a in aliases if a in names], other)

    def number(*aliases: str, other: Column) -> Column:
        return F.coalesce(*[F.col(f"p.{a}").cast("double") for a in aliases if a in names], other)

    poi = field("poi_id", other=none)
    if shape == "stay":
        start = F.col("p.start_min")
        at = field("coord", "coord_snapped", other=F.lit(None))
        cols = (start / 1440, number("end_min", other=start) / 1440, F.get(at, F.lit(1)), F.get(at, F.lit(0)), field("intent_semantic", "intent_class", other=none), poi)
    elif shape == "slot":
        t = F.col("p.t_i").cast("double")
        cols = (slot(t), slot(number("t_end", other=t)), F.get("p.l_i", F.lit(1)), F.get("p.l_i", F.lit(0)), field("o_i", other=none), poi)
    elif shape == "named":
        zero = F.lit(0.0)
        t = number("time", "t_start", "t_i", other=zero)
        cols = (slot(t), slot(number("t_end", other=t)), number("lat", "latitude", other=zero), number("lng", "lon", "longitude", other=zero), field("category", "activity", "intent", other=none), poi)
    elif shape == "span":
        cols = (slot(num(0)), slot(num(1)), num(5), num(4), F.get("p", F.lit(2)), F.get("p", F.lit(3)))
    elif shape == "visit":
        cols = (slot(num(0)), slot(num(0)), num(2), num(3), none, F.get("p", F.lit(1)))
    else:
        raise ValueError(f"unknown shape {shape!r}")
    out = ("t_start", "t_end", "lat", "lng", "category", "poi_id")
    out = rows.select(F.lit(side).alias("side"), "traj_id", "seq", *[c.alias(n) for c, n in zip(cols, out, strict=True)])
    return out.where(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
