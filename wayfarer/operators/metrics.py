"""Fidelity of simulated trajectories: distributions of both sides, binned alike and compared.

``pts(side, traj_id, seq, t_start, t_end, lat, lng, ...)`` with sides ``real`` and ``sim``; points keep their
order. All distributional scores share three aggregations: features, ranges, bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_KM_MEAN, haversine, metric_centre_lat, metric_centre_lng, metric_column, metric_row
from ..functions.graph import join_skewed
from ..sources.readers import counted, stored
from .nearest import TILE, nearest_places, pack_tiles
from .scales import BANDS, band

BINS, SMOOTH = 100, 1e-9
#: Metrics whose bins are spaced by logarithm; the others' are even from zero.
LOGARITHMIC = ("SD", "RG", "DTD")
LINEAR = ("SI", "STAY", "DUL", "VIS", "IRANK")


def coarse(pts: DataFrame, metres: float = 500.0, slots: int = 48) -> DataFrame:
    """Points moved to the centres of metric cells and the lower ends of time slots."""
    snap = lambda t: F.when(F.isnan(t) | (F.abs(t) == math.inf), F.col(t)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.9999), F.col(t))) * slots) / slots)
    return pts.withColumns({"t_start": snap("t_start"), "t_end": snap("t_end"), "lat": metric_centre_lat("lat", metres), "lng": metric_centre_lng("lat", "lng", metres)})


def snap_to_known(pts: DataFrame, known: DataFrame, places_equal: int | None = None, tile: int = TILE) -> DataFrame:
    """Moves points to the nearest location of ``known(lat, lng)`` by distance in degrees; ties to the smaller
    location. With ``places_equal``, squares that agree to so many places are ties too. Points without a place go.

    Distinct coordinates search a packed index of the locations (``nearest``), once; points then meet their answers, those of
    popular coordinates dealt over several tasks.
    """
    locations, n = counted(known.select(F.col("lat").cast("double").alias("k_lat"), F.col("lng").cast("double").alias("k_lng")).where("k_lat IS NOT NULL AND k_lng IS NOT NULL").distinct())
    spots = stored(pts.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy("lat", "lng").agg(F.count("*").alias("n")))
    total = spots.agg(F.sum("n")).first()[0] or 0
    d2 = (F.col("lat") - F.col("k_lat")) * (F.col("lat") - F.col("k_lat")) + (F.col("lng") - F.col("k_lng")) * (F.col("lng") - F.col("k_lng"))
    best = F.min(F.struct((d2 if places_equal is None else F.round(d2, places_equal)).alias("d2"), F.col("k_lat"), F.col("k_lng"))).alias("b")
    found = nearest_places(spots, pack_tiles(locations, n, tile), 0.0 if places_equal is None else 2 * 10.0**-places_equal)
    settled = stored(found.groupBy("lat", "lng").agg(F.max("n").alias("_n"), best)).select("lat", "lng", "_n", "b.k_lat", "b.k_lng")
    spread = next(c for c in pts.columns if c not in ("lat", "lng")) if len(pts.columns) > 2 else "lat"
    return join_skewed(pts, settled, ["lat", "lng"], "_n", total, spread).withColumns({"lat": F.col("k_lat"), "lng": F.col("k_lng")}).drop("k_lat", "k_lng", "_n")


def steps(pts: DataFrame) -> DataFrame:
    """``pts`` with ``km`` and ``gap_s`` since the point before in its trajectory."""
    w = Window.partitionBy("side", "traj_id").orderBy("seq")
    gap = F.col("t_start") - F.lag("t_start").over(w)
    return pts.withColumn("km", haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng", R_KM_MEAN)).withColumn("gap_s", F.when(gap < 0, gap + 1).otherwise(gap) * 86400)


def round3(c: str) -> Column:
    """Three decimals, ties to even."""
    return F.rint(F.col(c) * 1000) / 1000


def features(pts: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """``(side, metric, value)`` of all distributional metrics, or of those asked for; the others aren't computed."""
    moved, w = steps(pts), Window.partitionBy("side", "traj_id")
    long = (F.col("t_end") - F.col("t_start")) * 24 * 60
    of_points = {"SD": F.col("km"), "SI": F.col("gap_s"), "STAY": F.when(long > 1.0, long)}
    of_trajectories = {
        "RG": F.sqrt(F.avg(haversine("lat", "lng", "c_lat", "c_lng", R_KM_MEAN))),
        "DTD": F.when(F.count("*") >= 2, F.sum("km")),
        "DUL": F.countDistinct(F.struct(round3("lat"), round3("lng"))).cast("double"),
    }
    of_places = {
        "VIS": F.when((F.count("*") >= 3) & (F.sum("n") >= 3), -F.regr_slope(F.log("n"), F.log("k"))),
        "IRANK": F.when(F.sum("n") >= 2, F.sum(F.when(F.col("k") <= 3, F.col("n")).otherwise(0)) / F.sum("n")),
    }
    wanted = lambda d: {m: c for m, c in d.items() if only is None or m in only}

    def unpivot(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in cols.items()]))
        return df.select("side", each.alias("f")).select("side", "f.metric", "f.value")

    parts = []
    if cols := wanted(of_points):
        parts.append(unpivot(moved, cols))
    if cols := wanted(of_trajectories):
        per = moved.withColumn("c_lat", F.avg("lat").over(w)).withColumn("c_lng", F.avg("lng").over(w)).groupBy("side", "traj_id").agg(*[c.alias(m) for m, c in cols.items()])
        parts.append(unpivot(per, {m: F.col(m) for m in cols}))
    if cols := wanted(of_places):
        cells = pts.groupBy("side", "traj_id", metric_row("lat").alias("row"), metric_column("lat", "lng").alias("col")).agg(F.count("*").alias("n"))
        places = cells.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "row", "col"))).groupBy("side", "traj_id").agg(*[c.alias(m) for m, c in cols.items()])
        parts.append(unpivot(places, {m: F.col(m) for m in cols}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")


def histogram(values: DataFrame, logarithmic: Column, keys: list[str]) -> DataFrame:
    """``(*keys, bin, real, sim, ...)`` of ``values(*keys, side, value)``: a hundred bins over the range of both sides.

    Logarithmic ones run from just under the least positive value to just over the greatest; even ones from
    zero to the greatest, which belongs to the last bin. A key has no bins if its range is empty or a side is.
    """
    usable = values.withColumn("logarithmic", logarithmic).where((F.col("logarithmic") & (F.col("value") > 0)) | (~F.col("logarithmic") & (F.col("value") >= 0)))
    ends = usable.groupBy(*keys, "logarithmic").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("side") == "real").alias("n_real"), F.count_if(F.col("side") == "sim").alias("n_sim"))
    rows = usable.join(F.broadcast(ends), [*keys, "logarithmic"])
    a, b = F.log10(F.col("lo") * 0.99), F.log10(F.col("hi") * 1.01)
    log_bin = F.floor((F.log10("value") - a) / ((b - a) / BINS))
    width = F.col("hi") / BINS
    guess = F.floor(F.col("value") / width)
    even = guess + F.when(F.col("value") >= (guess + 1) * width, 1).when(F.col("value") < guess * width, -1).otherwise(0)
    number = F.greatest(F.lit(0), F.least(F.when(F.col("logarithmic"), log_bin).otherwise(even), F.lit(BINS - 1))).cast("int")
    usable_range = (F.col("n_real") > 0) & (F.col("n_sim") > 0) & F.when(F.col("logarithmic"), F.col("hi") > F.col("lo")).otherwise(F.col("hi") > 0)
    counts = rows.where(usable_range).groupBy(*keys, number.alias("bin")).agg(F.count_if(F.col("side") == "real").alias("real"), F.count_if(F.col("side") == "sim").alias("sim"))
    return counts, ends


def jsd(p: Column, q: Column) -> Column:
    """The terms of the divergence of two normalised bins."""
    m = (p + q) / 2
    return 0.5 * p * F.log(p / m) + 0.5 * q * F.log(q / m)


def divergences(values: DataFrame, logarithmic: Column, keys: list[str]) -> DataFrame:
    """``(*keys, jsd)``: NaN if a side is empty, 0 if there is only one value."""
    counts, ends = histogram(values, logarithmic, keys)
    total = lambda n: F.col(n) + SMOOTH * BINS
    rows = counts.join(F.broadcast(ends), keys)
    p, q = (F.col("real") + SMOOTH) / total("n_real"), (F.col("sim") + SMOOTH) / total("n_sim")
    p0, q0 = F.lit(SMOOTH) / total("n_real"), F.lit(SMOOTH) / total("n_sim")
    sums = rows.groupBy(*keys).agg(F.sum(jsd(p, q)).alias("s"), F.count("*").alias("bins"), F.first(jsd(p0, q0)).alias("empty"))
    out = ends.join(F.broadcast(sums), keys, "left")
    score = F.greatest(F.lit(0.0), F.least(F.lit(math.log(2)), F.coalesce(F.col("s") + (BINS - F.col("bins")) * F.col("empty"), F.lit(0.0))))
    return out.select(*keys, F.when((F.col("n_real") == 0) | (F.col("n_sim") == 0), float("nan")).otherwise(score).alias("jsd"))


def metric_divergences(values: DataFrame) -> DataFrame:
    """``(metric, jsd)`` of ``features``."""
    return divergences(values, F.col("metric").isin(*LOGARITHMIC), ["metric"])


def metric_moments(values: DataFrame) -> DataFrame:
    """``(side, metric, n, mean, std)``; the deviation is that of a population."""
    return values.groupBy("side", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def histogram_table(values: DataFrame) -> DataFrame:
    """``(metric, bin, low, real, sim)`` with every bin and its left edge: the data behind bar charts."""
    counts, ends = histogram(values, F.col("metric").isin(*LOGARITHMIC), ["metric"])
    grid = ends.where("n_real > 0 AND n_sim > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    a, b = F.log10(F.col("lo") * 0.99), F.log10(F.col("hi") * 1.01)
    low = F.when(F.col("logarithmic"), F.pow(F.lit(10.0), a + F.col("bin") * (b - a) / BINS)).otherwise(F.col("bin") * F.col("hi") / BINS)
    rows = grid.join(counts, ["metric", "bin"], "left")
    return rows.select("metric", "bin", low.alias("low"), F.coalesce("real", F.lit(0)).alias("real"), F.coalesce("sim", F.lit(0)).alias("sim"))


def band_statistics(km: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """``(side, band, n, fraction, mean_km)`` of positive distances ``km(side, km)``; empty bands appear too."""
    rows = km.where("km > 0").withColumn("band", band(F.col("km"), bands))
    n = rows.groupBy("side", "band").agg(F.count("*").alias("n"), F.avg("km").alias("mean_km"))
    total = rows.groupBy("side").agg(F.count("*").alias("total"))
    grid = total.withColumn("band", F.explode(F.array(*[F.lit(b[0]) for b in bands])))
    out = grid.join(n, ["side", "band"], "left")
    return out.select("side", "band", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"), "mean_km")


def scale_profile(km: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """``(item, jsd, n_real, n_sim, weight)``: the divergence of band shares (``SFP``), of each band's own
    distances where both sides have five, and the weighted composite."""
    rows = km.where("km > 0").withColumn("band", band(F.col("km"), bands))
    stats = band_statistics(km, bands).groupBy("band").pivot("side", ["real", "sim"]).agg(F.first("n").alias("n"), F.first("fraction").alias("f"))
    stats = stats.select("band", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("real_n", "real_f", "sim_n", "sim_f")])
    total = stats.agg(F.sum("real_n").alias("r"), F.sum("sim_n").alias("s"))
    k = len(bands)
    share = lambda n, t: (F.col(n) + SMOOTH) / (F.col(t) + SMOOTH * k)
    sfp = stats.join(F.broadcast(total)).agg(F.sum(jsd(share("real_n", "r"), share("sim_n", "s"))).alias("sfp"), F.first("r").alias("n_real"), F.first("s").alias("n_sim"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(math.log(2)), c))
    sfp = sfp.select(clip(F.col("sfp")).alias("sfp"), "n_real", "n_sim")
    inside = divergences(rows.select("band", "side", F.col("km").alias("value")), F.lit(True), ["band"])
    per = stats.join(inside, "band", "left").select("band", F.when((F.col("real_n") >= 5) & (F.col("sim_n") >= 5), F.col("jsd")).alias("jsd"), F.col("real_n").alias("n_real"), F.col("sim_n").alias("n_sim"), ((F.col("real_f") + F.col("sim_f")) / 2).alias("weight"))
    extra = per.agg(F.coalesce(F.sum(F.col("weight") * F.col("jsd")), F.lit(0.0)).alias("extra"))
    top = sfp.select(F.lit("SFP").alias("item"), F.col("sfp").alias("jsd"), "n_real", "n_sim", F.lit(None).cast("double").alias("weight"))
    both = sfp.join(F.broadcast(extra)).select(F.lit("composite").alias("item"), (F.col("sfp") + F.col("extra")).alias("jsd"), "n_real", "n_sim", F.lit(None).cast("double").alias("weight"))
    return per.withColumnRenamed("band", "item").unionByName(top).unionByName(both)


def summary(pts: DataFrame) -> DataFrame:
    """``(metric, jsd)`` of the four headline scores, without snapping."""
    return metric_divergences(features(coarse(pts), ("SD", "SI", "STAY", "RG")))


def ranked(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(side, x, n, below, total)`` of each distinct value of ``values(side, x)``: its copies, values below it, values of its side.

    Values are counted first, then each range of them is one partition; a small table of range totals carries
    the sums across, so no task sees all values.
    """
    counts = values.groupBy("side", "x").agg(F.count("*").alias("n"))
    parts = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, "side", "x").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged)  # ranges are drawn anew when rows are computed again; what is written stays
    sums = ranged.groupBy("side", "part").agg(F.sum("n").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("side").orderBy("part")) - F.col("s")).withColumn("total", F.sum("s").over(Window.partitionBy("side")))
    upto = F.sum("n").over(Window.partitionBy("side", "part").orderBy("x")) - F.col("n")
    rows = ranged.withColumn("upto", upto).join(F.broadcast(before.select("side", "part", "before", "total")), ["side", "part"])
    return rows.select("side", "x", "n", (F.col("before") + F.col("upto")).alias("below"), "total")


def ccdf(km: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(side, x, p)``: share of values that are x or more."""
    rows = ranked(km.where("km > 0").select("side", F.col("km").alias("x")), partitions)
    return rows.select("side", "x", ((F.col("total") - F.col("below")) / F.col("total")).alias("p"))


def quantile(p: float) -> Column:
    """Over rows of ``ranked`` of one side: the quantile, interpolated between the two values next to its place."""
    place = (F.col("total") - 1) * F.lit(p)
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("x")))
    low, part = F.floor(place), F.max(place - F.floor(place))
    return at(low) * (1 - part) + at(F.ceil(place)) * part
