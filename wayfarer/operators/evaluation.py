"""All scores of simulated trajectories in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import stored
from . import metrics as me
from . import powerlaw as pl
from .scales import BANDS


def evaluate(
    pts: DataFrame, known: DataFrame | None = None, bands: tuple = BANDS, scaling: bool = True, most_km: float | None = None, r0: float = 1.5, sizes: tuple[int, ...] = (2, 3, 4, 5), criterion: str = "bic"
) -> DataFrame:
    """``(metric, value)``: divergences, moments and, with ``scaling``, what only distances tell; an empty side stops the job.

    ``known`` are locations that simulated points are moved to. ``most_km`` leaves out longer steps of the
    scaling part: tail exponents and cutoffs, mixtures, bands and their differences, the scale profile.
    """
    if known is not None:
        pts = pts.where("side = 'real'").unionByName(me.snap_to_known(pts.where("side = 'sim'"), known).select(*pts.columns))
    pts = stored(me.coarse(pts))
    if {r["side"] for r in pts.select("side").distinct().collect()} != {"real", "sim"}:
        raise ValueError("both sides need trajectories")
    values = stored(me.features(pts))
    out = me.metric_divergences(values).select(F.concat("metric", F.lit(".jsd")).alias("metric"), F.col("jsd").alias("value"))
    moments = me.metric_moments(values).where(F.col("metric").isin("DTD", "DUL", "VIS"))
    out = out.unionByName(_unpivot(moments, F.concat("metric", F.lit("."), "side", F.lit("_")), ("n", "mean", "std")))
    if not scaling:
        return out
    km = values.where("metric = 'SD' AND value > 0").select("side", F.col("value").alias("km"))
    km = stored(km if most_km is None else km.where(F.col("km") <= most_km))
    out = out.unionByName(me.scale_profile(km, bands).select(F.concat(F.lit("SFP."), "item").alias("metric"), F.col("jsd").alias("value")))
    return out.unionByName(band_scores(km, bands)).unionByName(fit_scores(km, r0, sizes, criterion))


def _unpivot(rows: DataFrame, prefix, items: tuple[str, ...]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("value")) for i in items])).alias("e")
    return rows.select(prefix.alias("prefix"), each).select(F.concat("prefix", "e.item").alias("metric"), "e.value")


def band_scores(km: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """``(metric, value)``: numbers, shares and means of each band by side, and the difference of shares, NaN without a side."""
    stats = me.band_statistics(km, bands)
    each = _unpivot(stats, F.concat(F.lit("bands."), "side", F.lit("."), "band", F.lit(".")), ("n", "fraction", "mean_km")).where("value IS NOT NULL")
    share = lambda s: F.max(F.when(F.col("side") == s, F.col("fraction")))
    delta = stats.groupBy("band").agg(F.coalesce(share("sim") - share("real"), F.lit(float("nan"))).alias("value"))
    return each.unionByName(delta.select(F.concat(F.lit("bands.delta."), "band").alias("metric"), "value"))


def fit_scores(km: DataFrame, r0: float = 1.5, sizes: tuple[int, ...] = (2, 3, 4, 5), criterion: str = "bic") -> DataFrame:
    """``(metric, value)``: tail and mixture of each side and their differences. The fits see sums and counts alone."""
    found = pl.analyse(km, sizes, criterion, r0)
    rows = []
    for side, f in found.items():
        rows += [(f"power_law.{side}.{k}", float(f[k])) for k in ("beta", "kappa", "n")]
        rows += [(f"gmm.{side}.{k}", float(v)) for k, v in pl.scale_rows(f["scales"])]
    rows += [(f"delta.{k}", float(v)) for k, v in pl.deltas(found)]
    return km.sparkSession.createDataFrame(rows, "metric string, value double")
