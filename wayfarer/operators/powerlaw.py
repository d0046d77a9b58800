"""Tails of step distances: a pure power law, one with a cutoff, and what differs between two sides.

The data are reduced to a few sums (or ranked counts) in Spark; the fits themselves see only these.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ranked
from .scales import Scales, choose_scales, weighted_logs

#: Tail starts that are tried, and least numbers of values.
STARTS = (0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0)
LEAST, LEAST_TAIL = 100, 50


def tail_fits(km: DataFrame, starts: tuple[float, ...] = STARTS) -> DataFrame:
    """``(side, x_min, alpha, ks, n_tail)`` of each start whose tail is long enough.

    Ranks come from counts of values and range sums; the statistic compares the share up to and with a
    value to the fitted one.
    """
    values = ranked(km.where("km > 0").select("side", F.col("km").alias("x")))
    tail = lambda v, x_min: F.sum(F.when(F.col("x") >= x_min, v))
    each = [F.struct(F.lit(s).alias("x_min"), tail(F.col("n"), s).alias("n_tail"), tail(F.col("n") * F.log(F.col("x") / s), s).alias("s")) for s in starts]
    sums = values.groupBy("side").agg(F.sum("n").alias("all"), F.array(*each).alias("tails")).where(F.col("all") >= LEAST)
    alpha = sums.select("side", F.explode("tails").alias("t")).select("side", "t.*").where((F.col("n_tail") >= LEAST_TAIL) & (F.col("s") > 0))
    alpha = alpha.select("side", "x_min", "n_tail", (1 + F.col("n_tail") / F.col("s")).alias("alpha"))
    rows = values.join(F.broadcast(alpha), "side").where("x >= x_min")
    last = F.col("n_tail") - F.col("total") + F.col("below") + F.col("n")  # rank of the value's last copy in the tail
    fitted = 1 - F.pow(F.col("x") / F.col("x_min"), 1 - F.col("alpha"))
    # Copies of a value have ranks from last - n + 1 to last; the largest distance is at one of both ends.
    gap = F.greatest(F.abs(last / F.col("n_tail") - fitted), F.abs((last - F.col("n") + 1) / F.col("n_tail") - fitted))
    return rows.groupBy("side", "x_min", "alpha", "n_tail").agg(F.max(gap).alias("ks"))


def best_tail(fits: DataFrame) -> DataFrame:
    """``(side, alpha, x_min, ks, n_tail, alpha_2km, n_2km)``: the start with the least distance, and the fit at 2 km."""
    best = fits.groupBy("side").agg(F.min(F.struct("ks", "x_min", "alpha", "n_tail")).alias("b"), F.max(F.when(F.col("x_min") == 2.0, F.col("alpha"))).alias("alpha_2km"), F.max(F.when(F.col("x_min") == 2.0, F.col("n_tail"))).alias("n_2km"))
    return best.select("side", "b.alpha", "b.x_min", "b.ks", "b.n_tail", "alpha_2km", "n_2km")


def _log_norm(beta: float, kappa: float, r0: float, lo: float, hi: float | None = None) -> float:
    """Logarithm of the integral of (x + r0)^-beta * exp(-x / kappa) from lo on, by the trapezoid rule over log x."""
    top = hi if hi is not None else lo + 60 * kappa + 1000 * lo
    t = np.linspace(math.log(lo), math.log(top), 6001)
    x = np.exp(t)
    f = -beta * np.log(x + r0) - x / kappa + t
    m = f.max()
    return float(m + math.log(np.trapezoid(np.exp(f - m), t)))


def _golden(f, lo: float, hi: float, eps: float = 1e-7) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > eps:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def sums_of(km: DataFrame, x_min: float = 2.0, r0: float = 1.5) -> dict[str, dict]:
    """Sufficient statistics by side: n, sum of log(x + r0), sum of x, largest x."""
    rows = km.where(F.col("km") >= x_min).groupBy("side").agg(F.count("*").alias("n"), F.sum(F.log(F.col("km") + r0)).alias("logs"), F.sum("km").alias("sum"), F.max("km").alias("top")).collect()
    return {r["side"]: r.asDict() for r in rows}


def fit_cutoff(stats: dict, beta: float, x_min: float = 2.0, r0: float = 1.5, most: float = 20_000.0) -> float:
    """The cutoff's maximum likelihood with the exponent held."""
    if stats["n"] < LEAST:
        return float("nan")
    cost = lambda lk: stats["n"] * _log_norm(beta, math.exp(lk), r0, x_min) + beta * stats["logs"] + stats["sum"] / math.exp(lk)
    grid = np.linspace(math.log(0.5), math.log(most), 41)
    i = int(np.argmin([cost(v) for v in grid]))
    return math.exp(_golden(cost, grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]))


def fit_joint(stats: dict, x_min: float = 2.0, r0: float = 1.5) -> tuple[float, float]:
    """Exponent and cutoff together: the exponent's best within its bounds, each with its own best cutoff."""
    top = stats["top"] * 3

    def cost(beta: float, lk: float) -> float:
        return beta * stats["logs"] + stats["sum"] / math.exp(lk) + stats["n"] * _log_norm(beta, math.exp(lk), r0, x_min, top)

    def cutoff(beta: float) -> float:
        grid = np.linspace(0.0, math.log(1e5), 24)
        i = int(np.argmin([cost(beta, v) for v in grid]))
        return _golden(lambda v: cost(beta, v), grid[max(0, i - 1)], grid[min(23, i + 1)], 1e-5)

    grid = np.linspace(0.5, 5.0, 19)
    i = int(np.argmin([cost(b, cutoff(b)) for b in grid]))
    beta = _golden(lambda b: cost(b, cutoff(b)), grid[max(0, i - 1)], grid[min(18, i + 1)], 1e-4)
    return float(beta), math.exp(cutoff(beta))


NAN = float("nan")


def cutoffs(km: DataFrame, x_min: float = 2.0, r0: float = 1.5) -> list[tuple[str, float, float, int]]:
    """``(side, exponent, cutoff, number of values)`` of both sides; NaN where a side has too few values in its tail."""
    sums = sums_of(km, x_min, r0)
    tails = {r["side"]: r["alpha_2km"] for r in best_tail(tail_fits(km)).collect()}
    out = []
    for side in ("real", "sim"):
        beta, found = tails.get(side), sums.get(side)
        out.append((side, NAN if beta is None else float(beta), NAN if beta is None or found is None else float(fit_cutoff(found, beta, x_min, r0)), int(found["n"]) if found else 0))
    return out


def analyse(km: DataFrame, sizes: tuple[int, ...] = (2, 3, 4, 5), criterion: str = "bic", r0: float = 1.5) -> dict[str, dict]:
    """Exponent, cutoff, number of values and mixture of each side; NaN and None where a side has too few values."""
    out = {}
    for side, beta, kappa, n in cutoffs(km, r0=r0):
        scales, _ = choose_scales(weighted_logs(km.where(F.col("side") == side)), sizes, criterion)
        out[side] = {"beta": beta, "kappa": kappa, "n": n, "scales": scales}
    return out


def scale_rows(scales: Scales | None) -> list[tuple[str, float]]:
    """``(item, value)`` of a mixture's components, by rank."""
    if scales is None:
        return []
    parts = enumerate(zip(scales.mu, scales.weight, strict=True), 1)
    return [(f"scale{i}.{name}", v) for i, (mu, weight) in parts for name, v in (("mu_log", mu), ("km", math.exp(mu)), ("weight", weight))]


def deltas(found: dict[str, dict]) -> list[tuple[str, float]]:
    """``(item, sim - real)`` of exponent, cutoff and mixtures, these by rank as far as both reach; NaN if a side lacks one."""
    real, sim = found["real"], found["sim"]
    out = [(k, sim[k] - real[k]) for k in ("beta", "kappa")]
    a, b = dict(scale_rows(real["scales"])), dict(scale_rows(sim["scales"]))
    return out + [(k, b[k] - v) for k, v in a.items() if k in b]


def fit_deltas(km: DataFrame, sizes: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[str, float]]:
    return deltas(analyse(km, sizes))
