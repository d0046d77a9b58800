"""Step distances, their mixture of scales, and where scales meet."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_KM, haversine
from ..sources.readers import stored


def step_distances(rows: DataFrame, keys: list[str], order: list[str], radius: float = R_KM) -> DataFrame:
    """``rows`` with ``km`` from the row before in its group; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("km", haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng", radius))


def day_steps(stays: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """``(user_id, date, seq, km)`` of the steps between consecutive stays of a day, beyond ``least``, up to ``most``."""
    out = step_distances(stays, ["user_id", "date"], ["start_min", "seq"]).where("km IS NOT NULL")
    if least is not None:
        out = out.where(F.col("km") > least)
    if most is not None:
        out = out.where(F.col("km") <= most)
    return out.select("user_id", "date", "seq", "km")


@dataclass(frozen=True)
class Scales:
    """A mixture of log-normal scales, by rising mean."""

    mu: tuple[float, ...]
    var: tuple[float, ...]
    weight: tuple[float, ...]
    log_likelihood: float = float("nan")
    n: int = 0

    def assign(self, km: Column) -> Column:
        """Rank of the likeliest scale, without the width's own term; steps under ten metres are of the first."""
        scores = [F.lit(math.log(w + 1e-30)) - 0.5 * (F.log(km) - m) * (F.log(km) - m) / max(v, 1e-9) for m, v, w in zip(self.mu, self.var, self.weight, strict=True)]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return F.when(km < 0.01, 0).otherwise(F.array_position(F.array(*scores), best).cast("int") - 1)

    def boundaries(self, compat: bool = False) -> list[float]:
        """Kilometres at which neighbouring scales weigh alike. ``compat`` turns the sign of the constant part."""
        parts = list(zip(self.mu, self.var, self.weight, strict=True))
        return [math.exp(_meeting(a, b, -1.0 if compat else 1.0)) for a, b in zip(parts[:-1], parts[1:], strict=True)]

    def table(self, spark) -> DataFrame:
        rows = [(i, *r) for i, r in enumerate(zip(self.mu, self.var, self.weight, strict=True))]
        return spark.createDataFrame(rows, "rank int, mu_log double, var_log double, weight double")

    @classmethod
    def of(cls, table: DataFrame) -> Scales:
        """A mixture that ``table`` has stored; one that isn't a mixture of ranked scales stops the job."""
        rows = table.select(*[F.col(c).cast("double") for c in ("rank", "mu_log", "var_log", "weight")]).orderBy("rank").limit(MOST_SCALES + 1).collect()
        if not rows or len(rows) > MOST_SCALES or [r[0] for r in rows] != list(range(len(rows))):
            raise ValueError("a stored mixture must hold one row for each rank from zero")
        mu, var, weight = (tuple(r[i] for r in rows) for i in (1, 2, 3))
        if any(v is None for r in rows for v in r) or any(v <= 0 for v in var) or any(w < 0 for w in weight) or list(mu) != sorted(mu) or abs(sum(weight) - 1) > 1e-6:
            raise ValueError("a stored mixture needs rising means, positive variances and weights that add up to one")
        return cls(mu, var, weight)


def _meeting(one: tuple[float, float, float], two: tuple[float, float, float], sign: float) -> float:
    """Where the weighted densities of two normals (mean, variance, weight) are equal, as near to the middle as can be.

    The logarithm of their ratio is a parabola; three of its values, at both means and between, are enough
    to tell its smaller root as seen from the middle. Without a root its turning point stands in.
    """

    def ratio(x: float) -> float:
        (m1, v1, w1), (m2, v2, w2) = one, two
        return sign * (math.log(w1 / w2) - 0.5 * math.log(v1 / v2)) - (x - m1) ** 2 / (2 * v1) + (x - m2) ** 2 / (2 * v2)

    middle, half = (one[0] + two[0]) / 2, (two[0] - one[0]) / 2
    if half == 0:
        return middle
    left, at, right = ratio(one[0]), ratio(middle), ratio(two[0])
    bend, slope = (left + right - 2 * at) / (2 * half * half), (right - left) / (2 * half)
    root = math.sqrt(max(0.0, slope * slope - 4 * bend * at))
    if slope * slope < 4 * bend * at:
        return middle - slope / (2 * bend)
    far = -(slope + math.copysign(root, slope)) / 2
    return middle + (at / far if far else 0.0)


def weighted_logs(km: DataFrame, bins: float | None = 1e-3) -> DataFrame:
    """``(x, n)``: log distances with counts; rounded to ``bins`` so that a fit reads a small table."""
    x = F.log("km")
    return km.where("km > 0").groupBy((F.rint(x / bins) * bins if bins else x).alias("x")).agg(F.count("*").alias("n"))


#: Components that a stored mixture may have.
MOST_SCALES = 64
#: A table of at most this many different log distances is fitted from its counts; bins of a thousandth
#: over all distances on Earth are some twenty thousand. A larger one (exact values) stays in Spark.
MOST_COUNTS = 200_000


class _Counts:
    """Sums of one round over collected counts."""

    def __init__(self, x: np.ndarray, n: np.ndarray) -> None:
        self.x, self.n = x, n.astype(float)

    def start(self, k: int) -> tuple[list[float], float]:
        """Quantiles, interpolated between the two values next to their places as Spark does, and the variance."""
        upto, mean = np.cumsum(self.n), (self.n @ self.x) / self.n.sum()
        place = (upto[-1] - 1) * (np.arange(k) + 0.5) / k
        low, high = (self.x[np.searchsorted(upto, f(place), "right")] for f in (np.floor, np.ceil))
        return (low + (high - low) * (place - np.floor(place))).tolist(), float(self.n @ (self.x - mean) ** 2 / self.n.sum())

    def round(self, mu: list[float], var: list[float], w: list[float]) -> tuple[float, float, list[tuple[float, float, float]]]:
        m, v = np.array(mu)[:, None], np.array(var)[:, None]
        p = np.log(np.maximum(np.array(w), 1e-300))[:, None] - 0.5 * np.log(2 * np.pi * v) - (self.x - m) ** 2 / (2 * v)
        top = p.max(axis=0)
        e = np.exp(p - top)
        z = e.sum(axis=0)
        r = self.n * e / z
        return float(self.n @ (np.log(z) + top)), float(self.n.sum()), [(float(a.sum()), float(a @ self.x), float(a @ self.x**2)) for a in r]


class _Rows:
    """The same sums as one aggregate over a table."""

    def __init__(self, logs: DataFrame) -> None:
        self.logs = logs

    def start(self, k: int) -> tuple[list[float], float]:
        q = self.logs.agg(F.percentile("x", [(i + 0.5) / k for i in range(k)], F.col("n")).alias("q"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("ss")).first()
        return list(q["q"]), q["ss"] / q["n"] - (q["s"] / q["n"]) ** 2

    def round(self, mu: list[float], var: list[float], w: list[float]) -> tuple[float, float, list[tuple[float, float, float]]]:
        k = len(mu)
        parts = [F.lit(math.log(max(w[i], 1e-300)) - 0.5 * math.log(2 * math.pi * var[i])) - (F.col("x") - mu[i]) * (F.col("x") - mu[i]) / (2 * var[i]) for i in range(k)]
        rows = self.logs.withColumn("p", F.array(*parts)).withColumn("top", F.array_max("p"))
        rows = rows.withColumn("e", F.transform("p", lambda v: F.exp(v - F.col("top")))).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
        sums = [F.sum(F.col("n") * (F.log("z") + F.col("top"))), F.sum("n")]
        for i in range(k):
            r = F.col("n") * F.col("e")[i] / F.col("z")
            sums += [F.sum(r), F.sum(r * F.col("x")), F.sum(r * F.col("x") * F.col("x"))]
        s = list(rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first())
        return s[0], s[1], [tuple(s[2 + 3 * i : 5 + 3 * i]) for i in range(k)]


def _sums(logs: DataFrame) -> _Counts | _Rows:
    table = logs.limit(MOST_COUNTS + 1).toPandas()
    if not len(table):
        raise ValueError("no steps to fit scales to")
    if len(table) > MOST_COUNTS:
        return _Rows(stored(logs))
    table = table.sort_values("x")
    return _Counts(table["x"].to_numpy(), table["n"].to_numpy())


def fit_scales(logs: DataFrame | _Counts | _Rows, k: int = 4, rounds: int = 100, cap: float | None = None, start: Scales | None = None) -> Scales:
    """Expectation maximisation over ``logs(x, n)``: each round needs three sums per scale."""
    sums = _sums(logs) if isinstance(logs, DataFrame) else logs
    if start is None:
        mu, spread = sums.start(k)
        var, w = [max(1e-6, spread / k)] * k, [1.0 / k] * k
    else:
        mu, var, w = list(start.mu), list(start.var), list(start.weight)
        k = len(mu)
    if cap is not None:
        var = [min(v, cap * cap) for v in var]
    before, total = -math.inf, 0.0
    for _ in range(rounds):
        likelihood, total, parts = sums.round(mu, var, w)
        for i, (r, rx, rxx) in enumerate(parts):
            r = max(r, 1e-12)
            w[i], mu[i] = r / total, rx / r
            v = rxx / r - mu[i] ** 2
            var[i] = max(1e-6, v if cap is None else min(v, cap * cap))
        if abs(likelihood - before) <= 1e-8 * abs(likelihood):
            break
        before = likelihood
    order = np.argsort(mu)
    return Scales(*(tuple(float(v[i]) for i in order) for v in (mu, var, w)), log_likelihood=float(likelihood), n=int(total))


def fit_capped_scales(logs: DataFrame, k: int = 4, max_sigma: float = 0.7) -> Scales:
    """A free fit, then twenty capped rounds only if some scale is wider than the cap."""
    logs = _sums(logs)
    free = fit_scales(logs, k)
    return fit_scales(logs, k, 20, max_sigma, free) if max(free.var) > max_sigma**2 else free


#: Fixed value: fewer distances than this have no mixture.
LEAST_TO_CHOOSE = 50


def choose_scales(logs: DataFrame, sizes: tuple[int, ...] = (2, 3, 4, 5), criterion: str = "bic") -> tuple[Scales | None, list[tuple[int, float, float]]]:
    """The mixture with the least criterion, and ``(k, bic, aic)`` of all; None and no scores for under fifty distances."""
    if (logs.agg(F.sum("n").alias("n")).first()["n"] or 0) < LEAST_TO_CHOOSE:
        return None, []
    fits, scores, logs = [], [], _sums(logs)
    for k in sizes:
        f = fit_scales(logs, k)
        bic, aic = -2 * f.log_likelihood + (3 * k - 1) * math.log(f.n), -2 * f.log_likelihood + 2 * (3 * k - 1)
        fits.append((bic if criterion == "bic" else aic, k, f))
        scores.append((k, bic, aic))
    return min(fits, key=lambda x: x[:2])[2], scores


#: Distance bands in use without a fitted mixture, in km.
BANDS = (("micro", 0.0, 0.5), ("neighborhood", 0.5, 3.0), ("urban", 3.0, 27.0), ("regional", 27.0, 88.0), ("macro", 88.0, math.inf))


def bands_from(boundaries: list[float]) -> tuple[tuple[str, float, float], ...]:
    """Bands between boundaries, with labels of their own."""
    edges = [0.0, *boundaries, math.inf]
    return tuple((f"s{i + 1}", a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))


def band(km: Column, bands: tuple[tuple[str, float, float], ...] = BANDS) -> Column:
    """Name of the band that holds a positive distance."""
    out = None
    for name, lo, hi in bands:
        inside = (km > 0) & (km >= lo) & (km < hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out
