"""Priors over pairs of cells: log distances, density of cells around a cell, next cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import R_KM, haversine
from .scales import Scales

#: Terms of the series in kernel sums; cells of a city that tasks hold (20 bytes each); distances that a task works on at once.
TERMS, MOST_CELLS, BLOCK_VALUES = 16, 2_000_000, 1_000_000


def log_distances(vocab: DataFrame, floor_km: float = 0.05, most_km: float | None = None) -> DataFrame:
    """``(prev, cell, log_km)`` of all pairs of cells, or of those within ``most_km``. The vocabulary is the small side."""
    a = vocab.select(F.col("cell_id").alias("prev"), F.col("lng").alias("x1"), F.col("lat").alias("y1"))
    b = vocab.select(F.col("cell_id").alias("cell"), F.col("lng").alias("x2"), F.col("lat").alias("y2"))
    km = haversine("y1", "x1", "y2", "x2", R_KM)
    if most_km is None:
        rows = a.join(b).withColumn("km", km)
    else:
        # Buckets as high as most_km, and as wide at the latitude of their row's far edge; a cell meets nine of them.
        high = most_km / 110.0
        wide = lambda row: F.lit(high) / F.greatest(F.lit(0.01), F.cos(F.radians((F.greatest(F.abs(row), F.abs(row + 1)) + 1) * high)))
        around = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
        a = a.withColumn("row", F.floor(F.col("y1") / high)).withColumn("col", F.floor(F.col("x1") / wide(F.col("row"))))
        b = b.withColumn("dy", around).withColumn("row", F.floor(F.col("y2") / high) + F.col("dy")).withColumn("dx", around).withColumn("col", F.floor(F.col("x2") / wide(F.col("row"))) + F.col("dx"))
        rows = a.join(b, ["row", "col"]).withColumn("km", km).where(F.col("km") <= most_km)
    return rows.select("prev", "cell", F.log(F.greatest("km", F.lit(floor_km))).alias("log_km"))


def hermite(n: int, x: np.ndarray) -> np.ndarray:
    """Hermite polynomials (of the kind with leading coefficient one) of orders 0 to n, by order first."""
    out = np.ones((n + 1, *np.shape(x)))
    for k in range(n):
        out[k + 1] = x * out[k] - (k * out[k - 1] if k else 0)
    return out


def kernel_means(d: np.ndarray, width: float) -> np.ndarray:
    """Mean of exp(-((d[i] - d[j]) / width)**2 / 2) over j for every row of ``d`` and every i, in work of the size of ``d``.

    Values are binned by ``width``. A bin keeps TERMS moments about its middle; a convolution over bins, with
    derivatives of the kernel, turns these into as many coefficients of the sum's own series about each middle. What both series leave
    out is below 2.2 * (1/2)**TERMS / sqrt(TERMS!) of a mean's largest value, one: some 1e-11.
    """
    rows, low = len(d), d.min()
    u = (d - low) / width
    bins = int(u.max()) + 1
    b = np.minimum(u.astype(np.int64), bins - 1)
    s = u - b - 0.5
    key = (b + bins * np.arange(rows)[:, None]).reshape(-1)
    moments, power = np.empty((rows, bins, TERMS)), np.ones_like(s)
    for k in range(TERMS):
        moments[:, :, k] = np.bincount(key, power.reshape(-1), rows * bins).reshape(rows, bins)
        power = power * s / (k + 1)
    apart = np.arange(1 - bins, bins).astype(float)
    waves = hermite(2 * TERMS - 2, apart) * np.exp(-apart * apart / 2)
    # By source bin and moment, target bin and coefficient.
    order = np.arange(TERMS)
    kernel = waves[order[None, :, None, None] + order[None, None, None, :], (np.arange(bins)[None, None, :, None] - np.arange(bins)[:, None, None, None]) + bins - 1] * np.where(order % 2, -1.0, 1.0)
    series = (moments.reshape(rows, -1) @ kernel.reshape(bins * TERMS, bins * TERMS)).reshape(rows * bins, TERMS)
    out, power = np.zeros_like(s), np.ones_like(s)
    for m in range(TERMS):
        out += series[:, m][key].reshape(s.shape) * power
        power = power * s / (m + 1)
    return out / d.shape[1]


def exact_kernel_means(d: np.ndarray, width: float) -> np.ndarray:
    """``kernel_means`` term by term, in work of the square of a row's size."""
    return np.stack([np.concatenate([np.exp(-0.5 * ((row[at : at + 512, None] - row[None]) / width) ** 2).mean(axis=1) for at in range(0, len(row), 512)]) for row in d])


def _cells_of(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and radians of all cells, for every task; a city with more than MOST_CELLS stops the job."""
    table = vocab.select(F.col("cell_id").cast("int").alias("cell_id"), F.radians("lng").alias("x"), F.radians("lat").alias("y")).limit(MOST_CELLS + 1).toArrow()
    if table.num_rows > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells, each of which would meet all others")
    order = np.argsort(table["cell_id"].to_numpy())
    return tuple(table[c].to_numpy()[order] for c in ("cell_id", "x", "y"))


def _around_cells(vocab: DataFrame, scales: Scales, factor: float, least: float, floor_km: float, exact: bool, each: Callable[[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls ``each`` with ids, previous cells, scale, log distances and log densities of blocks of previous cells, inside tasks."""
    widths = [max(least, float(np.sqrt(v)) * factor) for v in scales.var]
    shared = vocab.sparkSession.sparkContext.broadcast(_cells_of(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, y = shared.value
        rows = max(1, BLOCK_VALUES // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                prev = batch.column(0).slice(at, rows).to_numpy()
                i = np.searchsorted(ids, prev)
                h = np.sin((y - y[i, None]) / 2) ** 2 + np.cos(y) * np.cos(y[i, None]) * np.sin((x - x[i, None]) / 2) ** 2
                d = np.log(np.maximum(2 * R_KM * np.arcsin(np.sqrt(np.minimum(1, h))), floor_km))
                for s, width in enumerate(widths):
                    density = (exact_kernel_means if exact else kernel_means)(d, width)
                    yield from each(ids, prev, s, d, np.log(np.maximum(density, 1e-9)))

    return vocab.select(F.col("cell_id").cast("int").alias("cell_id")).repartition("cell_id").mapInArrow(run, schema)


def log_cell_density(vocab: DataFrame, scales: Scales, factor: float = 0.5, least: float = 0.05, floor_km: float = 0.05, exact: bool = False) -> DataFrame:
    """``(prev, scale, cell, log_density)``: Gaussian kernel density of cells by log distance around each cell.

    Blocks of previous cells are spread over tasks, each of which holds the cells' coordinates. Sums over cells are those of
    ``kernel_means``, or term by term if ``exact``.
    """

    def each(ids: np.ndarray, prev: np.ndarray, s: int, d: np.ndarray, log_density: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(prev, n)), pa.array(np.full(n * len(prev), s, np.int32)), pa.array(np.tile(ids, len(prev))), pa.array(log_density.reshape(-1))], ["prev", "scale", "cell", "log_density"])

    return _around_cells(vocab, scales, factor, least, floor_km, exact, each, "prev int, scale int, cell int, log_density double")


def next_cells(vocab: DataFrame, scales: Scales, k: int = 5, factor: float = 0.5, least: float = 0.05, floor_km: float = 0.05) -> DataFrame:
    """``(prev, scale, cell, score, nth)``: the k cells of the best distance prior for each previous cell and scale.

    A score depends on the distance alone, so the best ones are chosen where distances and densities are computed: a task reads
    one row a previous cell and gives k rows a scale, and no pairs of cells leave it. Scores that agree to nine
    places are equal; the smaller cell comes first.
    """

    def each(ids: np.ndarray, prev: np.ndarray, s: int, d: np.ndarray, log_density: np.ndarray) -> Iterator[pa.RecordBatch]:
        score = -0.5 * (d - scales.mu[s]) ** 2 / max(scales.var[s], 0.01) - log_density
        equal, n = np.round(score, 9), min(k, len(ids))
        # All that reach the n-th best, then the first n of these.
        edge = np.partition(equal, len(ids) - n, axis=1)[:, len(ids) - n]
        row, cell = np.nonzero(equal >= edge[:, None])
        order = np.lexsort((ids[cell], -equal[row, cell], row))
        row, cell = row[order], cell[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row) + 1
        row, cell, nth = row[nth <= n], cell[nth <= n], nth[nth <= n]
        yield pa.RecordBatch.from_arrays([pa.array(prev[row]), pa.array(np.full(len(row), s, np.int32)), pa.array(ids[cell]), pa.array(score[row, cell]), pa.array(nth.astype(np.int32))], ["prev", "scale", "cell", "score", "nth"])

    return _around_cells(vocab, scales, factor, least, floor_km, False, each, "prev int, scale int, cell int, score double, nth int")
