"""Geometry, grids and bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radii in use, and metres of a degree of latitude.
R_METRES, R_KM, R_KM_MEAN = 6371000.0, 6371.0, 6371.0088
METRES_PER_DEGREE = 111320.0

#: Minute edges of the 24 duration bins.
DURATION_EDGES = (0, 5, 10, 15, 20, 30, 40, 50, 60, 80, 100, 120, 150, 180, 210, 240, 300, 360, 420, 480, 600, 720, 900, 1080, 1440)
ARRIVAL_BINS, ARRIVAL_MINUTES = 288, 5


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1: Column | str, lng1: Column | str, lat2: Column | str, lng2: Column | str, radius: float = R_KM) -> Column:
    """Great-circle distance, in the unit of ``radius``. Null if any input is."""
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    up, across = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a))) * F.lit(2.0 * radius)


def cell_floor(x: Column | str, degrees: float) -> Column:
    """Index of the degree cell that holds ``x``."""
    return F.floor(_col(x) / F.lit(degrees)).cast("long")


def cell_round(x: Column | str, degrees: float) -> Column:
    """Index of the nearest multiple of ``degrees``, ties to even."""
    return F.rint(_col(x) / F.lit(degrees)).cast("long")


def _lng_degrees(lat: Column, metres: float) -> Column:
    return F.lit(metres) / (F.lit(METRES_PER_DEGREE) * F.greatest(F.lit(0.01), F.cos(F.radians(lat))))


def metric_row(lat: Column | str, metres: float = 500.0) -> Column:
    return F.floor(_col(lat) / F.lit(metres / METRES_PER_DEGREE)).cast("long")


def metric_column(lat: Column | str, lng: Column | str, metres: float = 500.0) -> Column:
    """Column index of the metric cell, with the width of a degree at the point's own latitude."""
    return F.floor(_col(lng) / _lng_degrees(_col(lat), metres)).cast("long")


def metric_centre_lat(lat: Column | str, metres: float = 500.0) -> Column:
    return (metric_row(lat, metres) + F.lit(0.5)) * F.lit(metres / METRES_PER_DEGREE)


def metric_centre_lng(lat: Column | str, lng: Column | str, metres: float = 500.0) -> Column:
    """Centre of the point's cell, again with the width of a degree at the point's own latitude."""
    return (metric_column(lat, lng, metres) + F.lit(0.5)) * _lng_degrees(_col(lat), metres)


def valid_point(lat: Column | str, lng: Column | str) -> Column:
    return _col(lat).between(-90, 90) & _col(lng).between(-180, 180)


def duration_bin(minutes: Column | str) -> Column:
    """Bin below the first edge that is greater than the value; the day's length and more go to the last bin."""
    m = _col(minutes)
    out = F.when(m < DURATION_EDGES[1], 0)
    for i in range(1, len(DURATION_EDGES) - 1):
        out = out.when(m < DURATION_EDGES[i + 1], i)
    return out.when(m.isNotNull(), len(DURATION_EDGES) - 2)


def _of_duration(b: Column, values: list[float]) -> Column:
    """The value of a bin; what lies outside the bins, as a padded sample's 24, counts as the nearest one."""
    place = F.greatest(F.lit(1), F.least(b + 1, F.lit(len(values))))
    return F.when(b.isNotNull(), F.element_at(F.array(*[F.lit(float(v)) for v in values]), place.cast("int")))


def duration_low(b: Column) -> Column:
    return _of_duration(b, list(DURATION_EDGES[:-1]))


def duration_middle(b: Column) -> Column:
    return _of_duration(b, [(a + c) / 2 for a, c in zip(DURATION_EDGES[:-1], DURATION_EDGES[1:], strict=True)])


def arrival_bin(minute: Column | str) -> Column:
    return F.least(F.floor(_col(minute) / ARRIVAL_MINUTES).cast("int"), F.lit(ARRIVAL_BINS - 1))
