"""Geometry as plain arithmetic on coordinates.

Points are two doubles, rings are ordered vertex arrays, and metric work uses
either great-circle distance or the European equal-area grid (EPSG:3035).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8

# EPSG:3035 on GRS80
_A = 6378137.0
_E2 = 0.006694380022900788
_E = math.sqrt(_E2)
_LAT0, _LON0 = math.radians(52.0), math.radians(10.0)
_FE, _FN = 4321000.0, 3210000.0


def _authalic(sin_lat: float) -> float:
    return (1 - _E2) * (
        sin_lat / (1 - _E2 * sin_lat**2)
        - math.log((1 - _E * sin_lat) / (1 + _E * sin_lat)) / (2 * _E)
    )


_QP = _authalic(1.0)
_B0 = math.asin(_authalic(math.sin(_LAT0)) / _QP)
_RQ = _A * math.sqrt(_QP / 2)
_D = _A * math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) / (_RQ * math.cos(_B0))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def to_3035(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """(easting, northing) in EPSG:3035."""
    s = F.sin(F.radians(_c(lat)))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _QP)))
    dlon = F.radians(_c(lon)) - _LON0
    b = _RQ * F.sqrt(
        2 / (1 + math.sin(_B0) * F.sin(beta) + math.cos(_B0) * F.cos(beta) * F.cos(dlon))
    )
    x = _FE + b * _D * F.cos(beta) * F.sin(dlon)
    y = _FN + b / _D * (math.cos(_B0) * F.sin(beta) - math.sin(_B0) * F.cos(beta) * F.cos(dlon))
    return x, y


def from_3035(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """(lon, lat) degrees of an EPSG:3035 position."""
    xs, ys = (_c(x) - _FE) / _D, _D * (_c(y) - _FN)
    rho = F.sqrt(xs * xs + ys * ys)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * _RQ)))
    safe = F.when(rho == 0, F.lit(1.0)).otherwise(rho)
    sin_b = F.cos(c) * math.sin(_B0) + ys * F.sin(c) * math.cos(_B0) / safe
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_b)))
    e2, e4, e6 = _E2, _E2**2, _E2**3
    lat = (
        beta
        + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
        + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    lon = _LON0 + F.atan2(
        xs * F.sin(c), rho * math.cos(_B0) * F.cos(c) - ys * math.sin(_B0) * F.sin(c)
    )
    return F.degrees(lon), F.degrees(lat)


def shoelace(xs: Column, ys: Column) -> Column:
    """Unsigned area of a ring given as two coordinate arrays (open or closed)."""
    n = F.size(xs)
    terms = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.element_at(xs, i) * F.element_at(ys, (i % n) + 1)
        - F.element_at(xs, (i % n) + 1) * F.element_at(ys, i),
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def bbox_intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Four comparisons on (minx, miny, maxx, maxy); prunes Parquet row groups."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does the edge cross the ray from the point towards +x? Half-open in y."""
    return ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) / (y2 - y1) * (x2 - x1))


def segment_position(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Closest point of a segment to a point, planar."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / len2))
    )
    return x1 + t * dx, y1 + t * dy


def box_distance(px: Column, py: Column, cx: Column, cy: Column, half: float) -> Column:
    """Planar distance from a point to an axis-aligned square."""
    dx = F.greatest(F.lit(0.0), F.abs(px - cx) - half)
    dy = F.greatest(F.lit(0.0), F.abs(py - cy) - half)
    return F.sqrt(dx * dx + dy * dy)


def coordinate_label(lat: Column | str, lon: Column | str) -> Column:
    """Human-readable position, four decimals and a hemisphere letter."""
    lat, lon = _c(lat), _c(lon)
    return F.format_string(
        "%.4f° %s, %.4f° %s",
        F.abs(lat),
        F.when(lat >= 0, "N").otherwise("S"),
        F.abs(lon),
        F.when(lon >= 0, "E").otherwise("W"),
    )
