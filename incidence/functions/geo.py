"""Spherical geometry as Column formulas, in degrees and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = EARTH_M * 3.141592653589793 / 180.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * {EARTH_M}e0 * asin(sqrt(least(1e0, {a})))"


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Azimuthal equidistant x and y in metres around (lat0, lon0), on the sphere."""
    p, p0, d = F.radians(lat), F.radians(F.lit(lat0)), F.radians(lon - lon0)
    c = F.acos(F.least(F.lit(1.0), F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(d)))
    k = F.when(c == 0, 1.0).otherwise(c / F.sin(c))
    return EARTH_M * k * F.cos(p) * F.sin(d), EARTH_M * k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(d))


def inside(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the parity of the edges that a ray to the east crosses."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        if y1 != y2:
            crossings = crossings + (spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)).cast("int")
    return crossings % 2 == 1


def inside_sql(lon: str, lat: str, ring: list[tuple[float, float]]) -> str:
    parts = [
        f"((({y1}e0 > {lat}) <> ({y2}e0 > {lat})) and {lon} < {x2 - x1}::double * ({lat} - {y1}e0) / {y2 - y1}::double + {x1}e0)::int"
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)
        if y1 != y2
    ]
    return f"(({' + '.join(parts)}) % 2 = 1)"
