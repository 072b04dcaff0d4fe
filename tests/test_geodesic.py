"""Distances on the ellipsoid against published pairs."""

import math

import pytest
from pyspark.sql import functions as F

from incidence.functions.geodesic import A, geodesic, project

PAIRS = [
    # Along the equator and a meridian: from the definition of the ellipsoid.
    ((0.0, 0.0, 0.0, 90.0), A * math.pi / 2, 90.0),
    ((0.0, 0.0, 90.0, 0.0), 10_001_965.729, 0.0),
    ((0.0, -179.5, 0.0, 179.5), A * math.pi / 180, 270.0),
    # Flinders Peak to Buninyong, the example of the national geodetic manual.
    ((-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600, -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600), 54_972.271, 306 + 52 / 60 + 5.37 / 3600),
]


def solve(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    return [r["g"] for r in df.select(geodesic(*map(F.col, "abcd")).alias("g")).collect()]


def test_published_pairs(spark):
    for found, (_, metres, azimuth) in zip(solve(spark, [p[0] for p in PAIRS]), PAIRS, strict=True):
        assert abs(found["metres"] - metres) < 0.001
        assert min(abs(found["azimuth"] - azimuth), 360 - abs(found["azimuth"] - azimuth)) < 1e-5


def test_both_ways_and_special_points(spark):
    there, back, same, pole, antipode, null, beyond = solve(spark, [(43.1, 131.9, 55.7, 37.6), (55.7, 37.6, 43.1, 131.9), (1.0, 2.0, 1.0, 362.0), (90.0, 0.0, 45.0, 10.0), (0.0, 0.0, 0.1, 179.9), (None, 1.0, 2.0, 3.0), (91.0, 0.0, 0.0, 0.0)])
    assert abs(there["metres"] - back["metres"]) < 1e-5 and 6_400_000 < there["metres"] < 6_450_000
    assert same["metres"] < 1e-6 and abs(pole["metres"] - (10_001_965.729 - 4_984_944.378)) < 0.001
    assert antipode["metres"] is None and antipode["azimuth"] is None and null["metres"] is None and beyond["metres"] is None


def test_short_distances_are_straight(spark):
    """A thousandth of a degree: the radii of curvature give the length."""
    (found,) = solve(spark, [(43.0, 132.0, 43.001, 132.001)])
    e2, phi = 1 - (6356752.314245179 / A) ** 2, math.radians(43.0005)
    w = math.sqrt(1 - e2 * math.sin(phi) ** 2)
    north, east = A * (1 - e2) / w**3 * math.radians(0.001), A / w * math.cos(phi) * math.radians(0.001)
    assert abs(found["metres"] - math.hypot(north, east)) < 0.0005


@pytest.mark.parametrize("lat, lon", [(43.5, 132.5), (43.3, 132.2), (-40.0, -50.0)])
def test_projection_keeps_distance_and_direction(spark, lat, lon):
    row = spark.range(1).select(project(F.lit(lat), F.lit(lon), 43.3, 132.2).alias("p"), geodesic(F.lit(43.3), F.lit(132.2), F.lit(lat), F.lit(lon)).alias("g")).first()
    assert abs(math.hypot(*row["p"]) - row["g"]["metres"]) < 1e-6
    assert row["g"]["metres"] == 0 or abs(math.degrees(math.atan2(*row["p"])) % 360 - row["g"]["azimuth"]) < 1e-9
