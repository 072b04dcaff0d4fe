"""Points in polygons by the cell index against plain ray casting."""

import json
import math
import random

import pytest

from incidence.operators import polygons
from incidence.sources import incidents


def ring(rng, n, x, y, size, rough=0.5):
    return [(x + size * (1 - rough * rng.random()) * math.cos(2 * math.pi * i / n), y + size * (1 - rough * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def plain(rings, x, y):
    hits = 0
    for points in rings:
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hits += 1
    return hits % 2 == 1


def boundary(spark, tmp_path, parts):
    closed = [[[[x, y] for x, y in [*r, r[0]]] for r in rings] for rings in parts]
    (tmp_path / "b.json").write_text(json.dumps({"features": [{"geometry": {"type": "MultiPolygon", "coordinates": closed}}]}))
    return incidents.read_boundary(spark, str(tmp_path / "b.json"))


@pytest.mark.parametrize("seed, sizes", [(1, [[10_000, 300], [40]]), (2, [[4], [3], [60, 5, 7]])])
def test_equals_ray_casting(spark, tmp_path, seed, sizes):
    rng = random.Random(seed)
    parts = [[ring(rng, n, 10 * p + (0 if k == 0 else 1.1 * k - 1.5), 5.0 * p, 5 if k == 0 else 0.5) for k, n in enumerate(sizes_of)] for p, sizes_of in enumerate(sizes)]
    index = polygons.index_of(polygons.ring_edges(boundary(spark, tmp_path, parts)))
    points = [(i, rng.uniform(-7, 30), rng.uniform(-7, 17)) for i in range(1500 if seed == 1 else 4000)]
    points += [(100_000 + i, x, y) for i, (x, y) in enumerate(p for rings in parts for r in rings for p in r[:20])]  # on vertices
    points += [(200_000, None, 1.0), (200_001, 1.0, None)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    got = {r["id"]: r["is_in_region"] for r in polygons.with_inside(df, index, "id").collect()}
    sure = [p for p in points if p[0] < 100_000]
    assert [got[i] for i, _, _ in sure] == [any(plain(rings, x, y) for rings in parts) for _, x, y in sure]
    assert len(got) == len(points) and got[200_000] is None and got[200_001] is None
    which = {(r["id"], r["polygon"]) for r in polygons.containing(df, index).where("id < 100000").collect()}
    assert which == {(i, p) for i, x, y in sure for p, rings in enumerate(parts) if plain(rings, x, y)}


def test_squares_on_the_grid(spark):
    """Edges along the axes, a hole, points on a lattice off the edges."""
    square = lambda p, r, x, y, s: [(p, r, i, float(x + a * s), float(y + b * s)) for i, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    rows = square(0, 0, 0, 0, 8) + square(0, 1, 2, 2, 4) + square(1, 0, 20, 0, 1)
    index = polygons.index_of(polygons.ring_edges(spark.createDataFrame(rows, "polygon int, ring int, nr int, lon double, lat double")))
    points = [(i * 100 + j, i + 0.5, j + 0.5) for i in range(-1, 22) for j in range(-1, 10)]
    got = {r["id"] for r in polygons.with_inside(spark.createDataFrame(points, "id long, lon double, lat double"), index, "id").where("is_in_region").collect()}
    assert got == {k for k, x, y in points if (0 < x < 8 and 0 < y < 8 and not (2 < x < 6 and 2 < y < 6)) or (20 < x < 21 and 0 < y < 1)}


def test_nothing_to_hold(spark):
    empty = spark.createDataFrame([], "polygon int, ring int, nr int, lon double, lat double")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lon double, lat double")
    assert polygons.index_of(polygons.ring_edges(empty)) is None
    assert polygons.with_inside(points, None, "id").first()["is_in_region"] is False
