"""Cells that link, without comparing all cores of dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidence.operators import clustering


@pytest.mark.parametrize("spread", [20.0, 300.0, 900.0])
def test_links_are_those_of_all_pairs(spark, spread):
    rng = np.random.default_rng(int(spread))
    middles = rng.uniform(-1500, 1500, (25, 2))
    points = middles[rng.integers(0, 25, 900)] + rng.normal(0, spread, (900, 2))
    side = 300 / 2**0.5
    cells = np.floor(points / side).astype(int)
    head = {}
    for i, c in enumerate(map(tuple, cells.tolist())):
        head.setdefault(c, i)
    heads = np.array([head[tuple(c)] for c in cells.tolist()])
    near = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= 300 * 300
    want = {(min(x, y), max(x, y)) for x, y in zip(*(heads[k].tolist() for k in np.nonzero(near)), strict=True) if x != y}
    cores = spark.createDataFrame([(i, *map(float, points[i]), *map(int, cells[i]), int(heads[i])) for i in range(900)], "id long, x double, y double, cx long, cy long, head long")
    found = [(min(r), max(r)) for r in clustering.linked_cells(cores, 300.0).collect()]
    assert set(found) == want and len(found) == len(want)


def test_dense_cells_link_without_comparing_their_cores(spark, monkeypatch):
    """Of two dense cells no core is met with those of the other one: a million pairs would be."""
    monkeypatch.setattr(clustering, "_places", lambda cores: cores.withColumn("x", F.raise_error("compared").cast("double")).where("id < 0"))
    i = F.col("id")
    rows = spark.range(2000).select("id", (i % 2 * 212 + i * 37 % 199).cast("double").alias("x"), (i * 53 % 197).cast("double").alias("y"), (i % 2).alias("cx"), F.lit(0).cast("long").alias("cy"), (i % 2).alias("head"))
    assert [tuple(r) for r in clustering.linked_cells(rows, 300.0).collect()] == [(0, 1)]
