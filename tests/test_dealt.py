"""What is dealt among tasks: vectors in single precision where none loses by it, places once."""

from pyspark.sql import functions as F

from incidence.operators import neighbourhood, polygons
from incidence.plans import spatial

SF = "/root/testdata/sf0.001"


def test_vectors_as_given(spark):
    single = spark.createDataFrame([(1, [0.5, 1.25]), (2, [3.0, -2.0])], "id long, v array<double>")
    assert dict(neighbourhood.as_given(single).dtypes)["v"] == "array<float>"
    for other in ([0.1, 1.0], [float("nan"), 1.0], [None, 1.0]):
        mixed = single.unionByName(spark.createDataFrame([(3, other)], single.schema))
        kept = neighbourhood.as_given(mixed)
        assert dict(kept.dtypes)["v"] in ("array<double>", "array<float>")
        if other[0] == 0.1:
            assert dict(kept.dtypes)["v"] == "array<double>" and kept.where("id = 3").first()["v"] == other


def test_each_place_is_asked_once(spark, monkeypatch):
    asked = []
    told = polygons.containing
    monkeypatch.setattr(polygons, "containing", lambda points, *how: asked.append((points.count(), points.distinct().count())) or told(points, *how))
    out = spatial.boundary_regions(spark, SF)
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert out.count() == n and asked[0][0] == asked[0][1] < n / 2
    assert out.agg(F.count_distinct("id")).first()[0] == n
