"""Parameters and limits of the application's questions."""

import pytest

from incidence.plans import endpoints

SF = "/root/testdata/sf0.001"


def test_pages(spark):
    rows, total = endpoints.accidents_page(spark, SF, limit=7, severity=("dead",))
    every = total.first()["total"]
    got = rows.collect()
    assert len(got) == min(7, every) and {r["severity"] for r in got} == {"dead"}
    assert endpoints.accident(spark, SF, got[0]["id"]).count() == 1 and endpoints.accident(spark, SF, -1).count() == 0
    with pytest.raises(ValueError):
        endpoints.accidents_page(spark, SF, limit=501)


def test_forecast(spark):
    rows = endpoints.monthly_forecast(spark, SF, 3).collect()
    assert 3 <= len(rows) <= 4 and all(r["low"] <= r["predicted"] <= r["high"] for r in rows)


def test_search(spark):
    vector = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id = 3").first()["embedding"]
    rows = endpoints.similar_posts(spark, SF, vector, 5).collect()
    assert len(rows) == 5 and rows[0]["vec_id"] == 3 and rows[0]["similarity"] == 1.0
    assert endpoints.similar_posts(spark, SF, [], 5).count() == 0
    with pytest.raises(ValueError):
        endpoints.similar_posts(spark, SF, vector, 21)


def test_recommendations(spark):
    assert endpoints.point_recommendations(spark, SF, 40.0, 120.0).count() == 0
    some = endpoints.point_recommendations(spark, SF, 43.18, 132.01, 5000.0, 3).collect()
    assert 1 <= len(some) <= 3 and [r["place"] for r in some] == list(range(1, len(some) + 1))
    narrow = endpoints.point_recommendations(spark, SF, 43.18, 132.01, 5000.0, 3, 1996, 1996)
    assert narrow.count() <= 3


def test_hotspots(spark):
    assert all(r["n_points"] >= 15 for r in endpoints.hotspots(spark, SF).collect())
