"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from incidence.sources import incidents, sinks
from incidence.sources.files import register
from incidence.streaming.daily import load_new


def test_incidents(spark, tmp_path):
    person = {"PART_TYPE": "Водитель", "SEX": "Мужской", "ALCO": 0.2}
    records = [
        {"EM_NUMBER": "1", "EM_DATE": "2024-01-02T03:04:05", "LAT": "132.0", "LNG": "43.0", "REGIONS": ["Российская Федерация", "Приморский край"], "LOST_AMOUNT": 1, "VEHICLES": [{"N_TS": 1, "MARK_TS": "TOYOTA", "PERSONS": [person, person]}], "PERSONS": [person]},
        {"EM_NUMBER": "2", "EM_DATE": "bad", "REGIONS": ["Приморский край"]},
        {"EM_NUMBER": "3", "EM_DATE": "2024-01-02 03:04:05", "LAT": "x", "POINT": {"coordinates": [43.1, 131.9]}, "REGIONS": ["Other"]},
    ]
    (tmp_path / "a.json").write_text(json.dumps(records, ensure_ascii=False))
    raw = incidents.read_incidents(spark, str(tmp_path / "a.json"))
    rows = {r["external_id"]: r for r in incidents.accidents(raw).collect()}
    assert set(rows) == {"1", "3"} and (rows["1"]["lat"], rows["1"]["lon"], rows["1"]["severity"], rows["1"]["parent_region"]) == (43.0, 132.0, "dead", "Приморский край")
    assert (rows["3"]["lat"], rows["3"]["lon"], rows["3"]["severity"]) == (43.1, 131.9, "no_injuries")
    assert incidents.vehicles(raw).count() == 1 and incidents.participants(raw).count() == 2 and incidents.pedestrians(raw).count() == 1
    assert incidents.read_incidents(spark, str(tmp_path / "a.json"), "Приморский").count() == 2
    got = spark.createDataFrame([("a", None, None), (None, "s", "1"), (None, None, None)], "np string, street string, house string").select(incidents.address(F.col("np"), F.col("street"), F.col("house")))
    assert [r[0] for r in got.collect()] == ["a", "s 1", "адрес не указан"]


def test_posts(spark, tmp_path):
    messages = [{"id": 1, "type": "message", "date": "2024-02-01T10:00:00", "text": ["a ", {"type": "bold", "text": "b"}]}, {"id": 2, "type": "service", "text": "x"}, {"id": 3, "type": "message", "date": "2024-03-01T10:00:00", "text": ""}, {"id": 4, "type": "message", "date": "2024-03-01T10:00:00", "text": "plain words"}]
    (tmp_path / "p.json").write_text(json.dumps({"messages": messages}))
    rows = incidents.read_posts(spark, str(tmp_path / "p.json"))
    assert [(r["post_id"], r["text"], r["month"]) for r in rows.orderBy("post_id").collect()] == [(1, "a b", "2024-02"), (4, "plain words", "2024-03")]
    sinks.write_by_month(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("month=*")) == ["month=2024-02", "month=2024-03"]


def test_brands_boundary_ways(spark, tmp_path):
    (tmp_path / "b.csv").write_text("brand,is_right_hand_drive,confidence,reasoning\nTOYOTA,true,high,x\n,false,low,y\nKIA,false,,z\n")
    assert [(r["brand"], r["is_right_hand_drive"]) for r in incidents.read_brands(spark, str(tmp_path / "b.csv")).collect()] == [("TOYOTA", True)]
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    (tmp_path / "h.json").write_text(json.dumps({"type": "MultiPolygon", "coordinates": [[ring], [ring]]}))
    assert incidents.read_boundary(spark, str(tmp_path / "g.json")).count() == 4 and incidents.read_boundary(spark, str(tmp_path / "h.json")).count() == 8
    way = {"type": "way", "id": 7, "tags": {"highway": "primary", "oneway": "yes", "maxspeed": "60 km"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}
    for name in ("t1", "t2"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"elements": [way, {"type": "way", "id": 8, "geometry": [{"lat": 1, "lon": 2}]}]}))
    ways = incidents.read_ways(spark, [str(tmp_path / "t1.json"), str(tmp_path / "t2.json")]).collect()
    assert [(w["id"], w["class"], w["oneway"], w["maxspeed"], w["wkt"]) for w in ways] == [(7, "primary", True, None, "LINESTRING(2.0 1.0, 4.0 3.0)")]


def test_geojson(spark):
    row = sinks.geojson_features(spark.createDataFrame([(1, 131.9, 43.1)], "id int, lon double, lat double")).first()["value"]
    assert json.loads(row) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [131.9, 43.1]}, "properties": {"id": 1}}


def test_registry_has_one_current_version(spark):
    start = spark.createDataFrame([("m", "v1", True), ("n", "v1", True)], "model_name string, version_path string, is_current boolean")
    rows = {(r["model_name"], r["version_path"]): r["is_current"] for r in register(start, "m", "v2").collect()}
    assert rows == {("m", "v1"): False, ("n", "v1"): True, ("m", "v2"): True}


def test_stream_load_is_idempotent(spark, tmp_path):
    stored, source = str(tmp_path / "stored"), str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 0)], "k long, v string, line long").write.parquet(stored)
    spark.createDataFrame([(1, "x", 1), (2, "b", 2), (2, "c", 3)], "k long, v string, line long").write.parquet(source)
    for run in ("one", "two"):  # the second run has no memory of the first, but finds the keys
        stream = spark.readStream.schema("k long, v string, line long").parquet(source)
        load_new(stream, stored, "k", "line").option("checkpointLocation", str(tmp_path / run)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(stored).collect()) == [(1, "a", 0), (2, "b", 2)]
