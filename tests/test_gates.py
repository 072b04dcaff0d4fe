"""Gates, versions, chains, loads and sinks."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from incidence.operators import gates
from incidence.operators.ranks import numbered, quantiles
from incidence.sources import files, incidents, sinks
from incidence.streaming.daily import load_once


def test_failures():
    assert gates.forecast_failures(30.0) == gates.forecast_failures(None) == [] and gates.forecast_failures(30.1)
    assert gates.severity_failures(0.5, 0.059) == gates.severity_failures(0.5, float("nan")) == [] and len(gates.severity_failures(0.49, 0.06)) == 2


def test_release(spark, tmp_path):
    folder = f"file://{tmp_path}/models"
    none = gates.read_registry(spark, folder)
    one = gates.release(none, folder, "m", "p1", 10, {"mape": 5}, [])
    gates.release(gates.read_registry(spark, folder), folder, "m", "p2", 20, {}, [])
    with pytest.raises(gates.GateError):
        gates.release(gates.read_registry(spark, folder), folder, "m", "p3", 30, {}, ["MAPE 31.0% > 30%"])
    rows = {r["version_path"]: r["is_current"] for r in gates.read_registry(spark, folder).collect()}
    assert one.count() == 1 and rows == {"p1": False, "p2": True, "p3": False}
    assert gates.current_artifacts(spark, folder, {"m": lambda _, p: p, "n": lambda _, p: p}) == {"m": "p2", "n": None}


def test_chain(spark, tmp_path):
    def broken(_):
        raise ValueError("no")

    journal = f"file://{tmp_path}/journal"
    states = gates.run_chain(spark, {"ingest": lambda s: s.range(1).count(), "snap": broken, "mail": lambda s: None}, journal)
    assert states == {"ingest": "done", "snap": "failed", "mail": "done"}
    assert gates.run_chain(spark, {"ingest": broken, "snap": lambda s: None}, journal, needed=("ingest",)) == {"ingest": "failed", "snap": "skipped"}
    assert spark.read.schema(gates.JOURNAL).json(journal).count() == 5


def test_journal_payload_and_long_errors(spark, tmp_path):
    import json

    journal = f"file://{tmp_path}/journal"

    def fails(_):
        raise ValueError("x" * 9_000)

    gates.run_chain(spark, {"load": lambda s: {"added": 3, "source": "new"}, "plain": lambda s: 5, "bad": fails}, journal, payload={"source": "api", "run": 1})
    rows = {r["task"]: r for r in spark.read.schema(gates.JOURNAL).json(journal).collect()}
    assert json.loads(rows["load"]["payload"]) == {"source": "new", "run": 1, "added": 3} and json.loads(rows["plain"]["payload"]) == {"source": "api", "run": 1}
    assert len(rows["bad"]["error"]) == 8_000 and rows["load"]["error"] is None


def test_due():
    monday = datetime(2024, 4, 1, 7)
    assert gates.due(monday, {}) == list(gates.CADENCES) and gates.due(monday.replace(hour=2), {}) == []
    assert gates.due(monday.replace(day=2), {"health": monday}) == ["health"] and gates.due(monday, dict.fromkeys(gates.CADENCES, monday)) == []


def test_ranks_and_quantiles(spark):
    rows = spark.createDataFrame([(g, i, float(i * i % 17)) for g in "ab" for i in range(50)] + [("c", 0, None), ("d", 0, 3.0)], "g string, i int, v double")
    place = numbered(rows, [F.desc_nulls_last("v"), F.col("i"), F.col("g")], "p").toPandas().sort_values("p")
    assert list(place["p"]) == list(range(1, 103)) and list(place["v"].dropna()) == sorted(place["v"].dropna(), reverse=True)
    found = {r["g"]: r for r in quantiles(rows, ["g"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    want = {r["g"]: r for r in rows.groupBy("g").agg(F.percentile("v", F.lit(0.1)).alias("low"), F.percentile("v", F.lit(0.5)).alias("mid")).collect()}
    assert set(found) == {"a", "b", "d"} and all(found[g]["low"] == pytest.approx(want[g]["low"]) and found[g]["mid"] == want[g]["mid"] for g in found)


def test_loads(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, files.upserted(stored, changes, "k").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    incoming = spark.createDataFrame([(1, "x"), (5, "y"), (5, "z"), (None, "n")], "k int, v string")
    assert tuple(files.load_counts(incoming, stored, "k", "v").first()) == (1, 2, 1)
    good, bad = files.sound_rows(incoming, "k", {"short": F.length("v") < 2, "not x": F.col("v") != "x"})
    assert sorted(map(tuple, good.collect())) == [(5, "y")]
    assert sorted((str(r["k"]), r["faults"]) for r in bad.collect()) == [("1", ["not x"]), ("5", ["key comes again"]), ("None", ["no key"])]


def test_sinks_and_lines(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("é", 1)], "a string, b int").coalesce(1), f"file://{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith("﻿a,b".encode())
    sinks.write_summary(spark.createDataFrame([(1, 0.12345678, [1, 2, 3]), (9, 0.5, [4])], "n int, x double, ids array<int>"), f"file://{tmp_path}/top", "n", 2, "ids", 2, 3)
    assert [tuple(r) for r in spark.read.json(f"file://{tmp_path}/top").select("n", "x", "ids").collect()] == [(9, 0.5, [4]), (1, 0.123, [1, 2])]
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "2024-01.jsonl").write_text('{"tg_id": 1, "date_published": "2024-01-02", "text": "a", "is_dtp_related": true}\n{"tg_id": 2, "text": "b"}\n')
    (tmp_path / "posts" / "2024-02.jsonl").write_text('{"tg_id": 1, "date_published": "2024-02-02", "text": "later", "is_dtp_related": true}\n')
    assert {(r["post_id"], r["text"]) for r in incidents.read_post_lines(spark, f"file://{tmp_path}/posts").collect()} == {(1, "a"), (2, "b")}
    assert incidents.read_post_lines(spark, f"file://{tmp_path}/posts", True).count() == 1


def test_roads_and_region(spark):
    ways = spark.createDataFrame([([(43.0, 131.0), (43.0, 132.0), (43.0, 131.0)],), ([(1.0, 1.0)],)], "nodes array<struct<lat:double,lon:double>>")
    assert [round(r[0] / 1000) for r in ways.select(incidents.way_length(F.col("nodes"))).collect()] == [163, 0]
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = spark.createDataFrame([(1, 5.0, 5.0, None), (2, 50.0, 5.0, True), (3, None, 5.0, None)], "id int, lon double, lat double, is_in_region boolean")
    ask = lambda force: {r["id"]: r["is_in_region"] for r in incidents.with_region(rows, square, force).collect()}
    assert ask(False) == {1: True, 2: True, 3: None} and ask(True) == {1: True, 2: False, 3: None}


def test_stream_load(spark, tmp_path):
    schema = "k long, v string"
    for i, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
        load_once(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state", "k", "v", schema).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == (2, 3)[i]
