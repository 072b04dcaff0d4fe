"""The look-back join of two streams against the join of tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from incidence.streaming.lookback import event_sides, event_stream, look_back, run_look_back

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


def write(spark, folder, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{i}")


def pairs(df):
    return sorted((r["post_id"], r["incident_id"]) for r in df.collect())


def streamed(spark, folder, n, **how):
    """The pairs of the stream, a file per batch, in the order of the files; and its progress."""
    import os
    import shutil

    flat = f"{folder}/flat"
    os.makedirs(flat)
    for i in range(n):
        (name,) = [f for f in os.listdir(f"{folder}/part{i}") if f.endswith(".parquet")]
        shutil.copy(f"{folder}/part{i}/{name}", f"{flat}/{i:04d}.parquet")
        os.utime(f"{flat}/{i:04d}.parquet", (i + 1, i + 1))
    told = []
    rows = event_stream(spark, flat, files_per_batch=1)
    out = run_look_back(look_back(*event_sides(rows), "user_id", **how), spark, told.extend)
    return out, told


def plain(rows, days=3):
    posts = [r for r in rows if r[3] == "purchase" and r[2] is not None and r[1] is not None]
    clicks = [r for r in rows if r[3] == "click" and r[2] is not None and r[1] is not None]
    return sorted((p[0], c[0]) for p in posts for c in clicks if p[2] == c[2] and dt.timedelta(0) <= p[1] - c[1] <= dt.timedelta(days=days))


def event(rng, nr, hours):
    return (nr, START + dt.timedelta(hours=hours), rng.choice([1, 2, 3, None]), rng.choice(["purchase", "click", "view"]))


def test_the_stream_tells_what_the_tables_tell(spark, tmp_path):
    """Twenty days in ten batches, rows up to two days late: nothing is lost, and state does not pile up."""
    rng = random.Random(1)
    files = [[event(rng, 1000 * day + i, 48 * day + rng.uniform(-40, 8)) for i in range(60)] for day in range(10)]
    write(spark, tmp_path, files)
    rows = [r for f in files for r in f]
    out, progress = streamed(spark, tmp_path, 10)
    want = plain(rows)
    assert pairs(out) == want and len(want) > 200
    table = spark.createDataFrame(rows, SCHEMA)
    assert pairs(look_back(*event_sides(table), "user_id")) == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # Three days to look back, two of lateness, and up to two batches until the watermark moves.
    assert max(held) < len(rows) * 0.6 and held[-1] < 5 * 60


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    files = [
        [(1, at(0), 7, "click"), (2, at(1), 7, "purchase")],
        [(3, at(200), 7, "click"), (4, at(201), 7, "purchase")],
        [(5, at(202), 7, "view")],
        [(6, at(3), 7, "purchase"), (7, at(190), 7, "purchase"), (8, at(185), 7, "click")],  # 6 is far behind, 7 and 8 are within two days
        [(9, at(203), 7, "purchase")],
    ]
    write(spark, tmp_path, files)
    out, _ = streamed(spark, tmp_path, len(files))
    assert pairs(out) == [(2, 1), (4, 3), (4, 8), (7, 8), (9, 3), (9, 8)]


def test_null_keys_and_no_rows(spark, tmp_path):
    write(spark, tmp_path, [[(1, START, None, "click"), (2, START, None, "purchase"), (3, None, 1, "click"), (4, START, 1, "purchase")]])
    out, _ = streamed(spark, tmp_path, 1)
    assert pairs(out) == []
    none = spark.createDataFrame([], SCHEMA)
    assert look_back(*event_sides(none), "user_id").count() == 0


@pytest.mark.parametrize("days", [0, 1])
def test_borders_of_the_interval_count(spark, days):
    rows = [(1, START, 1, "click"), (2, START + dt.timedelta(days=days), 1, "purchase"), (3, START - dt.timedelta(seconds=1), 1, "click")]
    out = look_back(*event_sides(spark.createDataFrame(rows, SCHEMA)), "user_id", days=days)
    assert pairs(out) == [(2, 1)] and out.select(F.col("posted") >= F.col("happened")).first()[0]
