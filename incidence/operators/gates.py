"""Model gates and versions: a version that fails its gate is kept for the record but doesn't become current."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most a forecast may be off in percent, and what a severity model must reach.
MOST_MAPE, LEAST_F1, MOST_ECE = 30.0, 0.50, 0.06
VERSIONS = "model_name string, version_path string, is_current boolean, trained_rows long, metadata string"
JOURNAL = "task string, status string, started_at timestamp, duration_ms long, error string, payload string"
#: Characters of an error that the journal keeps.
ERROR_CHARS = 8_000


class GateError(RuntimeError):
    """A model failed its gate; its version was registered, but not as the current one."""


def forecast_failures(mape: float | None) -> list[str]:
    """Why a forecast may not go live; an unknown error passes."""
    return [] if mape is None or mape <= MOST_MAPE else [f"MAPE {mape:.1f}% > {MOST_MAPE:.0f}%"]


def severity_failures(f1_macro: float, ece_dead: float | None) -> list[str]:
    """Why a severity model may not go live; an unknown calibration error passes."""
    failures = [] if f1_macro >= LEAST_F1 else [f"f1_macro {f1_macro:.3f} < {LEAST_F1}"]
    known = ece_dead is not None and ece_dead == ece_dead
    return failures + ([f"ece_dead {ece_dead:.4f} >= {MOST_ECE}"] if known and ece_dead >= MOST_ECE else [])


def registered(versions: DataFrame, name: str, path: str, rows: int, metadata: Mapping, failures: list[str]) -> DataFrame:
    """`versions` with one more of `name`: the only current one of that name, or, with failures, not current beside the old."""
    told = json.dumps({**metadata, "blocked": failures} if failures else dict(metadata), sort_keys=True, default=str)
    kept = versions if failures else versions.withColumn("is_current", F.col("is_current") & (F.col("model_name") != name))
    return kept.unionByName(versions.sparkSession.createDataFrame([(name, path, not failures, rows, told)], VERSIONS))


def release(versions: DataFrame, folder: str, name: str, path: str, rows: int, metadata: Mapping, failures: list[str]) -> DataFrame:
    """Registers a version and writes the registry as a new version of itself; a failed gate is an error after that.

    The registry's files are never changed: each state has a folder of its own with the time in its name, and readers
    take the last one that was written whole (Spark marks it), so there is no moment without a registry.
    """
    out = registered(versions, name, path, rows, metadata, failures)
    at = f"{folder}/registry-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    out.coalesce(1).write.json(at)
    if failures:
        raise GateError(f"{name}: {'; '.join(failures)}; {path} was kept but not made current")
    return out


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole state of the registry in `folder`; empty if there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in files.listStatus(root)] if files.exists(root) else []
    whole = sorted(p for p in found if p.rpartition("/")[2].startswith("registry-") and files.exists(jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS")))
    return spark.read.schema(VERSIONS).json(whole[-1]) if whole else spark.createDataFrame([], VERSIONS)


def current_artifacts(spark: SparkSession, folder: str, readers: Mapping[str, Callable[[SparkSession, str], object]]) -> dict[str, object]:
    """What `readers` (by model name) load from the current versions; models without a current version are None."""
    paths = {r["model_name"]: r["version_path"] for r in read_registry(spark, folder).where("is_current").collect()}  # a row per model
    return {name: read(spark, paths[name]) if name in paths else None for name, read in readers.items()}


def run_chain(spark: SparkSession, steps: Mapping[str, Callable[[SparkSession], object]], journal: str, needed: tuple[str, ...] = (), payload: Mapping[str, object] | None = None) -> dict[str, str]:
    """Runs steps in order and appends each to the journal (JSON files): name -> done, failed or skipped.

    A step that fails doesn't stop the others, but for those after a failed step that is in `needed`. A step's entry has
    `payload`, what is known of the run, and over it what the step gives back, if that is a mapping, as JSON.
    """
    states: dict[str, str] = {}
    for name, step in steps.items():
        began, error, told = datetime.now(timezone.utc), None, dict(payload or {})
        if any(states.get(n) in ("failed", "skipped") for n in needed if n != name):
            states[name] = "skipped"
        else:
            try:
                given = step(spark)
                told |= given if isinstance(given, Mapping) else {}
                states[name] = "done"
            except Exception as e:
                states[name], error = "failed", str(e)[:ERROR_CHARS]
        took = int((datetime.now(timezone.utc) - began).total_seconds() * 1000)
        noted = json.dumps(told, ensure_ascii=False, default=str) if told else None
        spark.createDataFrame([(name, states[name], began, took, error, noted)], JOURNAL).coalesce(1).write.mode("append").json(journal)
    return states


#: When the jobs are due: day of the week (0 is Monday) or of the month, if any, and hour.
CADENCES = {"ingest": ("week", 0, 3), "retrain forecast": ("month", 1, 4), "retrain severity": ("month", 1, 5), "health": (None, None, 6)}


def due(now: datetime, last: Mapping[str, datetime], cadences: Mapping[str, tuple] = CADENCES) -> list[str]:
    """Names of the jobs whose latest due hour has passed since their last run, in the order of the table."""
    out = []
    for name, (unit, day, hour) in cadences.items():
        ran = last.get(name)
        on_day = unit is None or (now.weekday() if unit == "week" else now.day) == day
        if on_day and now.hour >= hour and (ran is None or ran.date() < now.date()):
            out.append(name)
    return out
