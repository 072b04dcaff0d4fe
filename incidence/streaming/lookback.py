"""Posts matched, as they arrive, with the incidents of the days before: an interval join of two streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidence.sources.files import shared_folder


def look_back(posts: DataFrame, incidents: DataFrame, key: str, days: int = 3, late: str = "2 days") -> DataFrame:
    """Pairs of a post and an incident with its key, not after it and at most `days` before it.

    `posts` has post_id, `at` and the key, `incidents` has incident_id, `at` and the key; either may be a stream or a
    table, and the plan is the same. Both sides have a watermark `late` behind their latest time. An incident leaves
    the state when no post that is still let in can reach back to it, a post when no incident can still come that is
    not after it, so the state is what `days` and `late` hold, however long the streams run. A row that comes after
    the watermark of the batches before it has passed its time is dropped; rows within `late` are never lost. Null
    keys and times meet nothing.
    """
    left = posts.select("post_id", F.col(key).alias("_key"), F.col("at").alias("posted")).withWatermark("posted", late)
    right = incidents.select("incident_id", F.col(key).alias("_other"), F.col("at").alias("happened")).withWatermark("happened", late)
    near = (F.col("happened") <= F.col("posted")) & (F.col("happened") >= F.col("posted") - F.expr(f"interval {days} days"))
    return left.join(right, (F.col("_key") == F.col("_other")) & near).select("post_id", F.col("_key").alias(key), "posted", "incident_id", "happened")


def run_look_back(pairs: DataFrame, spark: SparkSession, on_progress=None) -> DataFrame:
    """Runs the stream of `look_back` over what its sources hold now and returns the pairs told.

    Each batch replaces the folder of its own number, so one that is done again after a failure adds nothing twice.
    """
    place = f"{shared_folder(spark)}/lookback-{uuid.uuid4().hex}"
    run = (
        pairs.writeStream.outputMode("append")
        .foreachBatch(lambda batch, nr: batch.write.mode("overwrite").parquet(f"{place}/out/batch={nr}"))
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    if on_progress is not None:
        on_progress(run.recentProgress)
    return spark.read.schema(pairs.schema).parquet(f"{place}/out").select(*pairs.columns)


def event_sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purchases as posts and clicks as incidents, of a stream or table of events."""
    at = F.col("ts").cast("timestamp")
    posts = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("post_id"), "user_id", at.alias("at"))
    return posts, rows.where("event_type = 'click'").select(F.col("event_id").alias("incident_id"), "user_id", at.alias("at"))


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The table at `path` (a file, or a folder of files) as a stream of its files, oldest first."""
    from incidence.streaming.daily import _is_file

    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)
