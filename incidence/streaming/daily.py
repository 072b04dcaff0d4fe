"""Streams over event files: tumbling daily counts and an idempotent load of new keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidence.sources.files import new_rows, shared_folder


def daily_counts(events: DataFrame) -> DataFrame:
    """Counts per day and type, late by two days at most; the same plan runs over a stream and over a table."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 days")
    counts = stamped.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def run_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Runs the stream over all files of `path` and returns what it has at the end.

    A batch tells the days that it changed, so days that the watermark has passed leave the state. Each batch has a
    folder of its own by its number: one that is done again replaces its own folder only, and readers take of each day
    and type what the last batch said.
    """
    schema = spark.read.parquet(path).schema
    source = path.rpartition("/")
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    stream = files.parquet(path) if not _is_file(spark, path) else files.option("pathGlobFilter", source[2]).parquet(source[0])
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = (
        daily_counts(stream)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, nr: batch.write.mode("overwrite").parquet(f"{place}/out/batch={nr}"))
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    told = spark.read.schema("day string, event_type string, n long, total double, batch long").parquet(f"{place}/out")
    last = told.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("_last"))
    return last.select("day", "event_type", "_last.n", "_last.total")


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether Spark sees one file at `path`, rather than a folder of files."""
    names = spark.read.parquet(path).select(F.input_file_name().alias("f")).limit(1).first()
    return names is None or names["f"].rstrip("/").endswith("/" + path.rpartition("/")[2])


def load_new(stream: DataFrame, stored: str, key: str, order: str):
    """A stream that appends rows with new keys to the files at `stored`; a batch done again finds its keys there.

    The caller names the checkpoint. A batch that is delivered again while its first append still runs can double
    rows; `load_once` can't.
    """

    def append(batch: DataFrame, _: int) -> None:
        new_rows(batch, batch.sparkSession.read.parquet(stored), key, order).write.mode("append").parquet(stored)

    return stream.writeStream.foreachBatch(append)


def load_once(stream: DataFrame, stored: str, checkpoint: str, key: str, order: str, schema: str):
    """A stream that adds rows with new keys to the batches at `stored`, once each, however often a batch is delivered.

    A batch looks for its keys in the folders of the batches before it and replaces its own folder, so one that is done
    again after a failure writes the same rows to the same place. `checkpoint` is the stream's own folder.
    """

    def add(batch: DataFrame, nr: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(schema + ", batch long").parquet(stored) if _exists(spark, stored) else spark.createDataFrame([], schema + ", batch long")
        new_rows(batch, known.where(F.col("batch") < nr), key, order).write.mode("overwrite").parquet(f"{stored}/batch={nr}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
