"""Intermediate and final files: lineage cuts, loads that skip what is known, upserts, versioned outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a temporary one in local mode where none is set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.incidence.folder", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="incidence-")
        spark.conf.set("spark.incidence.folder", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder: later readers neither recompute nor depend on an executor."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key isn't stored; of rows with equal keys the first by `order`. Null keys are left out."""
    first = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*incoming.columns), order).alias("_row")).select("_row.*")
    return first.join(stored.select(key), key, "left_anti").select(*incoming.columns)


def upserted(stored: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """`stored` with the rows of `changes` in place of those with the same key, and the new ones added.

    Of several changes with one key the last by `order` counts, or, without an order, the greatest row.
    """
    row = F.struct(*stored.columns)
    last = changes.groupBy(key).agg(F.max_by(row, F.struct(order, row) if order else row).alias("_row")).select("_row.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last.select(*stored.columns))


def load_counts(incoming: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """added, skipped, errors of a load: rows that `new_rows` adds, rows whose key is stored or comes again, rows without a key."""
    total = incoming.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(key).isNull()).alias("errors"))
    added = new_rows(incoming, stored, key, order).agg(F.count(F.lit(1)).alias("added"))
    return total.crossJoin(added).select("added", (F.col("total") - F.col("errors") - F.col("added")).alias("skipped"), "errors")  # single rows


def sound_rows(incoming: DataFrame, key: str, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that pass all tests and have a key of their own, and the others with the names of what they fail.

    What a batch insert with a fall-back to single rows does: one bad row doesn't keep the others out.
    """
    (name,) = [n for n in ("_faults", "_faults_", "_faults__") if n not in incoming.columns][:1]
    faults = F.filter(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()], F.when(F.col(key).isNull(), F.lit("no key"))), lambda x: x.isNotNull())
    marked = incoming.withColumn(name, faults)
    good = marked.where(F.size(name) == 0).drop(name)
    first = good.groupBy(key).agg(F.min(F.struct(*good.columns)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    again = first.where("_n > 1").select(key).join(good, key).select(*good.columns).exceptAll(first.where("_n > 1").select("_row.*").select(*good.columns))
    bad = marked.where(F.size(name) > 0).withColumnRenamed(name, "faults").unionByName(again.withColumn("faults", F.array(F.lit("key comes again"))))
    return first.select("_row.*").select(*incoming.columns), bad


def register(versions: DataFrame, name: str, path: str) -> DataFrame:
    """A version registry with one more version of `name`, the only current one of that name."""
    kept = versions.withColumn("is_current", F.col("is_current") & (F.col("model_name") != name))
    return kept.unionByName(versions.sparkSession.createDataFrame([(name, path, True)], kept.select("model_name", "version_path", "is_current").schema))
