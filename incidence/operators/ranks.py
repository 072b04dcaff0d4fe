"""Ranks and exact quantiles over whole tables, in range partitions whose counts are summed up; no task holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidence.sources.files import materialize


def _offsets(parts: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """by, _part, _before, _total: the weights of the parts before a part, and of all parts, of each group."""
    sums = parts.groupBy(*by, "_part").agg(F.sum(weight).alias("_sum"))
    group = Window.partitionBy(*by)  # rows: one per range partition
    before = F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*by, "_part", before.alias("_before"), F.sum("_sum").over(group).alias("_total"))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place", by: Sequence[str] = ()) -> DataFrame:
    """Adds `name`: 1, 2, ... among the rows with equal `by`, in `order`, which must leave no ties."""
    parts = materialize(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    placed = parts.withColumn("_row", within).join(_offsets(parts, by, F.lit(1)), [*by, "_part"])
    return placed.withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before", "_total")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and one column per share: the exact quantile, between two values interpolated, nulls left out.

    Equal values are one row with a count before they are sorted.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    parts = materialize(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    within = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    placed = parts.withColumn("_sum", within).join(_offsets(parts, by, F.col("_n")), [*by, "_part"])
    end = F.col("_before") + F.col("_sum")
    at = lambda rank: F.max(F.when((rank >= end - F.col("_n")) & (rank < end), F.col("_v")))
    found = []
    for name, share in shares.items():
        exact = F.lit(share) * (F.col("_total") - 1)
        found += [at(F.floor(exact)).alias(f"{name}_low"), at(F.ceil(exact)).alias(f"{name}_high"), F.max(exact - F.floor(exact)).alias(f"{name}_between")]
    rows = placed.groupBy(*by).agg(*found)
    return rows.select(*by, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_between")).alias(n) for n in shares])
