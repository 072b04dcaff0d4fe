"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (position in `weights`) that wins the key.

    Every shard draws u in (0, 1) from the hash of (key, shard); the smallest -ln(u) / weight wins, so a shard gets
    keys in proportion to its weight, and adding a shard moves only the keys that the new one wins.
    A null key hashes like any other value (by the shard alone); a shard of weight 0 gets nothing.
    """
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
            u = (bits.cast("double") + 0.5) / float(1 << 53)
            draws.append(F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    if not draws:
        raise ValueError("no shard has a positive weight")
    return (draws[0] if len(draws) == 1 else F.least(*draws))["shard"].cast("int")


def shard_records(
    df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, pieces: int = 1024
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard: one row per row of `df`, in plain column expressions.

    Law `key`: key and shard count alone decide. size is the text's UTF-8 bytes plus 1 (null: 1); grown_shard is the
    shard with one shard more. slot numbers a shard's rows from 0 without gaps: each shard is cut into `pieces` by a
    hash of the row, the pieces' counts are summed up, and rows are numbered within their piece, so that no task
    holds a shard. Equal rows get slots of their own, in any order. Texts are not shuffled, only their digests.
    An empty table gives an empty result; other columns of `df` are ignored.
    """
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(
        df[key].alias(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(df[key], weights).alias("shard"),
        rendezvous(df[key], [*weights, grown_weight]).alias("grown_shard"),
    ).withColumn("_piece", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(pieces)).cast("int"))
    counts = rows.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_piece").orderBy(F.col(key), F.col("text_crc32"))
    return rows.join(starts, ["shard", "_piece"]).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_start") + F.row_number().over(within) - 1).alias("slot"),
        "grown_shard",
    )
