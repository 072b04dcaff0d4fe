"""Writers: JSON lines by month, GeoJSON, CSV for spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_month(df: DataFrame, path: str, month: str = "month") -> None:
    """JSON lines in one folder per month; a run replaces the months that it writes."""
    df.write.partitionBy(month).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def geojson_features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON feature per row as text, the other columns as its properties."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_csv(df: DataFrame, path: str, for_spreadsheets: bool = True) -> None:
    """CSV with a header; for spreadsheets each file starts with the mark by which they know UTF-8.

    The mark is put before the first column's name, as no writer option has it.
    """
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first) if for_spreadsheets else df
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_summary(df: DataFrame, path: str, order: str, top: int = 50, ids: str | None = None, n_ids: int = 10, digits: int = 6) -> None:
    """The `top` rows by `order`, highest first, as JSON: doubles rounded, of an array of ids the first `n_ids`."""
    rows = df.orderBy(F.desc(order)).limit(top)
    rounded = {c: F.round(c, digits) for c, t in rows.dtypes if t == "double"}
    rows = rows.withColumns(rounded) if rounded else rows
    rows = rows.withColumn(ids, F.slice(ids, 1, n_ids)) if ids else rows
    rows.coalesce(1).write.mode("overwrite").json(path)
