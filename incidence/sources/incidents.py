"""Readers for incident archives, posts, brand lists, boundaries and road ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidence.functions.geo import haversine, inside
from incidence.functions.text import flattened
from incidence.model import severity_of
from incidence.sources.jsonarray import read_array

PERSON = "PART_TYPE string, SEX string, SAFETY_BELT string, V_ST int, ALCO double"
VEHICLE = f"N_TS int, MARK_TS string, MODEL_TS string, G_V int, COLOR_TS string, T_TS string, PERSONS array<struct<{PERSON}>>"
INCIDENT = (
    f"EM_NUMBER string, EM_DATE string, EM_TYPE string, LAT string, LNG string, POINT struct<coordinates:array<double>>, REGIONS array<string>, NP string, STREET string, HOUSE string, ROADS string, ROAD_KM double, "
    f"LIGHT_TYPE string, CLOUDS array<string>, LOST_AMOUNT int, SUFFER_AMOUNT int, VEHICLES array<struct<{VEHICLE}>>, PERSONS array<struct<{PERSON}>>"
)


def read_incidents(spark: SparkSession, path: str, region: str | None = None, multiline: bool = True) -> DataFrame:
    """Raw records of a JSON array (or of JSON lines), those of a region only if one is given."""
    rows = spark.read.schema(INCIDENT).option("multiLine", multiline).json(path)
    return rows if region is None else rows.where(F.exists("REGIONS", lambda r: r.contains(region)))


def read_incident_array(spark: SparkSession, path: str, region: str | None = None, split: int = 64 << 20) -> DataFrame:
    """What `read_incidents` gives for one JSON array, in tasks of `split` bytes; elements that can't be of the region aren't parsed."""
    rows = read_array(spark, path, INCIDENT, region or "", split)
    return rows if region is None else rows.where(F.exists("REGIONS", lambda r: r.contains(region)))


def coordinates(lat: Column, lon: Column, point: Column) -> tuple[Column, Column]:
    """Latitude and longitude from their fields or else the point; exchanged where they only fit that way; else null."""
    y, x = F.coalesce(F.expr("try_cast(LAT as double)") if lat is None else lat, F.get(point, 0)), F.coalesce(F.expr("try_cast(LNG as double)") if lon is None else lon, F.get(point, 1))
    fits = lambda a, b: a.between(-90, 90) & b.between(-180, 180)
    return F.when(fits(y, x), y).when(fits(x, y), x), F.when(fits(y, x), x).when(fits(x, y), y)


def accidents(raw: DataFrame) -> DataFrame:
    """One row per record with a number and a date: counts default to 0, severity and place worked out."""
    lat, lon = coordinates(None, None, F.col("POINT.coordinates"))
    lost, suffer = F.coalesce("LOST_AMOUNT", F.lit(0)), F.coalesce("SUFFER_AMOUNT", F.lit(0))
    moment = F.expr("try_to_timestamp(EM_DATE)").cast("timestamp_ntz")
    country = "Российская Федерация"
    rows = raw.where(F.col("EM_NUMBER").isNotNull() & moment.isNotNull())
    return rows.select(
        F.col("EM_NUMBER").alias("external_id"), moment.alias("datetime"), F.col("EM_TYPE").alias("em_type"), lat.alias("lat"), lon.alias("lon"), F.get(F.filter("REGIONS", lambda r: ~r.contains(country)), 0).alias("parent_region"),
        F.col("NP").alias("np"), F.col("STREET").alias("street"), F.col("HOUSE").alias("house"), F.col("ROADS").alias("roads"), F.col("ROAD_KM").alias("road_km"), F.col("LIGHT_TYPE").alias("light_type"), F.col("CLOUDS").alias("clouds"),
        lost.alias("lost_amount"), suffer.alias("suffer_amount"), severity_of(lost, suffer).alias("severity"), F.to_json(F.struct("*")).alias("raw_data"),
    )


def _people(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys, F.col("p.PART_TYPE").alias("part_type"), F.col("p.SEX").alias("sex"), F.col("p.SAFETY_BELT").alias("safety_belt"), F.col("p.V_ST").alias("driver_service_length"), F.col("p.ALCO").cast("decimal(5,3)").alias("med_result_permille")
    )


def vehicles(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.col("EM_NUMBER").alias("external_id"), F.posexplode("VEHICLES").alias("nr", "v"))
    return rows.select("external_id", "nr", F.col("v.N_TS").alias("n"), F.col("v.MARK_TS").alias("mark"), F.col("v.MODEL_TS").alias("model"), F.col("v.G_V").alias("vehicle_year"), F.col("v.COLOR_TS").alias("color"), F.col("v.T_TS").alias("prod_type"))


def participants(raw: DataFrame) -> DataFrame:
    """People inside vehicles, with the vehicle's number in its record."""
    rows = raw.select(F.col("EM_NUMBER").alias("external_id"), F.posexplode("VEHICLES").alias("nr", "v")).select("external_id", "nr", F.explode("v.PERSONS").alias("p"))
    return _people(rows, "external_id", "nr")


def pedestrians(raw: DataFrame) -> DataFrame:
    return _people(raw.select(F.col("EM_NUMBER").alias("external_id"), F.explode("PERSONS").alias("p")), "external_id")


def address(np: Column, street: Column, house: Column) -> Column:
    """Town, street and house in one line; a note if there is none."""
    line = F.concat_ws(", ", F.nullif(F.trim(np), F.lit("")), F.nullif(F.trim(F.concat_ws(" ", street, house)), F.lit("")))
    return F.when(line == "", "адрес не указан").otherwise(F.regexp_replace(line, r"\s+", " "))


POST = "id long, type string, date string, text string"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a channel export with a text and a date: post_id, published, month, text, word_count."""
    rows = spark.read.schema(f"messages array<struct<{POST}>>").option("multiLine", True).json(path).select(F.explode("messages").alias("m")).select("m.*")
    text = F.when(F.ltrim("text").startswith("["), flattened(F.col("text"))).otherwise(F.trim("text"))
    rows = rows.where("type = 'message'").select(F.col("id").alias("post_id"), F.expr("try_to_timestamp(date)").cast("timestamp_ntz").alias("published"), text.alias("text"))
    rows = rows.where((F.col("text") != "") & F.col("published").isNotNull())
    return rows.select("*", F.date_format("published", "yyyy-MM").alias("month"), F.size(F.split("text", r"\s+")).alias("word_count"))


def read_post_lines(spark: SparkSession, folder: str, incidents_only: bool = False) -> DataFrame:
    """Posts from JSON lines, one file or folder per month: post_id, date_published, text, is_incident, file; of repeated ids the first file's."""
    rows = spark.read.schema("tg_id long, date_published string, text string, is_dtp_related boolean").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(folder)
    rows = rows.select(F.col("tg_id").alias("post_id"), "date_published", "text", F.coalesce("is_dtp_related", F.lit(False)).alias("is_incident"), F.input_file_name().alias("file")).where("post_id is not null")
    first = rows.groupBy("post_id").agg(F.min_by(F.struct("date_published", "text", "is_incident", "file"), F.struct("file", "date_published", "text")).alias("_row")).select("post_id", "_row.*")
    return first.where("is_incident") if incidents_only else first


def way_length(nodes: Column) -> Column:
    """Metres along a way: the sum of the distances of its nodes, each to the next."""
    step = lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"])
    legs = F.zip_with(F.slice(nodes, 1, F.size(nodes) - 1), F.slice(nodes, 2, F.size(nodes)), step)
    return F.when(F.size(nodes) < 2, 0.0).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, x: s + x))


def write_roads(ways: DataFrame, path: str) -> None:
    """Replaces the roads table: the ways with their length."""
    ways.withColumn("length_m", way_length(F.col("nodes"))).write.mode("overwrite").parquet(path)


def with_region(df: DataFrame, ring: list[tuple[float, float]], force: bool = False) -> DataFrame:
    """is_in_region worked out from lon and lat where it is null, or, by `force`, everywhere; without a place it stays null."""
    known = F.col("is_in_region") if "is_in_region" in df.columns else F.lit(None).cast("boolean")
    placed = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), inside(F.col("lon"), F.col("lat"), ring))
    return df.withColumn("is_in_region", placed if force else F.coalesce(known, placed))


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """The brand list; rows without a brand or confidence are left out."""
    rows = spark.read.schema("brand string, is_right_hand_drive boolean, confidence string, reasoning string").option("header", True).csv(path)
    return rows.na.drop(subset=["brand", "confidence"])


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """One row per ring point of the first feature of a GeoJSON file: polygon, ring, nr, lon, lat (a polygon counts as one of several)."""
    geometry = "type string, coordinates string"
    rows = spark.read.schema(f"type string, coordinates string, features array<struct<geometry:struct<{geometry}>>>").option("multiLine", True).json(path)
    kind, text = F.coalesce(F.get("features", 0)["geometry"]["type"], "type"), F.coalesce(F.get("features", 0)["geometry"]["coordinates"], "coordinates")
    many = F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), "array<array<array<array<double>>>>")
    out = rows.select(F.posexplode(many).alias("polygon", "rings")).select("polygon", F.posexplode("rings").alias("ring", "points"))
    return out.select("polygon", "ring", F.posexplode("points").alias("nr", "p")).select("polygon", "ring", "nr", F.get("p", 0).alias("lon"), F.get("p", 1).alias("lat"))


WAY = "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"


def read_ways(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Road ways of map tiles with two nodes at least, each once (the first tile's): id, class, oneway, maxspeed, wkt, nodes."""
    rows = spark.read.schema(f"elements array<struct<{WAY}>>").option("multiLine", True).json(paths).withColumn("tile", F.input_file_name())
    ways = rows.select("tile", F.explode("elements").alias("w")).select("tile", "w.*").where((F.col("type") == "way") & (F.size("geometry") >= 2))
    first = ways.withColumn("_nr", F.row_number().over(Window.partitionBy("id").orderBy("tile"))).where("_nr = 1")
    line = F.concat(F.lit("LINESTRING("), F.array_join(F.transform("geometry", lambda g: F.concat_ws(" ", g["lon"], g["lat"])), ", "), F.lit(")"))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    oneway = F.coalesce(tag("oneway").isin("yes", "true", "1"), F.lit(False))
    return first.select("id", tag("highway").alias("class"), oneway.alias("oneway"), F.expr("try_cast(try_element_at(tags, 'maxspeed') as int)").alias("maxspeed"), line.alias("wkt"), F.col("geometry").alias("nodes"))
