"""Hotspots in detail: place, extent, distances, severities, most frequent values, colours and countermeasures of the clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidence.functions.geo import project
from incidence.model import ROLES, accidents
from incidence.operators.clustering import dbscan
from incidence.operators.ranks import quantiles
from incidence.operators.recommend import profile, profile_sql, recommend, recommend_sql
from incidence.plans.base import query
from incidence.plans.spatial import ACCIDENTS, DBSCAN_SQL, POINTS_SQL, RING, _flat, points
from incidence.functions.geo import inside, inside_sql

#: Colours of the map and of the report by the share of deadly accidents, from the highest share down.
MAP_COLOURS = ((0.05, "#c0392b"), (0.03, "#e67e22"), (0.02, "#f39c12"), (None, "#3498db"))
REPORT_COLOURS = ((0.15, "#8e44ad"), (0.10, "#e74c3c"), (0.06, "#e67e22"), (0.03, "#f1c40f"), (None, "#27ae60"))
TOP = 5


def colour(share: Column, scale: tuple) -> Column:
    """The colour of the first step that the share reaches."""
    out = F.lit(scale[-1][1])
    for least, name in reversed(scale[:-1]):
        out = F.when(share >= least, name).otherwise(out)
    return out


def colour_sql(share: str, scale: tuple) -> str:
    return "case " + " ".join(f"when {share} >= {least}e0 then '{name}'" for least, name in scale[:-1]) + f" else '{scale[-1][1]}' end"


def street_key(np: Column, street: Column) -> Column:
    """'town / street', as streets of a name are in many towns; else whichever of the two is there; else null."""
    town, way = F.coalesce(F.trim(np), F.lit("")), F.coalesce(F.trim(street), F.lit(""))
    return F.when((town != "") & (way != ""), F.concat(town, F.lit(" / "), way)).otherwise(F.nullif(F.concat(town, way), F.lit("")))


def top_values(rows: DataFrame, key: str, fields: dict[str, Column], n: int = TOP) -> DataFrame:
    """key and per field the n most frequent values as 'value:count', commas between; ties by value, nulls and empty ones left out."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()])
    counts = rows.select(key, F.inline(named)).where("value <> ''").groupBy(key, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "field").orderBy(F.desc("n"), "value"))  # a row per distinct value
    best = counts.withColumn("place", place).where(F.col("place") <= n)
    told = F.concat_ws(":", "value", F.col("n").cast("string"))
    lists = {f: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("place", told.alias("told"))))), lambda x: x["told"]), ",").alias(f) for f in fields}
    return best.groupBy(key).agg(*lists.values())


def hotspot_table(rows: DataFrame, key: str = "cluster") -> DataFrame:
    """One row per cluster of rows with id, lat, lon, x, y (metres), severity, em_type, np, place."""
    n, part = F.count(F.lit(1)), lambda test: F.round(F.count_if(test) / F.count(F.lit(1)), 6)
    sums = rows.groupBy(key).agg(
        n.alias("n_points"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.min("lat"), 6).alias("min_lat"), F.round(F.max("lat"), 6).alias("max_lat"),
        F.round(F.min("lon"), 6).alias("min_lon"), F.round(F.max("lon"), 6).alias("max_lon"), part(F.col("severity") == "dead").alias("pct_dead"), part(F.col("severity").isin("dead", "severe", "severe_multiple")).alias("pct_severe_or_dead"), F.min("id").alias("first_id"),
    )
    far = rows.join(sums.select(key, "mx", "my"), key).withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)))
    radius = far.groupBy(key).agg(F.round(F.max("d"), 2).alias("radius_m"))
    middle = quantiles(far, [key], "d", {"median_m": 0.5}).withColumn("median_m", F.round("median_m", 2))
    values = top_values(rows, key, {"severities": F.col("severity"), "em_types": F.col("em_type"), "towns": F.col("np"), "streets": street_key(F.col("np"), F.col("place"))})
    out = sums.drop("mx", "my").join(radius, key).join(middle, key).join(values, key)
    return out.withColumns({"map_colour": colour(F.col("pct_dead"), MAP_COLOURS), "report_colour": colour(F.col("pct_dead"), REPORT_COLOURS)})


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents with the cluster of their place, in metres too; those in no cluster left out."""
    found = dbscan(_flat(points(spark, sf_dir)), 300.0, 15).where("cluster >= 0").select(F.col("id").alias("k"), "cluster")
    rows = accidents(spark, sf_dir).join(found, "k")
    x, y = project(F.col("lat"), F.col("lon"), 43.3, 132.2)
    return rows.withColumns({"x": x, "y": y})


CLUSTERED = DBSCAN_SQL + "," + ROLES["accidents"] + """,
clustered as (select a.*, found.cluster, flat.x, flat.y from accidents a join found on a.k = found.id and found.cluster >= 0 join flat on flat.id = a.k)"""


def _top_sql(name: str, value: str) -> str:
    return f"""
{name} as (select cluster, string_agg(value || ':' || n, ',' order by place) as {name} from (
  select cluster, {value} as value, count(*) as n, row_number() over (partition by cluster order by count(*) desc, {value}) as place from clustered group by cluster, {value}) where place <= {TOP} group by cluster)"""


@query(CLUSTERED + """,
means as (select cluster, avg(x) as mx, avg(y) as my from clustered group by cluster),
far as (select c.cluster, sqrt(pow(x - mx, 2) + pow(y - my, 2)) as d from clustered c join means using (cluster)),
spread as (select cluster, round(max(d), 2) as radius_m, round(quantile_cont(d, 0.5), 2) as median_m from far group by cluster),""" + ",".join(_top_sql(n, v) for n, v in (("severities", "severity"), ("em_types", "em_type"), ("towns", "np"), ("streets", "np || ' / ' || place"))) + f""",
sums as (
  select cluster, count(*) as n_points, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, round(min(lat), 6) as min_lat, round(max(lat), 6) as max_lat, round(min(lon), 6) as min_lon, round(max(lon), 6) as max_lon,
         round(count(*) filter (where severity = 'dead') * 1e0 / count(*), 6) as pct_dead, round(count(*) filter (where severity in ('dead', 'severe', 'severe_multiple')) * 1e0 / count(*), 6) as pct_severe_or_dead, min(id) as first_id
  from clustered group by cluster)
select *, {colour_sql('pct_dead', MAP_COLOURS)} as map_colour, {colour_sql('pct_dead', REPORT_COLOURS)} as report_colour
from sums join spread using (cluster) join severities using (cluster) join em_types using (cluster) join towns using (cluster) join streets using (cluster)""")
def hotspot_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accidents' clusters with their place, distances, most frequent values and colours."""
    return hotspot_table(clustered(spark, sf_dir))


@query(CLUSTERED + ", " + profile_sql("clustered", "cluster") + ", " + recommend_sql("cluster", 3))
def recommend_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best countermeasures of each cluster."""
    return recommend(profile(clustered(spark, sf_dir), "cluster"), "cluster", 3)


def edge_distance(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Degrees, flat, from a point to the nearest edge of a polygon."""
    each = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        dx, dy = x2 - x1, y2 - y1
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy)))
        each.append(F.sqrt(F.pow(lon - (t * dx + x1), 2) + F.pow(lat - (t * dy + y1), 2)))
    return F.least(*each)


def edge_distance_sql(lon: str, lat: str, ring: list[tuple[float, float]]) -> str:
    each = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        dx, dy = x2 - x1, y2 - y1
        t = f"greatest(0e0, least(1e0, (({lon} - {x1}e0) * {dx!r}::double + ({lat} - {y1}e0) * {dy!r}::double) / {dx * dx + dy * dy!r}::double))"
        each.append(f"sqrt(pow({lon} - ({t} * {dx!r}::double + {x1}e0), 2) + pow({lat} - ({t} * {dy!r}::double + {y1}e0), 2))")
    return "least(" + ", ".join(each) + ")"


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen at random, the same for a seed: those whose key and seed hash first."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


@query("with " + POINTS_SQL + f""",
marked as (select *, {inside_sql('lon', 'lat', RING)} as is_inside from points),
placed as (select *, row_number() over (partition by is_inside order by md5(id || ':42'), id) as place from marked where is_inside or (lon between 130 and 140 and lat between 42 and 49))
select id, is_inside, round({edge_distance_sql('lon', 'lat', RING)}, 6) as edge_degrees from placed where place <= 50""")
def boundary_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty points inside the region and fifty outside it but close, with their distance to its border."""
    rows = points(spark, sf_dir).withColumn("is_inside", inside(F.col("lon"), F.col("lat"), RING))
    near = rows.where(~F.col("is_inside") & F.col("lon").between(130, 140) & F.col("lat").between(42, 49))
    both = seeded_sample(rows.where("is_inside"), "id", 50).unionByName(seeded_sample(near, "id", 50))
    return both.select("id", "is_inside", F.round(edge_distance(F.col("lon"), F.col("lat"), RING), 6).alias("edge_degrees"))


@query(ACCIDENTS + " select id, np, severity from accidents order by md5(id || ':7'), id limit 50")
def sampled_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_sample(accidents(spark, sf_dir).select("id", "np", "severity"), "id", 50, seed=7)
