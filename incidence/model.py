"""The incident model on the driver's tables: accidents, vehicles, participants and points.

Every role has a DataFrame builder and, under the same name in ROLES, the SQL that DuckDB runs for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def severity_of(lost: Column, suffer: Column) -> Column:
    """Fatal beats counts of injured; nobody hurt is a class of its own."""
    return F.when(lost > 0, "dead").when(suffer >= 4, "severe_multiple").when(suffer >= 2, "severe").when(suffer == 1, "light").otherwise("no_injuries")


def is_lost() -> Column:
    """Whether a lineitem stands for a person who died."""
    return (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)


def is_suffering() -> Column:
    return F.col("l_returnflag") == "A"


def model_year() -> Column:
    return F.lit(1990) + F.col("p_size") % 31


def lon_lat(k: Column) -> tuple[Column, Column]:
    """Seven dense towns, from integer arithmetic on a key."""
    u = (k * k * 31 % 1009) / F.lit(1009.0)
    v = (k * k * 57 % 1013) / F.lit(1013.0)
    town = (k % 7).cast("double")
    return F.lit(131.9) + town * 0.1 + u * u * u * 0.08, F.lit(43.1) + town * 0.07 + v * v * v * 0.08


PLACE, PEOPLE, ROADS = {"np", "place", "parent_region"}, {"lost", "suffer", "severity"}, {"roads"}


def accidents(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """One row per order: id, datetime, np, place, parent_region, em_type, light_type, lost, suffer, severity, roads, is_in_region, lon, lat.

    With names in `only`, these columns alone, and no table is read that they don't need.
    """
    wanted = set(only)
    needs = lambda part: not only or bool(wanted & part)
    rows = table(spark, sf_dir, "orders")
    if needs(PLACE):
        place = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = rows.join(place, F.col("o_custkey") == F.col("c_custkey"))
    if needs(PEOPLE | ROADS):
        people = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.count_if(is_lost()).alias("lost"),
            F.count_if(is_suffering()).alias("suffer"),
            F.min("l_partkey").alias("p_partkey"),
        )
        rows = rows.join(people, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if needs(ROADS):
        rows = rows.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("roads")), "p_partkey", "left")
    lost, suffer = F.coalesce("lost", F.lit(0)), F.coalesce("suffer", F.lit(0))
    lon, lat = lon_lat(F.col("o_custkey"))
    columns = {
        "id": F.col("o_orderkey"), "k": F.col("o_custkey"), "datetime": F.col("o_orderdate"), "np": F.col("n_name"), "place": F.col("c_mktsegment"), "parent_region": F.col("r_name"), "em_type": F.col("o_orderpriority"), "light_type": F.col("o_orderstatus"),
        "lost": lost, "suffer": suffer, "severity": severity_of(lost, suffer), "roads": F.col("roads"), "is_in_region": F.col("o_custkey") % 20 != 0, "lon": lon, "lat": lat,
    }
    return rows.select(*[c.alias(n) for n, c in columns.items() if not only or n in wanted])


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand reference: steering side by the parity of the brand number, confidence by its last digit."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    found = table(spark, sf_dir, "part").select("p_brand").distinct().where(number % 5 != 4)
    return found.select(F.col("p_brand").alias("brand"), (number % 2 == 1).alias("is_right_hand_drive"), F.when(number % 3 == 0, "high").when(number % 3 == 1, "medium").otherwise("low").alias("confidence"))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: accident_id, n, mark, prod_type, vehicle_year, is_right_hand_drive and steering_confidence from the reference."""
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(brands(spark, sf_dir), F.col("p_brand") == F.col("brand"), "left")
    return rows.select(
        F.col("l_orderkey").alias("accident_id"), F.col("l_linenumber").alias("n"), F.col("p_brand").alias("mark"), F.col("p_type").alias("prod_type"),
        model_year().alias("vehicle_year"), "is_right_hand_drive", F.coalesce("confidence", F.lit("unknown")).alias("steering_confidence"),
    )


def participant_columns() -> Column:
    """A struct of permille (null: not measured), safety_belt and age of a lineitem."""
    tax = F.round(F.col("l_tax") * 100).cast("int")
    permille = F.when(F.col("l_linenumber") != 7, F.greatest(tax - 5, F.lit(0)) / 10.0)
    return F.struct(permille.alias("permille"), F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("safety_belt"), (F.lit(16) + F.col("l_quantity").cast("int")).alias("age"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: accident_id, permille (null: not measured), safety_belt, age."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("accident_id"), participant_columns().alias("p")).select("accident_id", "p.*")


#: The same roles in DuckDB's SQL, to be put before a query.
ROLES: dict[str, str] = {
    "accidents": """
people as (
  select l_orderkey, count(*) filter (where l_returnflag = 'R' and l_quantity >= 45) as lost, count(*) filter (where l_returnflag = 'A') as suffer,
         min(l_partkey) as first_part from lineitem group by l_orderkey),
accidents as (
  select o_orderkey as id, o_custkey as k, o_orderdate as datetime, n_name as np, c_mktsegment as place, r_name as parent_region, o_orderpriority as em_type,
         o_orderstatus as light_type, coalesce(lost, 0) as lost, coalesce(suffer, 0) as suffer,
         case when coalesce(lost, 0) > 0 then 'dead' when suffer >= 4 then 'severe_multiple' when suffer >= 2 then 'severe' when suffer = 1 then 'light' else 'no_injuries' end as severity,
         p_name as roads, o_custkey % 20 <> 0 as is_in_region,
         131.9e0 + (o_custkey % 7)::double * 0.1e0 + (o_custkey * o_custkey * 31 % 1009) / 1009e0 * ((o_custkey * o_custkey * 31 % 1009) / 1009e0) * ((o_custkey * o_custkey * 31 % 1009) / 1009e0) * 0.08e0 as lon,
         43.1e0 + (o_custkey % 7)::double * 0.07e0 + (o_custkey * o_custkey * 57 % 1013) / 1013e0 * ((o_custkey * o_custkey * 57 % 1013) / 1013e0) * ((o_custkey * o_custkey * 57 % 1013) / 1013e0) * 0.08e0 as lat
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  left join people on o_orderkey = l_orderkey left join part on first_part = p_partkey)""",
    "vehicles": """
numbers as (select distinct p_brand as brand, regexp_extract(p_brand, '([0-9]+)', 1)::int as number from part),
brands as (
  select brand, number % 2 = 1 as is_right_hand_drive, case number % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence from numbers where number % 5 <> 4),
vehicles as (
  select l_orderkey as accident_id, l_linenumber as n, p_brand as mark, p_type as prod_type, 1990 + p_size % 31 as vehicle_year, is_right_hand_drive,
         coalesce(confidence, 'unknown') as steering_confidence
  from lineitem join part on l_partkey = p_partkey left join brands on p_brand = brand)""",
    "participants": """
participants as (
  select l_orderkey as accident_id, case when l_linenumber <> 7 then greatest(round(l_tax * 100)::int - 5, 0) / 10e0 end as permille,
         case when l_linestatus = 'O' then 'yes' else 'no' end as safety_belt, 16 + l_quantity::int as age from lineitem)""",
}


def with_roles(*names: str) -> str:
    return "with " + ",".join(ROLES[n] for n in names)
