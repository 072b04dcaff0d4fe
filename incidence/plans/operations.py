"""Loads, upserts, registries, journals and the daily stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidence.model import table
from incidence.plans.base import query
from incidence.sources.files import new_rows, upserted
from incidence.streaming.daily import run_daily_counts
from incidence.streaming.lookback import event_sides, event_stream, look_back, run_look_back


@query("""
with incoming as (select c_custkey % 700 as k, c_name, c_custkey as line from customer), stored as (select s_suppkey as k from supplier),
first as (select k, arg_min(c_name, line) as c_name, min(line) as line from incoming group by k)
select f.k, f.c_name, f.line from first f where f.k not in (select k from stored)""")
def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with keys that aren't stored, the first of each key in the file's order."""
    incoming = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700).alias("k"), "c_name", F.col("c_custkey").alias("line"))
    return new_rows(incoming, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", "line")


@query("""
select n_nationkey as k, case when n_nationkey % 4 = 0 then upper(n_name) || ' 2' else n_name end as name from nation union all select 100, 'NOWHERE'""")
def upsert_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    changes = stored.where("k % 4 = 0").select("k", F.concat(F.upper("name"), F.lit(" 2")).alias("name"))
    return upserted(stored, changes.unionByName(spark.createDataFrame([(100, "NOWHERE")], stored.schema)), "k")


@query("""
with v as (select p_brand as model_name, p_partkey as version, row_number() over (partition by p_brand order by p_partkey desc) = 1 as is_current from part)
select model_name, version, is_current from v where is_current""")
def registry_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one current version of each model."""
    last = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model_name")).agg(F.max("p_partkey").alias("version"))
    return last.withColumn("is_current", F.lit(True))


@query("""
select event_type as task, count(*) as runs, count(*) filter (where value < 0.05 * (select max(value) from events)) as failed, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_run from events
where ts > (select max(ts) from events) - interval 1 day group by event_type""")
def journal_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and failures of each task in the last day of the journal."""
    rows = table(spark, sf_dir, "events")
    ends = rows.agg(F.max("ts").alias("last"), F.max("value").alias("most"))  # a single row
    recent = rows.crossJoin(F.broadcast(ends)).where(F.col("ts") > F.col("last") - F.expr("interval 1 day"))
    return recent.groupBy(F.col("event_type").alias("task")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") < 0.05 * F.col("most")).alias("failed"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def stream_tumbling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the events, the same as in batch."""
    return run_daily_counts(spark, f"{sf_dir}/events.parquet")


@query("""
select p.event_id as post_id, p.user_id, p.ts as posted, c.event_id as incident_id, c.ts as happened from events p join events c on p.user_id = c.user_id and c.ts <= p.ts and c.ts >= p.ts - interval 3 days
where p.event_type = 'purchase' and c.event_type = 'click'""")
def stream_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with its user's clicks of the three days before, told by a join of two streams."""
    pairs = look_back(*event_sides(event_stream(spark, f"{sf_dir}/events.parquet")), "user_id")
    out = run_look_back(pairs, spark)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("posted", "happened")})
