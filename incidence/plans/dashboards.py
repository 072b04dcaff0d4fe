"""Figures of the application's pages that are made from the statistics: shares, averages, ordered tables, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidence.functions.stats import percent
from incidence.model import accidents, participants, table, vehicles, with_roles
from incidence.plans.base import query
from incidence.plans.statistics import fixed_holiday

ACCIDENTS = with_roles("accidents")
GRAVE = ("severe", "severe_multiple", "dead")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


@query(ACCIDENTS + """ select count(*) as total, count(*) filter (where severity = 'dead') as fatal, round(100e0 * count(*) filter (where severity = 'dead') / count(*), 1) as fatal_pct,
round(100e0 * count(*) filter (where severity in ('severe', 'severe_multiple', 'dead')) / count(*), 1) as grave_pct from accidents""")
def home_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accidents, the deadly ones and the shares of deadly and of grave ones."""
    n, dead, grave = F.count(F.lit(1)), F.count_if(F.col("severity") == "dead"), F.count_if(F.col("severity").isin(*GRAVE))
    return accidents(spark, sf_dir, "severity").agg(n.alias("total"), dead.alias("fatal"), percent(dead, n, 1).alias("fatal_pct"), percent(grave, n, 1).alias("grave_pct"))


@query("select year(o_orderdate) as year, count(*) as n, year(o_orderdate) = (select max(year(o_orderdate)) from orders) as is_partial from orders group by 1")
def home_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents per year; the last year is not over."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return years.withColumn("is_partial", F.col("year") == F.max("year").over(Window.partitionBy()))  # a row per year


def delta_to_average(years: DataFrame, forecast: Column, horizon: int) -> DataFrame:
    """mean_of_three: the mean of the last three years of `years` (year, n); delta_pct: how far the forecast, as of a year, is from it."""
    last = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("year", "n")))), 1, 3)  # a row per year
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x["n"]) / F.size(last)
    out = years.agg(mean.alias("mean_of_three")).withColumn("forecast", forecast)
    delta = F.when(F.coalesce("mean_of_three", F.lit(0.0)) == 0, 0.0).otherwise(100.0 * (F.col("forecast") / horizon * 12 - F.col("mean_of_three")) / F.col("mean_of_three"))
    return out.select(F.round("mean_of_three", 4).alias("mean_of_three"), "forecast", F.round(delta, 4).alias("delta_pct"))


@query("""
with years as (select year(o_orderdate) as year, count(*) as n from orders group by 1), mean as (select avg(n) as m from (select n from years order by year desc limit 3))
select round(m, 4) as mean_of_three, 1200e0 as forecast, round(100 * (1200e0 / 6 * 12 - m) / m, 4) as delta_pct from mean""")
def forecast_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast of half a year against the mean of the last three years."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return delta_to_average(years, F.lit(1200.0), 6)


@query(ACCIDENTS + """,
cells as (select np, em_type, count(*) as n from accidents group by all),
rows_ as (select np, sum(n) as n, row_number() over (order by sum(n) desc, np) as row_place from cells group by np),
columns_ as (select em_type, row_number() over (order by sum(n) desc, em_type) as column_place from cells group by em_type)
select np, em_type, row_place, column_place, round(100e0 * c.n / r.n, 2) as pct from cells c join rows_ r using (np) join columns_ using (em_type) where row_place <= 8""")
def np_em_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of accident types in the eight places with the most accidents; rows and columns by their totals."""
    cells = accidents(spark, sf_dir, "np", "em_type").groupBy("np", "em_type").agg(F.count(F.lit(1)).alias("n"))
    by_total = lambda c, name, total: cells.groupBy(c).agg(F.sum("n").alias(total)).withColumn(name, F.row_number().over(Window.orderBy(F.desc(total), c)).cast("long"))
    rows = by_total("np", "row_place", "row_n").where("row_place <= 8")  # rows: places and types, of which there are few
    columns = by_total("em_type", "column_place", "column_n").drop("column_n")
    return cells.join(rows, "np").join(columns, "em_type").select("np", "em_type", "row_place", "column_place", F.round(100.0 * F.col("n") / F.col("row_n"), 2).alias("pct"))


@query(ACCIDENTS + ", days as (select unnest(range(7)) as d) select (d + 1)::bigint as place, ['" + "','".join(WEEKDAYS) + """'][d + 1] as weekday,
count(id) filter (where severity = 'dead') as dead, count(id) filter (where severity in ('severe', 'severe_multiple')) as severe, count(id) filter (where severity = 'light') as light
from days left join accidents on isodow(datetime) - 1 = d group by d""")
def weekday_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities from Monday to Sunday; days without accidents have zeros."""
    day = (F.dayofweek("datetime") + 5) % 7
    kinds = accidents(spark, sf_dir, "datetime", "severity").select(day.alias("d"), F.when(F.col("severity") == "severe_multiple", "severe").otherwise(F.col("severity")).alias("kind"))
    cells = kinds.groupBy("d").pivot("kind", ["dead", "severe", "light"]).count()
    every = spark.range(7).withColumnRenamed("id", "d").join(cells, "d", "left")
    name = F.get(F.array(*map(F.lit, WEEKDAYS)), F.col("d").cast("int"))
    return every.select((F.col("d") + 1).alias("place"), name.alias("weekday"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dead", "severe", "light")])


def last_runs(journal: DataFrame, limit: int = 20) -> DataFrame:
    """The latest runs of a journal (id, task, status, started_at, duration_ms, error), newest first; errors cut to 500 characters."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    return journal.orderBy(F.desc("started_at"), F.desc("id")).limit(limit).withColumn("error", F.substring("error", 1, 500))


@query("""
select event_id as id, event_type as task, case when value < 10 then 'failed' else 'done' end as status, strftime(ts, '%Y-%m-%d %H:%M:%S') as started_at, floor(value * 1000)::bigint as duration_ms,
       case when value < 10 then substr(repeat(event_type || ' failed; ', 60), 1, 500) end as error from events order by ts desc, event_id desc limit 25""")
def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last runs of the journal."""
    failed = F.col("value") < 10
    journal = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("task"), F.when(failed, "failed").otherwise("done").alias("status"), F.col("ts").alias("started_at"), F.floor(F.col("value") * 1000).alias("duration_ms"), F.when(failed, F.repeat(F.concat("event_type", F.lit(" failed; ")), F.lit(60))).alias("error")
    )
    return last_runs(journal, 25).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


def severity_pivot(rows: DataFrame, key: str) -> DataFrame:
    """Counts of deadly and other accidents of each value of `key`, and the share of deadly ones."""
    wide = rows.groupBy(key).pivot("outcome", ["dead", "other"]).count().na.fill(0, ["dead", "other"])
    return wide.withColumn("dead_pct", F.round(100.0 * F.col("dead") / (F.col("dead") + F.col("other")), 4))


@query(with_roles("accidents", "vehicles") + """,
named as (select case when is_right_hand_drive then 'right' when not is_right_hand_drive then 'left' end as wheel, severity from vehicles join accidents on accident_id = id),
counts as (select wheel, count(*) filter (where severity = 'dead') as dead, count(*) filter (where severity <> 'dead') as other from named group by wheel having wheel is not null)
select wheel, dead, other, round(100e0 * dead / (dead + other), 4) as dead_pct from counts""")
def wheel_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by the side of the wheel; vehicles of which it isn't known are left out."""
    wheel = F.when(F.col("is_right_hand_drive"), "right").when(~F.col("is_right_hand_drive"), "left")
    named = vehicles(spark, sf_dir).select("accident_id", wheel.alias("wheel")).where("wheel is not null")
    rows = named.join(accidents(spark, sf_dir, "id", "severity").select("id", F.when(F.col("severity") == "dead", "dead").otherwise("other").alias("outcome")), F.col("accident_id") == F.col("id"))
    return severity_pivot(rows, "wheel")


@query(with_roles("participants") + """, walkers as (select accident_id, age from participants where permille is null or permille > 0.2)
select accident_id, count(*) as n_pedestrians, round(avg(age) filter (where age < 60), 4) as mean_age from walkers group by accident_id""")
def pedestrian_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedestrians of each accident and the mean of their known ages (those under sixty are known)."""
    walkers = participants(spark, sf_dir).where("permille is null or permille > 0.2")
    return walkers.groupBy("accident_id").agg(F.count(F.lit(1)).alias("n_pedestrians"), F.round(F.avg(F.when(F.col("age") < 60, F.col("age"))), 4).alias("mean_age"))


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """day, name: every public holiday of these years, one row each."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first_year}-01-01")), F.to_date(F.lit(f"{last_year}-12-31")))).alias("day"))
    m, d = F.month("day"), F.dayofmonth("day")
    name = F.when((m == 1) & (d == 7), "Christmas").when(m == 1, "New Year").when(m == 2, "Defenders").when(m == 3, "Women").when((m == 5) & (d == 1), "Labour").when(m == 5, "Victory").when(m == 6, "Russia").otherwise("Unity")
    return days.where(fixed_holiday(F.col("day"))).select("day", name.alias("name"))


def with_holiday(df: DataFrame, moment: str, calendar: DataFrame) -> DataFrame:
    """Adds is_holiday and holiday, from a calendar of days, which is small: it has a few days a year."""
    named = calendar.select(F.col("day").alias("_day"), F.col("name").alias("holiday"))
    return df.withColumn("_date", F.to_date(moment)).join(F.broadcast(named), F.col("_date") == F.col("_day"), "left").withColumn("is_holiday", F.col("holiday").isNotNull()).drop("_date", "_day")


@query(ACCIDENTS + """,
named as (select severity, case when month(datetime) = 1 and day(datetime) = 7 then 'Christmas' when month(datetime) = 1 and day(datetime) <= 8 then 'New Year' when (month(datetime), day(datetime)) = (2, 23) then 'Defenders'
  when (month(datetime), day(datetime)) = (3, 8) then 'Women' when (month(datetime), day(datetime)) = (5, 1) then 'Labour' when (month(datetime), day(datetime)) = (5, 9) then 'Victory'
  when (month(datetime), day(datetime)) = (6, 12) then 'Russia' when (month(datetime), day(datetime)) = (11, 4) then 'Unity' end as holiday from accidents)
select holiday is not null as is_holiday, holiday, count(*) as n, count(*) filter (where severity = 'dead') as dead from named group by holiday""")
def holiday_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents of each holiday and of all other days, by a calendar that is joined by day."""
    rows = with_holiday(accidents(spark, sf_dir, "datetime", "severity"), "datetime", holiday_calendar(spark, 1990, 2030))
    return rows.groupBy("is_holiday", "holiday").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "dead").alias("dead"))


SEEDS = 5


@query(f"""
with taken as (select vec_id, label, s from embeddings, (select unnest(range({SEEDS})) as s) where (vec_id * 7919 + s * 104729) % 10 <> 0)
select a.s as first, b.s as second, count(*) as common from taken a join taken b on a.vec_id = b.vec_id and a.s < b.s group by all""")
def bootstrap_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each two of five nine-tenths samples have in common; a row meets its own samples only."""
    taken = F.filter(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda s: (F.col("vec_id") * 7919 + s * 104729) % 10 != 0)
    rows = table(spark, sf_dir, "embeddings").select(taken.alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return rows.select(F.inline(pairs)).groupBy(F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second")).agg(F.count(F.lit(1)).alias("common"))
