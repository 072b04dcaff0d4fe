"""Dashboard statistics: listings, cross-tabs, conditional aggregates, cohort comparisons and tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidence.functions.stats import erfc, erfc_sql, percent, share
from incidence.model import accidents, participants, table, vehicles, with_roles
from incidence.plans.base import query

ACCIDENTS = with_roles("accidents")
GROUP_FIELDS = ("light_type", "place", "parent_region")


def listing(df: DataFrame, year: int | None = None, severity: Sequence[str] = (), em_type: str | None = None, place: str | None = None, in_region_only: bool = False) -> DataFrame:
    """Any set of filters; each one given must hold."""
    tests: list[Column] = []
    if year is not None:
        tests.append((F.col("datetime") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("datetime") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    if severity:
        tests.append(F.col("severity").isin(list(severity)))
    if em_type is not None:
        tests.append(F.col("em_type") == em_type)
    if place is not None:
        tests.append(F.col("place").ilike(f"%{place}%"))
    if in_region_only:
        tests.append(F.col("is_in_region").eqNullSafe(True))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the newest rows; limit is 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset at least 0")
    return df.orderBy(F.desc("datetime"), F.desc("id")).offset(offset).limit(limit)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by a whitelisted set of fields."""
    allowed = {*GROUP_FIELDS, "severity", "em_type", "np", "year", "month"}
    if not set(keys) <= allowed:
        raise ValueError(f"fields must be among {sorted(allowed)}")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(ACCIDENTS + """
select id, datetime::varchar as at, np, severity, em_type, lost, suffer from accidents
where year(datetime) = 1997 and severity in ('dead', 'severe') and place ilike '%build%' and is_in_region is true
order by datetime desc, id desc limit 50 offset 10""")
def accidents_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(accidents(spark, sf_dir), 1997, ("dead", "severe"), None, "build", True)
    return page(rows, 50, 10).select("id", F.col("datetime").cast("string").alias("at"), "np", "severity", "em_type", "lost", "suffer")


@query(ACCIDENTS + """
select count(*) as total, count(*) filter (where is_in_region) as in_region, sum(lost)::bigint as lost, sum(suffer)::bigint as suffer,
       round(100e0 * count(*) filter (where severity = 'dead') / count(*), 4) as pct_dead,
       round(100e0 * count(*) filter (where severity in ('dead', 'severe', 'severe_multiple')) / count(*), 4) as pct_severe from accidents""")
def accidents_stats_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return accidents(spark, sf_dir).agg(
        n.alias("total"), F.count_if("is_in_region").alias("in_region"), F.sum("lost").alias("lost"), F.sum("suffer").alias("suffer"),
        percent(F.count_if(F.col("severity") == "dead"), n).alias("pct_dead"), percent(F.count_if(F.col("severity").isin("dead", "severe", "severe_multiple")), n).alias("pct_severe"),
    )


@query(ACCIDENTS + """
select 'severity' as field, coalesce(severity, 'null') as value, count(*) as n from accidents group by severity
union all select 'year', year(datetime)::varchar, count(*) from accidents group by year(datetime)
union all select * from (select 'em_type', coalesce(em_type, 'null') as v, count(*) as n from accidents group by em_type order by n desc, v limit 10)""")
def accidents_stats_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accidents(spark, sf_dir)
    count = lambda field, key: rows.groupBy(F.coalesce(key.cast("string"), F.lit("null")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(field).alias("field"), "value", "n")
    top = count("em_type", F.col("em_type")).orderBy(F.desc("n"), "value").limit(10)
    return count("severity", F.col("severity")).unionByName(count("year", F.year("datetime"))).unionByName(top)


@query(ACCIDENTS + """, """ + with_roles("vehicles").removeprefix("with ") + """
select id, severity, coalesce(n_vehicles, 0) as n_vehicles, coalesce(marks, 0) as n_marks, coalesce(newest, 0) as newest from accidents
left join (select accident_id, count(*) as n_vehicles, count(distinct mark) as marks, max(vehicle_year) as newest from vehicles group by accident_id) on id = accident_id
where id in (1, 2, 3, 7, 32, 100)""")
def accident_detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record per accident, its vehicles inside; the counts are read from the nested form."""
    own = vehicles(spark, sf_dir).groupBy("accident_id").agg(F.sort_array(F.collect_list(F.struct("n", "mark", "vehicle_year", "prod_type"))).alias("vehicles"))
    wanted = accidents(spark, sf_dir).where(F.col("id").isin(1, 2, 3, 7, 32, 100)).join(own, F.col("id") == F.col("accident_id"), "left")
    nested = wanted.select("id", "severity", F.coalesce("vehicles", F.array().cast(own.schema["vehicles"].dataType)).alias("vehicles"))
    newest = F.coalesce(F.array_max("vehicles.vehicle_year"), F.lit(0))
    return nested.select("id", "severity", F.size("vehicles").cast("long").alias("n_vehicles"), F.size(F.array_distinct("vehicles.mark")).cast("long").alias("n_marks"), newest.alias("newest"))


@query("select hour(ts) as hour, dayofweek(ts) as dow, count(*) as n from events group by all")
def hour_dow_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("hour"), (F.dayofweek("ts") - 1).cast("long").alias("dow")).agg(F.count(F.lit(1)).alias("n"))


@query("select year(o_orderdate) as year, month(o_orderdate) as month, count(*) as n from orders group by all")
def monthly_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, count(*) as n from orders group by 1")
def monthly_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("select min(year(o_orderdate)) as first_year, max(year(o_orderdate)) as last_year from orders")
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.year(F.min("o_orderdate")).cast("long").alias("first_year"), F.year(F.max("o_orderdate")).cast("long").alias("last_year"))


@query(ACCIDENTS + "".join(f"{' union all' if i else ''} select '{f}' as field, {f} as value, severity, count(*) as n from accidents where is_in_region group by all" for i, f in enumerate(GROUP_FIELDS)))
def severity_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity against each field in one pass: the fields become rows before the count."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in GROUP_FIELDS])
    rows = accidents(spark, sf_dir).where("is_in_region").select("severity", F.inline(fields))
    return rows.groupBy("field", "value", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, coalesce(json_extract_string(props, '$.k'), 'unknown') as first_key, count(*) as n, round(sum(value), 2) as total from events group by all")
def severity_by_json_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.get_json_object("props", "$.k"), F.lit("unknown"))
    return table(spark, sf_dir, "events").groupBy("event_type", key.alias("first_key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(ACCIDENTS + """, told as (
  select severity, case k % 3 when 0 then null when 1 then '["none found"]' else '["no lights", "no marking"]' end as defects from accidents)
select severity, defects is not null and json_array_length(defects) > 0 and defects <> '["none found"]' as has_defect,
       case when coalesce(json_array_length(defects), 0) = 0 then 'without' else 'with' end as bucket, count(*) as n from told group by all""")
def severity_by_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of a JSON list of road defects: the feature leaves out the 'none found' list, the dashboard counts it."""
    text = F.when(F.col("k") % 3 == 1, '["none found"]').when(F.col("k") % 3 == 2, '["no lights", "no marking"]')
    rows = accidents(spark, sf_dir).select("severity", F.from_json(text, "array<string>").alias("defects"))
    size = F.coalesce(F.size("defects"), F.lit(0))
    has = (F.coalesce(size, F.lit(0)) > 0) & ~F.coalesce(F.col("defects") == F.array(F.lit("none found")), F.lit(False))
    return rows.groupBy("severity", (has & F.col("defects").isNotNull()).alias("has_defect"), F.when(size <= 0, "without").otherwise("with").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(ACCIDENTS + ", " + with_roles("vehicles").removeprefix("with ") + """
select is_right_hand_drive, severity, count(*) as n from vehicles join accidents on accident_id = id
where steering_confidence in ('high', 'medium') and is_right_hand_drive is not null group by all""")
def steering_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vehicles(spark, sf_dir).where(F.col("steering_confidence").isin("high", "medium") & F.col("is_right_hand_drive").isNotNull())
    return rows.join(accidents(spark, sf_dir), F.col("accident_id") == F.col("id")).groupBy("is_right_hand_drive", "severity").agg(F.count(F.lit(1)).alias("n"))


def category(prod_type: Column) -> Column:
    """Vehicle category by the first word that the type has."""
    low = F.lower(prod_type)
    return F.when(low.contains("steel"), "cars").when(low.contains("brass"), "trucks").when(low.contains("tin"), "moto").when(low.contains("copper"), "buses").otherwise("other")


def age_bucket(year: Column) -> Column:
    return F.when(year.isNull(), "unknown").when(year < 2000, "<2000").when(year < 2010, "2000-09").when(year < 2020, "2010-19").otherwise("2020+")


@query(ACCIDENTS + ", " + with_roles("vehicles").removeprefix("with ") + """,
known as (
  select is_right_hand_drive as rhd, severity, case when lower(prod_type) like '%steel%' then 'cars' when lower(prod_type) like '%brass%' then 'trucks'
    when lower(prod_type) like '%tin%' then 'moto' when lower(prod_type) like '%copper%' then 'buses' else 'other' end as category,
    case when vehicle_year < 2000 then '<2000' when vehicle_year < 2010 then '2000-09' when vehicle_year < 2020 then '2010-19' else '2020+' end as age,
    case when place in ('BUILDING', 'MACHINERY') then 'city' when place like '%HOLD' then 'suburb' else 'highway' end as location
  from vehicles join accidents on accident_id = id where steering_confidence in ('high', 'medium') and is_right_hand_drive is not null),
staged as (
  select 'all' as stage, 'all' as bucket, rhd, severity from known union all select 'category', category, rhd, severity from known
  union all select 'age', age, rhd, severity from known union all select 'location', location, rhd, severity from known),
rates as (
  select stage, bucket, count(*) filter (where rhd) as n_rhd, count(*) filter (where not rhd) as n_lhd,
         100e0 * count(*) filter (where rhd and severity = 'dead') / nullif(count(*) filter (where rhd), 0) as rhd_dead,
         100e0 * count(*) filter (where not rhd and severity = 'dead') / nullif(count(*) filter (where not rhd), 0) as lhd_dead from staged group by all)
select stage, bucket, n_rhd, n_lhd, round(rhd_dead, 4) as rhd_dead_pct, round(lhd_dead, 4) as lhd_dead_pct, round(rhd_dead / nullif(lhd_dead, 0), 4) as ratio from rates""")
def steering_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right against left steering, over all and within categories, ages and places, as rows of one table."""
    rows = vehicles(spark, sf_dir).where(F.col("steering_confidence").isin("high", "medium") & F.col("is_right_hand_drive").isNotNull())
    place = F.when(F.col("place").isin("BUILDING", "MACHINERY"), "city").when(F.col("place").endswith("HOLD"), "suburb").otherwise("highway")
    stages = {"all": F.lit("all"), "category": category(F.col("prod_type")), "age": age_bucket(F.col("vehicle_year")), "location": place}
    staged = F.array(*[F.struct(F.lit(k).alias("stage"), v.alias("bucket")) for k, v in stages.items()])
    joined = rows.join(accidents(spark, sf_dir), F.col("accident_id") == F.col("id")).select(F.col("is_right_hand_drive").alias("rhd"), (F.col("severity") == "dead").alias("dead"), F.inline(staged))
    right, left = F.count_if("rhd"), F.count_if(~F.col("rhd"))
    rates = joined.groupBy("stage", "bucket").agg(
        right.alias("n_rhd"), left.alias("n_lhd"), (share(F.count_if(F.col("rhd") & F.col("dead")), right) * 100.0).alias("r"), (share(F.count_if(~F.col("rhd") & F.col("dead")), left) * 100.0).alias("l")
    )
    return rates.select("stage", "bucket", "n_rhd", "n_lhd", F.round("r", 4).alias("rhd_dead_pct"), F.round("l", 4).alias("lhd_dead_pct"), F.round(F.try_divide("r", "l"), 4).alias("ratio"))


@query(with_roles("vehicles") + """
select mark, steering_confidence as confidence, count(*) as n from vehicles where is_right_hand_drive is null group by all order by n desc, mark limit 15""")
def steering_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vehicles(spark, sf_dir).where(F.col("is_right_hand_drive").isNull()).groupBy("mark", F.col("steering_confidence").alias("confidence"))
    return rows.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mark").limit(15)


@query(ACCIDENTS + """
select np, count(*) as n, count(*) filter (where severity = 'dead') as dead from accidents where np is not null group by np order by n desc, np limit 15""")
def top_np(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accidents(spark, sf_dir).where("np is not null").groupBy("np").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "dead").alias("dead"))
    return rows.orderBy(F.desc("n"), "np").limit(15)


@query(ACCIDENTS + """
select roads, count(*) as n, count(*) filter (where severity = 'dead') as dead, round(100e0 * count(*) filter (where severity = 'dead') / count(*), 4) as pct_dead
from accidents where roads is not null and trim(roads) <> '' group by roads having count(*) >= 30 order by pct_dead desc, n desc, roads limit 10""")
def dangerous_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten roads with the largest share of fatal accidents among those with 30 accidents at least."""
    n, dead = F.count(F.lit(1)), F.count_if(F.col("severity") == "dead")
    rows = accidents(spark, sf_dir).where("trim(roads) <> ''").groupBy("roads").agg(n.alias("n"), dead.alias("dead"), percent(dead, n).alias("pct_dead"))
    return rows.where("n >= 30").orderBy(F.desc("pct_dead"), F.desc("n"), "roads").limit(10)


@query(ACCIDENTS + """
select case when roads is not null and trim(roads) <> '' and k % 2 = 0 then 'highway' else 'city' end as location, severity, count(*) as n from accidents group by all""")
def city_vs_highway(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when((F.trim("roads") != "") & (F.col("k") % 2 == 0), "highway").otherwise("city")
    return accidents(spark, sf_dir).groupBy(place.alias("location"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query(ACCIDENTS + """,
nps as (select np from accidents group by np order by count(*) desc, np limit 7), ems as (select em_type from accidents group by em_type order by count(*) desc, em_type limit 7),
cells as (select np, em_type, count(*) as n from accidents where np in (select np from nps) and em_type in (select em_type from ems) group by all)
select np, em_type, n, round(n * 1e0 / sum(n) over (partition by np), 6) as share from cells""")
def np_em_heatmap_top7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent towns against the most frequent types, with shares by town."""
    counts = accidents(spark, sf_dir).groupBy("np", "em_type").agg(F.count(F.lit(1)).alias("n"))
    top = lambda c: counts.groupBy(c).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), c).limit(7).select(c)
    cells = counts.join(top("np"), "np", "left_semi").join(top("em_type"), "em_type", "left_semi")
    return cells.select("np", "em_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("np")), 6).alias("share"))


PEOPLE = ACCIDENTS + ", " + with_roles("participants").removeprefix("with ")


def per_accident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per accident with a flag for a drunk and for an unbelted person, and the mean age."""
    people = participants(spark, sf_dir).groupBy("accident_id").agg(
        F.bool_or(F.coalesce(F.col("permille") >= 0.16, F.lit(False))).alias("drunk"), F.bool_or(F.col("safety_belt") == "no").alias("unbelted"), F.avg("age").alias("age")
    )
    return accidents(spark, sf_dir).join(people, F.col("id") == F.col("accident_id"))


@query(PEOPLE + """,
each as (select accident_id, bool_or(coalesce(permille >= 0.16, false)) as drunk, bool_or(safety_belt = 'no') as unbelted, avg(age) as age from participants group by accident_id)
select severity, drunk, unbelted, count(*) as n, round(avg(age), 4) as mean_age from accidents join each on id = accident_id group by all""")
def drunk_unbelted_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_accident(spark, sf_dir).groupBy("severity", "drunk", "unbelted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 4).alias("mean_age"))


@query(PEOPLE + """,
each as (select accident_id, bool_or(coalesce(permille >= 0.16, false)) as drunk, bool_or(safety_belt = 'no') as unbelted from participants group by accident_id),
flags as (select 'drunk' as factor, drunk as present, severity from accidents join each on id = accident_id union all select 'unbelted', unbelted, severity from accidents join each on id = accident_id),
rates as (
  select factor, 100e0 * count(*) filter (where present and severity = 'dead') / nullif(count(*) filter (where present), 0) as with_pct,
         100e0 * count(*) filter (where not present and severity = 'dead') / nullif(count(*) filter (where not present), 0) as without_pct from flags group by factor)
select factor, round(with_pct, 4) as with_pct, round(without_pct, 4) as without_pct, round(with_pct / nullif(without_pct, 0), 4) as relative_risk from rates""")
def relative_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("present")) for c in ("drunk", "unbelted")])
    rows = per_accident(spark, sf_dir).select((F.col("severity") == "dead").alias("dead"), F.inline(flags))
    side = lambda present: share(F.count_if((F.col("present") == present) & F.col("dead")), F.count_if(F.col("present") == present)) * 100.0
    rates = rows.groupBy("factor").agg(side(True).alias("a"), side(False).alias("b"))
    return rates.select("factor", F.round("a", 4).alias("with_pct"), F.round("b", 4).alias("without_pct"), F.round(F.try_divide("a", "b"), 4).alias("relative_risk"))


@query(PEOPLE + """,
binned as (select case when age < 25 then '0-24' when age < 35 then '25-34' when age < 45 then '35-44' when age < 55 then '45-54' when age < 65 then '55-64' else '65+' end as bin, severity
  from participants join accidents on accident_id = id where age < 100)
select bin, count(*) as n, round(100e0 * count(*) filter (where severity = 'dead') / count(*), 4) as dead, round(100e0 * count(*) filter (where severity = 'severe') / count(*), 4) as severe,
       round(100e0 * count(*) filter (where severity = 'light') / count(*), 4) as light from binned group by bin""")
def age_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity shares by age band, as a pivot."""
    age = F.col("age")
    band = F.when(age < 25, "0-24").when(age < 35, "25-34").when(age < 45, "35-44").when(age < 55, "45-54").when(age < 65, "55-64").otherwise("65+")
    rows = participants(spark, sf_dir).where(age < 100).join(accidents(spark, sf_dir), F.col("accident_id") == F.col("id"))
    n = F.count(F.lit(1))
    return rows.groupBy(band.alias("bin")).agg(n.alias("n"), *[percent(F.count_if(F.col("severity") == s), n).alias(s) for s in ("dead", "severe", "light")])


@query(PEOPLE + """
select severity, count(*) as n, round(avg(age), 1) as mean_age, round(stddev_samp(age), 1) as std_age, min(age) as min_age, max(age) as max_age, round(corr(age, permille), 6) as age_permille
from participants join accidents on accident_id = id where permille is not null group by severity""")
def age_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = participants(spark, sf_dir).where("permille is not null").join(accidents(spark, sf_dir), F.col("accident_id") == F.col("id"))
    return rows.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 1).alias("mean_age"), F.round(F.stddev_samp("age"), 1).alias("std_age"), F.min("age").alias("min_age"), F.max("age").alias("max_age"),
        F.round(F.corr("age", "permille"), 6).alias("age_permille"),
    )


def fixed_holiday(day: Column) -> Column:
    """New Year's week and the six single holidays of the fixed calendar."""
    m, d = F.month(day), F.dayofmonth(day)
    single = ((m == 2) & (d == 23)) | ((m == 3) & (d == 8)) | ((m == 5) & d.isin(1, 9)) | ((m == 6) & (d == 12)) | ((m == 11) & (d == 4))
    return ((m == 1) & (d <= 8)) | single


@query(ACCIDENTS + """
select case when (month(datetime) = 1 and day(datetime) <= 8) or (month(datetime), day(datetime)) in ((2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4)) then 'holiday' else 'weekday' end as kind,
       severity, count(*) as n from accidents group by all""")
def holidays_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(fixed_holiday(F.col("datetime")), "holiday").otherwise("weekday")
    return accidents(spark, sf_dir, "datetime", "severity").groupBy(kind.alias("kind"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query(ACCIDENTS + " select em_type, year(datetime) as year, severity, count(*) as n from accidents where is_in_region group by all")
def em_type_year_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by(accidents(spark, sf_dir, "em_type", "datetime", "severity", "is_in_region").where("is_in_region").withColumn("year", F.year("datetime").cast("long")), "em_type", "year", "severity")


@query(ACCIDENTS + """
select em_type, n, gravity, row_number() over (order by gravity desc, em_type) as place from (
  select em_type, count(*) as n, round(100e0 * count(*) filter (where severity in ('severe', 'severe_multiple', 'dead')) / count(*), 4) as gravity from accidents group by em_type)""")
def gravity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    rows = accidents(spark, sf_dir, "em_type", "severity").groupBy("em_type").agg(n.alias("n"), percent(F.count_if(F.col("severity").isin("severe", "severe_multiple", "dead")), n).alias("gravity"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gravity"), "em_type")).cast("long"))


@query(ACCIDENTS + " select round(lat, 3) as lat, round(lon, 3) as lon, count(*) as n from accidents group by 1, 2")
def heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accidents(spark, sf_dir, "lat", "lon").groupBy(F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon")).agg(F.count(F.lit(1)).alias("n"))


@query(ACCIDENTS + """,
cells as (select em_type, severity, count(*) as n from accidents group by all),
sums as (select *, sum(n) over (partition by em_type) * sum(n) over (partition by severity) * 1e0 / sum(n) over () as expected from cells),
stat as (select sum((n - expected) * (n - expected) / expected) as chi2, (count(distinct em_type) - 1) * (count(distinct severity) - 1) as dof from sums),
z as (select *, (cbrt(chi2 / dof) - (1 - 2e0 / (9 * dof))) / sqrt(2e0 / (9 * dof)) as z from stat)
select round(chi2, 6) as chi2, dof, round(""" + erfc_sql("abs(z) / sqrt(2e0)") + """, 6) as p_value from z""")
def chi2_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independence of type and severity; the p-value by the Wilson-Hilferty cube root (two-sided, both signs alike)."""
    cells = accidents(spark, sf_dir).groupBy("em_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    every, row, column = Window.partitionBy(), Window.partitionBy("em_type"), Window.partitionBy("severity")
    expected = F.sum("n").over(row) * F.sum("n").over(column) / F.sum("n").over(every).cast("double")
    stat = cells.withColumn("e", expected).agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("chi2"), ((F.count_distinct("em_type") - 1) * (F.count_distinct("severity") - 1)).alias("dof"))
    spread = 2.0 / (9 * F.col("dof"))
    z = (F.cbrt(F.col("chi2") / F.col("dof")) - (1 - spread)) / F.sqrt(spread)
    return stat.select(F.round("chi2", 6).alias("chi2"), "dof", F.round(erfc(F.abs(z) / F.sqrt(F.lit(2.0))), 6).alias("p_value"))


@query(ACCIDENTS + """,
sides as (select count(*) filter (where k % 2 = 0) as n1, count(*) filter (where k % 2 = 0 and severity = 'dead') as x1,
                 count(*) filter (where k % 2 = 1) as n2, count(*) filter (where k % 2 = 1 and severity = 'dead') as x2 from accidents),
rates as (select *, x1 * 1e0 / n1 as p1, x2 * 1e0 / n2 as p2 from sides),
z as (select *, (p1 - p2) / sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) as z from rates)
select n1, n2, round(p1, 6) as p1, round(p2, 6) as p2, round(z, 6) as z, round(""" + erfc_sql("abs(z) / sqrt(2e0)") + """, 6) as p_value from z""")
def wald_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shares of fatal accidents compared, with unpooled errors."""
    even, dead = F.col("k") % 2 == 0, F.col("severity") == "dead"
    sides = accidents(spark, sf_dir).agg(F.count_if(even).alias("n1"), F.count_if(even & dead).alias("x1"), F.count_if(~even).alias("n2"), F.count_if(~even & dead).alias("x2"))
    rates = sides.withColumns({"p1": share(F.col("x1"), F.col("n1")), "p2": share(F.col("x2"), F.col("n2"))})
    error = F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.col("n1") + F.col("p2") * (1 - F.col("p2")) / F.col("n2"))
    tested = rates.withColumn("z", (F.col("p1") - F.col("p2")) / error)
    return tested.select("n1", "n2", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"), F.round("z", 6).alias("z"), F.round(erfc(F.abs("z") / F.sqrt(F.lit(2.0))), 6).alias("p_value"))
