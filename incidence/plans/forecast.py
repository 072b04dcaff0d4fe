"""Counts over time: dense series, anomalies, seasonal decomposition, regression forecasts and their errors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidence.model import table
from incidence.operators.trend import forecast, origins, scored
from incidence.plans.base import query


def dense_daily(df: DataFrame, moment: str) -> DataFrame:
    """day, y: one row per day from the first to the last, 0 where nothing happened."""
    counts = df.groupBy(F.to_date(moment).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = counts.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("y"))


DAILY_SQL = """
counts as (select o_orderdate::date as day, count(*) as n from orders group by 1),
days as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from counts),
daily as (select days.day, coalesce(n, 0) as y from days left join counts on days.day = counts.day)
"""


def in_lockdown(day: Column) -> Column:
    """The regressor: 1 from 2020-03-15 to 2020-05-31, moved to 1997 where the tables' dates are."""
    return day.between(F.lit("1997-03-15").cast("date"), F.lit("1997-05-31").cast("date")).cast("int")


@query("with " + DAILY_SQL + "select strftime(day, '%Y-%m-%d') as day, y, (day between date '1997-03-15' and date '1997-05-31')::int as lockdown from daily")
def daily_dense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense_daily(table(spark, sf_dir, "orders"), "o_orderdate")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "y", in_lockdown(F.col("day")).alias("lockdown"))


@query("with " + DAILY_SQL + """, ends as (select max(day) as last from daily), recent as (select daily.* from daily, ends where day > last - 365),
stats as (select count(*) as n, avg(y) as mean, stddev_samp(y) as std from recent)
select strftime(day, '%Y-%m-%d') as day, y, round(mean + 2 * std, 4) as bar from recent, stats where n >= 30 and y > mean + 2 * std""")
def anomaly_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the last year above mean + 2 deviations; none if there are fewer than 30 days."""
    daily = dense_daily(table(spark, sf_dir, "orders"), "o_orderdate")
    recent = daily.crossJoin(daily.agg(F.max("day").alias("last"))).where(F.col("day") > F.date_sub("last", 365)).drop("last")  # a single row
    stats = recent.agg(F.count(F.lit(1)).alias("n"), (F.avg("y") + 2 * F.stddev_samp("y")).alias("bar"))
    return recent.crossJoin(stats).where("n >= 30 and y > bar").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "y", F.round("bar", 4).alias("bar"))


@query("with " + DAILY_SQL + "select strftime(date_trunc('month', day), '%Y-%m') as month, sum(y)::bigint as y, count(*) as days from daily group by 1")
def month_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = dense_daily(table(spark, sf_dir, "orders"), "o_orderdate")
    return daily.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("days"))


@query("with " + DAILY_SQL + """,
monthly as (select date_trunc('month', day) as month, sum(y) as y from daily group by 1),
wide as (select month, y, row_number() over (order by month) as i, count(*) over () as n,
  (sum(y) over (order by month rows between 5 preceding and 5 following) + 0.5e0 * lag(y, 6) over (order by month) + 0.5e0 * lead(y, 6) over (order by month)) / 12e0 as trend from monthly),
free as (select *, y - trend as detrended from wide),
season as (select month(month) as m, avg(detrended) as s from free where trend is not null group by 1)
select strftime(month, '%Y-%m') as month, y::bigint as y, round(trend, 4) as trend, round(s - (select avg(s) from season), 4) as seasonal from free join season on month(month) = m""")
def seasonal_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive decomposition with period 12: centred 2 x 12 mean, then month means around 0."""
    daily = dense_daily(table(spark, sf_dir, "orders"), "o_orderdate")
    monthly = daily.groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("y").alias("y"))
    w = Window.orderBy("month")  # one row per month
    trend = (F.sum("y").over(w.rowsBetween(-5, 5)) + 0.5 * F.lag("y", 6).over(w) + 0.5 * F.lead("y", 6).over(w)) / 12.0
    free = monthly.withColumn("trend", trend).withColumn("m", F.month("month"))
    season = free.where("trend is not null").groupBy("m").agg(F.avg(F.col("y") - F.col("trend")).alias("s"))
    centred = season.withColumn("s", F.col("s") - F.avg("s").over(Window.partitionBy()))
    return free.join(centred, "m").select(F.date_format("month", "yyyy-MM").alias("month"), "y", F.round("trend", 4).alias("trend"), F.round("s", 4).alias("seasonal"))


@query("with " + DAILY_SQL + """, paired as (select y * 1e0 as actual, lag(y, 7) over (order by day) * 1e0 as predicted from daily)
select round(avg(abs(actual - predicted)), 4) as mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) as rmse,
       round(100e0 * avg(abs(actual - predicted) / actual) filter (where actual > 0), 4) as mape from paired where predicted is not null""")
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the week-ago forecast; the relative one over days with accidents only."""
    daily = dense_daily(table(spark, sf_dir, "orders"), "o_orderdate").select("day", F.col("y").cast("double").alias("actual"))
    ago = daily.select(F.date_add("day", 7).alias("day"), F.col("actual").alias("predicted"))
    return errors(daily.join(ago, "day"))


def errors(pairs: DataFrame) -> DataFrame:
    gap = F.col("actual") - F.col("predicted")
    return pairs.agg(F.round(F.avg(F.abs(gap)), 4).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 4).alias("rmse"), F.round(100.0 * F.avg(F.when(F.col("actual") > 0, F.abs(gap) / F.col("actual"))), 4).alias("mape"))


def calendar_features(df: DataFrame, start: str = "1995-01-01", yearly: int = 6, changes: int = 8, span: float = 2500.0) -> tuple[DataFrame, list[str]]:
    """Trend with bends, yearly waves, weekday and lockdown columns of a day; returns their names too."""
    t = F.datediff("day", F.lit(start).cast("date")) / span
    columns = {"t": t, "lockdown": in_lockdown(F.col("day")).cast("double")}
    columns |= {f"bend{i}": F.greatest(t - i / (changes + 1), F.lit(0.0)) for i in range(1, changes + 1)}
    angle = F.dayofyear("day") * (2 * 3.141592653589793 / 365.25)
    columns |= {f"{f}{i}": getattr(F, f)(angle * i) for i in range(1, yearly + 1) for f in ("sin", "cos")}
    columns |= {f"dow{i}": (F.dayofweek("day") == i).cast("double") for i in range(2, 8)}
    return df.withColumns(columns), list(columns)


def fit_forecast(daily: DataFrame, future: DataFrame, ridge: float = 0.05) -> DataFrame:
    """day, predicted, low, high for the days of `future`: a ridge regression on the calendar, with a 95 % band."""
    known, names = calendar_features(daily)
    pack = VectorAssembler(inputCols=names, outputCol="features")
    model = LinearRegression(labelCol="y", regParam=ridge, standardization=True).fit(pack.transform(known))
    half = 1.96 * model.summary.rootMeanSquaredError
    out = model.transform(pack.transform(calendar_features(future)[0]))
    return out.select("day", F.col("prediction").alias("predicted"), F.greatest(F.col("prediction") - half, F.lit(0.0)).alias("low"), (F.col("prediction") + half).alias("high"))


@query()
def forecast_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of the last year as forecast from the years before, beside what happened."""
    daily = dense_daily(table(spark, sf_dir, "orders"), "o_orderdate").cache()
    last = daily.agg(F.max("day").alias("last"))
    split = daily.crossJoin(last).withColumn("test", F.col("day") > F.date_sub("last", 365))
    forecast = fit_forecast(split.where("not test").select("day", "y"), split.where("test").select("day"))
    months = forecast.join(daily, "day").groupBy(F.date_format("day", "yyyy-MM").alias("month"))
    return months.agg(*[F.round(F.sum(c), 2).alias(c) for c in ("predicted", "low", "high")], F.sum("y").alias("actual")).orderBy("month")


@query()
def forecast_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of forecasts from sliding origins: 1095 days at first, a new origin every 365, each looking 180 days ahead."""
    daily = dense_daily(table(spark, sf_dir, "orders"), "o_orderdate").cache()
    first, n = daily.agg(F.min("day"), F.count(F.lit(1))).first()
    out = None
    for days in range(1095, n - 180, 365):
        cut = F.date_add(F.lit(first), days)
        found = fit_forecast(daily.where(F.col("day") < cut), daily.where((F.col("day") >= cut) & (F.col("day") < F.date_add(cut, 180))).select("day"))
        row = errors(found.join(daily.select("day", F.col("y").cast("double").alias("actual")), "day")).withColumn("origin", F.date_format(cut, "yyyy-MM-dd"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else errors(daily.select(F.col("y").alias("actual"), F.col("y").alias("predicted"))).withColumn("origin", F.lit(None).cast("string")).limit(0)


def daily_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, day, y, lockdown: daily counts of each type of accident and of all, dense over the days of the whole table."""
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.explode(F.array("o_orderpriority", F.lit("all"))).alias("series"))
    counts = rows.groupBy("series", "day").agg(F.count(F.lit(1)).alias("n"))
    days = rows.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    grid = days.crossJoin(F.broadcast(counts.select("series").distinct()))  # days by a handful of types
    return grid.join(counts, ["series", "day"], "left").select("series", "day", F.coalesce("n", F.lit(0)).alias("y"), in_lockdown(F.col("day")).alias("lockdown"))


@query()
def forecast_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and the band's coverage of each type's forecasts from every sliding origin, all fitted in one job."""
    told = forecast(origins(daily_by_type(spark, sf_dir), ["series"]), "cutoff", ["series"], ["lockdown"])
    out = scored(told, ["series", "cutoff"])
    return out.select("series", F.date_format("cutoff", "yyyy-MM-dd").alias("origin"), "days", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape", "coverage")])
