"""The questions that an application asks, with their parameters and limits; each answer is a lazy frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidence.model import accidents, table
from incidence.operators.clustering import dbscan
from incidence.operators.recommend import profile, recommend
from incidence.plans.forecast import dense_daily, fit_forecast
from incidence.plans.base import query
from incidence.plans.spatial import _flat, points, within
from incidence.plans.statistics import listing, page
from incidence.plans.text import dot, unit


def bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low} to {high}")
    return value


def accidents_page(spark: SparkSession, sf_dir: str, limit: int = 100, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(the page, a row with the total) of the accidents that the filters of `listing` leave."""
    rows = listing(accidents(spark, sf_dir), **filters)
    return page(rows, limit, offset), rows.agg(F.count(F.lit(1)).alias("total"))


def accident(spark: SparkSession, sf_dir: str, key: int) -> DataFrame:
    """One accident or no row."""
    return accidents(spark, sf_dir).where(F.col("id") == key)


def hotspots(spark: SparkSession, sf_dir: str, min_count: int = 15, limit: int = 50, eps: float = 300.0) -> DataFrame:
    """The largest clusters of `min_count` points at least."""
    found = dbscan(_flat(points(spark, sf_dir)), eps, 15).where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_points"))
    return found.where(F.col("n_points") >= min_count).orderBy(F.desc("n_points"), "cluster").limit(bounded("limit", limit, 1, 200))


def monthly_forecast(spark: SparkSession, sf_dir: str, periods: int = 12) -> DataFrame:
    """Month sums of the forecast for the months after the last day known."""
    daily = dense_daily(table(spark, sf_dir, "orders"), "o_orderdate")
    months = bounded("periods", periods, 1, 36)
    future = daily.agg(F.explode(F.sequence(F.date_add(F.max("day"), 1), F.add_months(F.max("day"), months))).alias("day"))
    return fit_forecast(daily, future).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(*[F.round(F.sum(c), 2).alias(c) for c in ("predicted", "low", "high")])


def similar_posts(spark: SparkSession, sf_dir: str, vector: list[float], top_k: int = 10) -> DataFrame:
    """The rows nearest to a vector by cosine; no rows for a zero or empty vector."""
    k = bounded("top_k", top_k, 1, 20)
    rows = table(spark, sf_dir, "embeddings")
    if not any(vector):
        return rows.select("vec_id", F.lit(0.0).alias("similarity")).limit(0)
    asked = unit(F.array(*[F.lit(float(x)) for x in vector]))
    return rows.select("vec_id", F.round(dot(unit(F.col("embedding")), asked), 5).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def point_recommendations(spark: SparkSession, sf_dir: str, lat: float, lon: float, radius: float = 500.0, top_k: int = 5, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """The best countermeasures around a point; no rows where there are fewer than ten accidents."""
    if not 10 <= radius <= 5000:
        raise ValueError("radius must be 10 to 5000")
    rows = accidents(spark, sf_dir)
    rows = rows if year_min is None else rows.where(F.year("datetime") >= year_min)
    rows = rows if year_max is None else rows.where(F.year("datetime") <= year_max)
    centre = spark.createDataFrame([(0, lat, lon)], "centre int, c_lat double, c_lon double")
    return recommend(profile(within(rows, centre, radius), "centre"), "centre", bounded("top_k", top_k, 1, 18)).drop("centre")


@query("select (select count(*) from orders) as accidents, (select count(*) from documents) as posts, (select count(*) from embeddings) as vectors")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the main tables."""
    count = lambda name, as_: table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias(as_))
    return count("orders", "accidents").crossJoin(count("documents", "posts")).crossJoin(count("embeddings", "vectors"))  # single rows


@query("select doc_id, lang, n_chars, quality, toxic from documents left join labels using (doc_id) where doc_id in (0, 5, 199)")
def post_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by id with what is known of them."""
    rows = table(spark, sf_dir, "documents").where(F.col("doc_id").isin(0, 5, 199)).select("doc_id", "lang", "n_chars")
    return rows.join(table(spark, sf_dir, "labels"), "doc_id", "left")
