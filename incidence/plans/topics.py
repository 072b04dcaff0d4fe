"""Topics by density: hierarchical clusters of the vectors and what they are made from."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidence.model import table
from incidence.operators import density, neighbourhood
from incidence.plans.base import query
from incidence.sources.files import materialize

#: Directions that the vectors are reduced to before they are clustered.
DIRECTIONS = 10
MIN_CLUSTER_SIZE, MIN_SAMPLES = 10, 3
#: Neighbours that a vector is linked to on the map.
LINKED = 15


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query(f"""
with v as (select vec_id, embedding::double[] as e from embeddings),
apart as (select a.vec_id, list_distance(a.e, b.e) as d, row_number() over (partition by a.vec_id order by list_distance(a.e, b.e)) as place from v a, v b)
select vec_id, round(d, 6) as core_distance from apart where place = {MIN_SAMPLES}""")
def topic_core_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance at which each vector has MIN_SAMPLES vectors, itself and equal ones among them."""
    places, members = density.collapsed(_vectors(spark, sf_dir))
    cores = density.core_distances(places, density.neighbours(places, MIN_SAMPLES), MIN_SAMPLES)
    return members.join(cores.withColumnRenamed("id", "place"), "place").select(F.col("id").alias("vec_id"), F.round("core", 6).alias("core_distance"))


@query()
def topic_hdbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of all vectors by density in their ten main directions, named by their smallest vec_id; -1 is noise."""
    rows = _vectors(spark, sf_dir).select("id", array_to_vector("v").alias("x"))
    flat = PCA(k=DIRECTIONS, inputCol="x", outputCol="y").fit(rows).transform(rows).select("id", vector_to_array("y").alias("v"))
    found = density.hdbscan(materialize(flat), MIN_CLUSTER_SIZE, MIN_SAMPLES)
    return found.select(F.col("id").alias("vec_id"), F.col("cluster").alias("topic"), F.round("probability", 6).alias("probability"))


def main_directions(vectors: DataFrame) -> DataFrame:
    """id, x, y of `vectors` (id, v): the two main directions, scaled to -10 to 10."""
    rows = vectors.select("id", array_to_vector("v").alias("w"))
    flat = PCA(k=2, inputCol="w", outputCol="xy").fit(rows).transform(rows).select("id", vector_to_array("xy").alias("xy"))
    most = flat.agg(F.max(F.greatest(*(F.abs(F.col("xy")[i]) for i in (0, 1))))).first()[0] or 1.0
    return materialize(flat.select("id", *((F.col("xy")[i] * (10 / most)).alias(c) for i, c in enumerate("xy"))))


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(places, members, graph, start, layout) of all vectors; equal vectors are one place."""
    places, members = density.collapsed(_vectors(spark, sf_dir))
    graph = neighbourhood.neighbour_graph(places, LINKED)
    start = main_directions(places)
    return places, members, graph, start, neighbourhood.layout(materialize(neighbourhood.fuzzy_links(graph)), start)


@query()
def topic_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's place on a map of fuzzy neighbours; equal vectors lie on each other."""
    _, members, _, _, flat = _mapped(spark, sf_dir)
    out = members.join(flat.withColumnRenamed("id", "place"), "place").select(F.col("id").alias("vec_id"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").join(out, "vec_id")


@query()
def topic_layout_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the neighbour graph, and trustworthiness of the map and of the two main directions, asked by ids divisible by 100 against all."""
    places, _, graph, start, flat = _mapped(spark, sf_dir)
    asked = places.where("id % 100 = 0")
    figures = {"graph recall": neighbourhood.recall(graph, places, asked, LINKED), "map trust": neighbourhood.trust(places, flat, asked, LINKED), "main directions trust": neighbourhood.trust(places, start, asked, LINKED)}
    return spark.createDataFrame([(k, round(v, 4)) for k, v in figures.items()], "figure string, value double")
