"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidence.llm.common import materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node with a link to another, the smallest node that can be reached.

    Every round a node's links are moved to its smallest neighbour, which needs a minimum per node (combined before the
    shuffle) and a join, never a node's whole list of neighbours; the minima are cut to files first, so that Spark can
    split the links of a node that has very many. The links are cut to files each round too and come to a rest after a number of rounds that grows with the logarithm of the longest chain.
    """
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    edges = materialize(pair.distinct(), "links")
    state = _digest(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(moved.select("e.u", "e.v").where("u > v").distinct(), "links")
        before, state = state, _digest(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
