"""Density clustering (DBSCAN) as grid joins and label propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidence.sources.files import materialize


def _near(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """Rows of `left` (a, ax, ay, cx, cy) with those of `right` (x, y, cx, cy, ...) at most `eps` apart.

    Cells have the side eps / sqrt(2), so a row looks at the five by five cells around its own: it repeats for them, and
    the rows meet by cell.
    """
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]
    around = F.array(*[F.struct((F.col("cx") + i).alias("nx"), (F.col("cy") + j).alias("ny")) for i, j in steps])
    spread = left.select("*", F.inline(around)).drop("cx", "cy").withColumnsRenamed({"nx": "cx", "ny": "cy"})
    apart = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
    return spread.join(right, ["cx", "cy"]).where(apart <= eps * eps)


def smallest_reachable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): the smallest id in each node's component. `edges` (a, b) hold both directions.

    Each round every link offers the far end's grandparent to the near end and to the near end's parent, and every
    node goes to its own grandparent; whole trees hook onto each other, so the rounds grow with the logarithm of the
    longest chain. Labels are cut to files per round.
    """
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("grand"))
        both = labels.join(up, "label").select("id", "label", "grand")
        far = both.select(F.col("id").alias("b"), F.col("grand").alias("offer"))
        near = labels.select(F.col("id").alias("a"), F.col("label").alias("parent"))
        offers = edges.join(far, "b").join(near, "a")
        told = offers.select(F.inline(F.array(F.struct(F.col("a").alias("id"), "offer"), F.struct(F.col("parent").alias("id"), "offer"))))
        best = told.unionByName(both.select("id", F.col("grand").alias("offer"))).groupBy("id").agg(F.min("offer").alias("offer"))
        moved = materialize(labels.join(best, "id").select("id", F.least("label", "offer").alias("label"), (F.col("offer") < F.col("label")).alias("changed")))
        labels = moved.select("id", "label")
        if moved.where("changed").isEmpty():
            return labels


def _places(cores: DataFrame) -> DataFrame:
    """One row per cell and place: for the links of a cell a place counts once, however many points lie there."""
    return cores.groupBy("cx", "cy", "head", "x", "y").agg(F.count(F.lit(1)).alias("n"))


#: Directions in which a cell's outermost cores are known; such pairs settle most links without comparing more.
DIRECTIONS = [(math.cos(k * math.pi / 4), math.sin(k * math.pi / 4)) for k in range(8)]


def cell_ends(cores: DataFrame) -> DataFrame:
    """One row per cell: cx, cy, head (its smallest id), the box around its cores, and those that lie farthest out in each of DIRECTIONS."""
    tip = lambda u, v: F.max_by(F.struct("x", "y"), F.col("x") * u + F.col("y") * v)
    box = [f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("low", F.min), ("high", F.max))]
    return cores.groupBy("cx", "cy").agg(F.min("id").alias("head"), *box, F.array(*[tip(u, v) for u, v in DIRECTIONS]).alias("tips"))


def _square(gap_x: Column, gap_y: Column) -> Column:
    return gap_x * gap_x + gap_y * gap_y


def linked_cells(cores: DataFrame, eps: float) -> DataFrame:
    """(a, b), each pair once: heads of neighbouring cells with two cores at most `eps` apart. `cores` have id, x, y, cx, cy, head.

    The pairs of cores of two dense cells grow with the square of their points. Two outermost cores that are near enough
    settle a link; only for cells that none settle and whose boxes are near enough are cores compared, and of these only
    those within reach of the other cell's box.
    """
    ends = materialize(cell_ends(cores))
    side = lambda name: ends.select(*[F.col(c).alias(f"{name}_{c}") for c in ends.columns if c not in ("cx", "cy")], "cx", "cy")
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4 and (i, j) > (0, 0)]
    around = F.array(*[F.struct((F.col("cx") + i).alias("nx"), (F.col("cy") + j).alias("ny")) for i, j in steps])
    left = side("a").select("*", F.inline(around)).withColumnsRenamed({"cx": "a_cx", "cy": "a_cy", "nx": "cx", "ny": "cy"})
    pairs = left.join(side("b"), ["cx", "cy"]).withColumnsRenamed({"cx": "b_cx", "cy": "b_cy"})
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b_low_{c}") - F.col(f"a_high_{c}"), F.col(f"a_low_{c}") - F.col(f"b_high_{c}"))
    settled = F.exists("a_tips", lambda p: F.exists("b_tips", lambda q: _square(p["x"] - q["x"], p["y"] - q["y"]) <= eps * eps))
    pairs = materialize(pairs.where(_square(gap("x"), gap("y")) <= eps * eps).withColumn("settled", settled).drop("a_tips", "b_tips"))
    away = lambda c, other: F.greatest(F.lit(0.0), F.col(f"{other}_low_{c}") - F.col(c), F.col(c) - F.col(f"{other}_high_{c}"))
    open_pairs, thin = pairs.where("not settled").drop("settled", "a_head", "b_head"), _places(cores)
    asked = thin.select("x", "y", F.col("head").alias("a"), F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy")).join(open_pairs, ["a_cx", "a_cy"])
    asked = asked.where(_square(away("x", "b"), away("y", "b")) <= eps * eps).withColumnsRenamed({"x": "ax", "y": "ay"})
    near = thin.select("x", "y", F.col("head").alias("b"), F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"))
    compared = asked.join(near, ["b_cx", "b_cy"]).where(_square(away("x", "a"), away("y", "a")) <= eps * eps).where(_square(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= eps * eps)
    return pairs.where("settled").select(F.col("a_head").alias("a"), F.col("b_head").alias("b")).unionByName(compared.select("a", "b").distinct())


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """id, cluster, kind (core, border, noise): points with `min_samples` points within `eps` (themselves too) are cores.

    A cluster's name is its smallest core id; a border point goes to the smallest such cluster in reach, noise has -1.
    All points of a cell are within `eps` of each other: cells with `min_samples` points hold cores only and need no
    comparison, and cores link cell by cell, so the labels to be spread are as many as there are cells.
    """
    side = eps / math.sqrt(2)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    own = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    dense = own.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select("cx", "cy")
    asking = lambda df: df.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    lonely = _near(asking(own.join(dense, ["cx", "cy"], "left_anti")), own.select("x", "y", "cx", "cy"), eps)
    found = lonely.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("id"))
    cores = own.join(dense, ["cx", "cy"], "left_semi").unionByName(own.join(found, "id", "left_semi").select("cx", "cy", "id", "x", "y"), allowMissingColumns=False)
    heads = cores.groupBy("cx", "cy").agg(F.min("id").alias("head"))
    cores = materialize(cores.join(heads, ["cx", "cy"]))
    one = linked_cells(cores, eps)
    links = materialize(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = smallest_reachable(links, cores.select(F.col("head").alias("id")).distinct())
    named = materialize(cores.join(labels.select(F.col("id").alias("head"), "label"), "head").select("id", "x", "y", "cx", "cy", "label"))
    rest = own.join(named.select("id"), "id", "left_anti")
    border = _near(asking(rest), named.select("x", "y", "cx", "cy", "label"), eps).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("cluster"))
    out = points.select("id").join(named.select("id", F.col("label").alias("core")), "id", "left").join(border, "id", "left")
    kind = F.when(F.col("core").isNotNull(), "core").when(F.col("cluster").isNotNull(), "border").otherwise("noise")
    return out.select("id", F.coalesce("core", "cluster", F.lit(-1).cast("long")).alias("cluster"), kind.alias("kind"))


def centre(cluster: Column) -> dict[str, Column]:
    """Aggregates of a hotspot's place: mean and box."""
    return {"n_points": F.count(F.lit(1)), "lat": F.avg("lat"), "lon": F.avg("lon"), "min_lat": F.min("lat"), "max_lat": F.max("lat"), "min_lon": F.min("lon"), "max_lon": F.max("lon")}
