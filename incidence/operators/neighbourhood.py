"""Maps of vectors: nearest neighbours by local joins, fuzzy links, a layout in the plane, and how far it can be trusted."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidence.operators.density import _asked, _distances, _exact, _matrix, _parts, neighbours
from incidence.operators.ranks import numbered
from incidence.sources.files import materialize

#: Vectors that lie together along a direction and are compared with each other at the start.
CHUNK = 32
#: Groups that a task compares between two outputs.
GROUPS = 64
#: Parts of a point's candidates that are cut to the best before the rest of them meet.
SALT = 32
#: Points that push all others away in an epoch, drawn anew each time.
SAMPLE = 256
#: The curve 1 / (1 + A d^2B) that stays near 1 up to a distance of 0.1 and falls with a spread of 1.
A, B = 1.577, 0.895
#: The farthest a pair moves a point in a coordinate, before the rate.
CLIP = 4.0
#: Points that push for each one that pulls.
PUSHES = 5


def _first(rows: DataFrame, key: str, order: list[Column | str], by: Column, k: int) -> DataFrame:
    """The first k rows of each key; parts of a key by `by` are cut first, so that a key with very many rows is shared out."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)))
    few = salted.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).where(F.col("_row") <= k)
    return few.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_row") <= k).drop("_row", "_salt")


def _met(k: int):
    """Batches of groups (ids, vectors, fresh, reach) -> a, b, d: each member's nearest k of the group within its reach, pairs without a fresh member left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, GROUPS) for b in batches for i in range(0, b.num_rows, GROUPS)):
            out = [[], [], []]
            for group in batch["members"]:
                rows = group.values
                ids, v, reach = rows.field("id").to_numpy(), _matrix(rows.field("v")), rows.field("reach").to_numpy()
                fresh = rows.field("fresh").to_numpy(zero_copy_only=False)
                apart = _distances(v, v)
                apart[(ids[:, None] == ids[None, :]) | ~(fresh[:, None] | fresh[None, :])] = np.inf
                near = np.argpartition(apart, min(k, len(ids)) - 1, axis=1)[:, :k]
                row, place = np.nonzero(np.take_along_axis(apart, near, axis=1) < np.minimum(reach, np.finfo(float).max)[:, None])
                near = near[row, place]
                far = _exact(v[row], v[near])
                for column, x in zip(out, (ids[row], ids[near], far), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b", "d"])

    return run


def _compared(members: DataFrame, group: str, k: int) -> DataFrame:
    """a, b, d from rows (group, id, v, fresh, reach); a group's size has a bound."""
    grouped = members.groupBy(group).agg(F.collect_list(F.struct("id", "v", "fresh", "reach")).alias("members")).select("members")
    return grouped.mapInArrow(_met(k), "a long, b long, d double")


def as_given(points: DataFrame) -> DataFrame:
    """`points` (id, v) with v in single precision if no number loses by it: half the bytes wherever vectors are dealt."""
    single = F.transform("v", lambda x: x.cast("float"))
    loses = points.where(F.coalesce(F.exists(F.zip_with("v", single, lambda x, y: x != y.cast("double")), lambda x: x), F.lit(True))).limit(1)
    return points if loses.count() else points.withColumn("v", single)


def neighbour_graph(vectors: DataFrame, k: int = 15, wider: int = 2, directions: int = 4, rounds: int = 10, change: float = 0.001, seed: int = 7) -> DataFrame:
    """a, b, d: for each of `vectors` (id, v) about its k nearest others.

    Neighbours of a point are likely to be each other's: with m = `wider` * k, a round compares the m nearest known to a
    point, and up to m points that have it among theirs (drawn by a hash), with each other, if one of the two is new there; only pairs nearer than the farthest known are passed on.
    The start are chunks of CHUNK vectors in their order along a few random directions. Rounds end when less than the
    share `change` of the links is new. So vectors meet about n * m * m times a round, not n * n; nearly all true
    neighbours are found, not all (the tests and `topic_layout_quality` measure how many). Vectors that are alike in no
    respect need a greater `wider`. Ids must differ, vectors have one length; rows without id or vector
    are left out; an empty table or one vector give no links.
    """
    points = materialize(as_given(vectors.where("id is not null and v is not null").select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))))
    head, m = points.select(F.size("v").alias("size")).first(), wider * k
    ways = np.random.default_rng(seed).normal(size=(directions, head["size"] if head else 1))
    along = [F.aggregate(F.zip_with("v", F.lit(way.tolist()), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) for way in ways]
    placed = numbered(points.select("id", F.posexplode(F.array(*along)).alias("way", "along")), [F.col("along"), F.col("id")], "place", ["way"])
    chunks = placed.select("id", F.struct("way", F.floor(F.col("place") / CHUNK)).alias("chunk"), F.lit(True).alias("fresh"))
    endless = F.lit(float("inf"))
    found = _compared(chunks.join(points, "id").withColumn("reach", endless), "chunk", m)
    near = ["d", "b"]
    graph = materialize(_first(found.distinct(), "a", near, F.col("b"), m).withColumn("fresh", F.lit(True)))
    links = graph.count()
    for r in range(rounds):
        drawn = _first(graph.select(F.col("b").alias("p"), F.col("a").alias("id"), "fresh"), "p", [F.xxhash64("id", F.lit(seed + r)), "id"], F.col("id"), m)
        around = graph.select(F.col("a").alias("p"), F.col("b").alias("id"), "fresh").unionByName(drawn)
        around = around.groupBy("p", "id").agg(F.max("fresh").alias("fresh"))
        # Where nothing is new nobody is compared: such points' members and their vectors need not meet.
        changed = graph.where("fresh").select(F.explode(F.array("a", "b")).alias("p")).distinct()
        around = around.join(changed, "p", "left_semi")
        farthest = graph.groupBy(F.col("a").alias("id")).agg(F.when(F.count(F.lit(1)) < m, endless).otherwise(F.max("d")).alias("reach"))
        here = points.join(farthest, "id", "left").select("id", "v", F.coalesce("reach", endless).alias("reach"))
        pairs = _compared(around.join(here, "id").select("p", "id", "v", "fresh", "reach"), "p", m)
        both = graph.select("a", "b", "d", F.lit(False).alias("fresh")).unionByName(pairs.withColumn("fresh", F.lit(True)))
        graph = materialize(_first(both.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh")), "a", near, F.col("b"), m))
        if graph.where("fresh").count() <= change * links:
            break
    return _first(graph.select("a", "b", "d"), "a", near, F.col("b"), k)


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, near: [(d, b)] ascending) -> a, b, w: the spread is that at which the weights add up to log2 of their number."""
    for batch in batches:
        lists = batch["near"]
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        d, b, row = flat.field("d").to_numpy(), flat.field("b").to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        over = np.maximum(d - d[start][row], 0.0) if len(d) else d
        low, high = np.full(len(sizes), 1e-12), np.full(len(sizes), 1e12)
        wanted = np.maximum(np.log2(np.maximum(sizes, 1)), 1.0)
        for _ in range(100):  # the sum grows with the spread
            middle = np.sqrt(low * high)
            total = np.bincount(row, np.exp(-over / middle[row]), minlength=len(sizes))
            low, high = np.where(total < wanted, middle, low), np.where(total < wanted, high, middle)
        w = np.exp(-over / np.sqrt(low * high)[row])
        yield pa.RecordBatch.from_arrays([pa.array(batch["a"].to_numpy()[row]), pa.array(b), pa.array(w)], ["a", "b", "w"])


def fuzzy_links(graph: DataFrame) -> DataFrame:
    """lo, hi, w from a, b, d: how far two points are neighbours of each other's, p + q - p q of the two ways.

    A point's nearest neighbour counts 1, farther ones fall off at the point's own scale.
    """
    near = graph.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("near"))  # k to a point
    ways = near.mapInArrow(_memberships, "a long, b long, w double")
    return ways.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg((1 - F.product(1 - F.col("w"))).alias("w"))


def _pushed(sample: np.ndarray, rate: float):
    """Rows (id, x, y, fx, fy) -> moved ones: what pulls, and the mean push of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            at = np.stack([batch["x"].to_numpy(), batch["y"].to_numpy()], axis=1)
            pull = np.stack([batch["fx"].to_numpy(), batch["fy"].to_numpy()], axis=1)
            step = at[:, None, :] - sample[None, :, :]
            square = (step * step).sum(-1, keepdims=True)
            push = np.clip(2 * B / ((0.001 + square) * (1 + A * square**B)) * step, -CLIP, CLIP).mean(axis=1)
            at = at + rate * (pull + PUSHES * push)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(at[:, 0]), pa.array(at[:, 1])], ["id", "x", "y"])

    return run


def layout(links: DataFrame, start: DataFrame, epochs: int = 25, rate: float = 1.0, seed: int = 7) -> DataFrame:
    """id, x, y: the points of `start` (id, x, y) moved so that linked ones (lo, hi, w) are near each other and others aren't.

    An epoch is one job: links meet the places of both ends, forces are summed per point (before they are shuffled), each
    point goes by its links' mean pull and the mean push of SAMPLE points drawn anew; steps shrink to nothing. Places are
    written after each epoch. Points without links are only pushed.
    """
    share = links.select(F.explode(F.array("lo", "hi")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("all"))
    whole = lambda end: share.select(F.col("id").alias(end), F.col("all").alias(f"all_{end}"))
    edges = materialize(links.join(whole("lo"), "lo").join(whole("hi"), "hi").select("lo", "hi", (F.col("w") / F.col("all_lo")).alias("w_lo"), (F.col("w") / F.col("all_hi")).alias("w_hi")))
    places = materialize(start.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    at = lambda end: places.select(F.col("id").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}"))
    clip = lambda c: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), c))
    dx, dy = F.col("x_lo") - F.col("x_hi"), F.col("y_lo") - F.col("y_hi")
    pull = F.when(F.col("square") > 0, -2 * A * B * F.pow("square", B - 1) / (1 + A * F.pow("square", B))).otherwise(0.0)
    for epoch in range(epochs):
        drawn = places.orderBy(F.xxhash64("id", F.lit(seed), F.lit(epoch)), "id").limit(SAMPLE).select("x", "y").collect()
        met = edges.join(at("lo"), "lo").join(at("hi"), "hi").withColumn("square", dx * dx + dy * dy)
        met = met.select("lo", "hi", "w_lo", "w_hi", clip(pull * dx).alias("fx"), clip(pull * dy).alias("fy"))
        ends = F.array(*[F.struct(F.col(e).alias("id"), (F.col(f"w_{e}") * s * F.col("fx")).alias("fx"), (F.col(f"w_{e}") * s * F.col("fy")).alias("fy")) for e, s in (("lo", 1), ("hi", -1))])
        forces = met.select(F.inline(ends)).groupBy("id").agg(F.round(F.sum("fx"), 9).alias("fx"), F.round(F.sum("fy"), 9).alias("fy"))
        moved = places.join(forces, "id", "left").na.fill(0.0, ["fx", "fy"])
        sample = np.array([tuple(r) for r in drawn], float).reshape(-1, 2)
        places = materialize(moved.mapInArrow(_pushed(sample, rate * (1 - epoch / epochs)), "id long, x double, y double"))
    return places


def _nearer(sent):
    """Vectors -> for each query and each of its limits how many are nearer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, limits = sent.value
        limits = np.stack(list(limits))
        counts = np.zeros(limits.shape, np.int64)
        for part, meets in _parts(batches, len(ids)):
            there, v = part["id"].to_numpy(), _matrix(part["v"])
            for some in meets:
                apart = _distances(q[some], v)
                apart[ids[some, None] == there[None, :]] = np.inf
                for j in range(limits.shape[1]):
                    counts[some, j] += (apart < limits[some, j : j + 1] * (1 - 1e-9)).sum(axis=1)
        row, place = np.nonzero(counts >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(place), pa.array(counts[row, place])], ["id", "place", "nearer"])

    return run


def trust(vectors: DataFrame, places: DataFrame, queries: DataFrame, k: int = 15) -> float:
    """Trustworthiness of a layout (id, x, y) of `vectors` (id, v) at k neighbours, over the points of `queries` (id).

    1 less what neighbours in the plane, that aren't among the k nearest vectors, are beyond k in rank, scaled to 0 to 1.
    """
    n = vectors.count()
    if n <= 2 * k:
        return math.nan
    flat = places.select("id", F.array("x", "y").alias("v"), F.lit(1).cast("long").alias("n"))
    near = neighbours(flat, k, flat.join(queries.select("id"), "id", "left_semi"))
    v = lambda end: vectors.select(F.col("id").alias(end), F.col("v").alias(f"v_{end}"))
    apart = F.sqrt(F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    limits = near.join(v("a"), "a").join(v("b"), "b").select("a", apart.alias("d")).groupBy("a").agg(F.collect_list("d").alias("limits"))  # k to a query
    asked = materialize(limits.withColumnRenamed("a", "id").join(vectors, "id").select("id", "v", "limits"))
    lost = 0
    for sent in _asked(asked, "limits"):
        ranks = vectors.select("id", "v").mapInArrow(_nearer(sent), "id long, place long, nearer long").groupBy("id", "place").agg((F.sum("nearer") + 1).alias("rank"))
        lost += ranks.agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0)))).first()[0] or 0
        sent.unpersist()
    return 1 - 2 * lost / (asked.count() * k * (2 * n - 3 * k - 1))


def recall(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 15) -> float:
    """The share of the k nearest of each of `queries` (id), found against all of `vectors` (id, v), that the graph has."""
    rows = vectors.select("id", "v", F.lit(1).cast("long").alias("n"))
    true = materialize(neighbours(rows, k, rows.join(queries.select("id"), "id", "left_semi")).select("a", "b"))
    return true.join(graph.select("a", "b"), ["a", "b"], "left_semi").count() / max(true.count(), 1)
