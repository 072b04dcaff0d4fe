"""Hierarchical density clustering (HDBSCAN): spanning tree of mutual reachability, condensed tree, excess of mass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidence.sources.files import materialize

#: Queries that every task holds at a time, and the queries and vectors of a product: a task's memory has this bound, whatever the table.
BLOCK, QUERIES, VECTORS = 1 << 13, 1 << 9, 1 << 10
#: Distances below this count as this, so that places of many copies have a finite density.
LEAST_DISTANCE = 1e-9
#: Splits of clusters that the driver works on at most; they are at most points / min_cluster_size.
MAX_SPLITS = 1_000_000
#: A product of matrices gives distances up to this share; candidates within it are worked out exactly.
_SLACK = 1e-9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten(), np.float64).reshape(len(whole), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row, the same from either side."""
    step = a - b
    return np.sqrt((step * step).sum(axis=-1))


def _exact_pairs(a: np.ndarray, row: np.ndarray, b: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of a[row] and b[col], some pairs at a time: equal reaches may name every pair of a product."""
    out = np.empty(len(row))
    for at in range(0, len(row), BLOCK):
        some = slice(at, at + BLOCK)
        out[some] = _exact(a[row[some]], b[col[some]])
    return out


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    square = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :]
    square -= 2 * q @ v.T
    return np.sqrt(np.maximum(square, 0, out=square), out=square)


def _parts(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[tuple[pa.RecordBatch, list[slice]]]:
    """The batches in parts of VECTORS rows, each with the slices of the queries that it meets one by one."""
    meets = [slice(at, at + QUERIES) for at in range(0, queries, QUERIES)]
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS):
            yield batch.slice(at, VECTORS), meets


def _asked(queries: DataFrame, *columns: str) -> Iterator[tuple]:
    """The queries in blocks that a task can hold: (ids, matrix, further columns), sent out."""
    context = queries.sparkSession.sparkContext
    blocks = max(1, -(-queries.count() // BLOCK))
    for block in range(blocks):
        dealt = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "v", *columns).toArrow()
        if dealt.num_rows:
            yield context.broadcast((dealt["id"].to_numpy(), _matrix(dealt["v"]), *(dealt[c].to_numpy() for c in columns)))


def neighbours(vectors: DataFrame, m: int, queries: DataFrame | None = None) -> DataFrame:
    """a, b, d, n: for each of `queries` (id, v; all of `vectors` if not given) its m nearest others of `vectors` (id, v, n) by (distance, id), and their n.

    Queries are asked, in blocks, against all; a task keeps m rows for each query of a block, and distances of QUERIES by VECTORS.
    """

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best, names, copies = np.full((len(ids), m), np.inf), np.zeros((len(ids), m), np.int64), np.zeros((len(ids), m), np.int64)
            for part, meets in _parts(batches, len(ids)):
                there, v, n = part["id"].to_numpy(), _matrix(part["v"]), part["n"].to_numpy()
                k = min(m, len(there))
                for some in meets:
                    apart = _distances(q[some], v)
                    apart[ids[some, None] == there[None, :]] = np.inf
                    rows = np.flatnonzero(apart.min(axis=1) <= best[some, -1] * (1 + _SLACK))
                    if not len(rows):
                        continue
                    apart = apart[rows]
                    first = np.argpartition(apart, k - 1, axis=1)[:, :k]
                    rows += some.start
                    found = np.where(np.isinf(np.take_along_axis(apart, first, axis=1)), np.inf, _exact(q[rows][:, None, :], v[first]))
                    whole = [np.concatenate(x, axis=1) for x in ((best[rows], found), (names[rows], there[first]), (copies[rows], n[first]))]
                    order = np.lexsort((whole[1], whole[0]), axis=-1)[:, :m]
                    best[rows], names[rows], copies[rows] = (np.take_along_axis(x, order, axis=1) for x in whole)
            row, place = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(names[row, place]), pa.array(best[row, place]), pa.array(copies[row, place])], ["a", "b", "d", "n"])

        return run

    near = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    out = None
    for sent in _asked(vectors if queries is None else queries):
        rows = materialize(vectors.select("id", "v", "n").mapInArrow(search(sent), "a long, b long, d double, n long").withColumn("_place", near).where(F.col("_place") <= m).drop("_place"))
        sent.unpersist()
        out = rows if out is None else out.unionByName(rows)
    return vectors.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"), "n").limit(0) if out is None else out


def _nearest_outside(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """a, b, w, comp, other: for each query (id, v, core, comp) the point of another component with the least (mutual reachability, id)."""

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, core, comp = sent.value
            best, names, other = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for part, meets in _parts(batches, len(ids)):
                there, v, far_core, far = part["id"].to_numpy(), _matrix(part["v"]), part["core"].to_numpy(), part["comp"].to_numpy()
                for some in meets:
                    reach = _distances(q[some], v)
                    np.maximum(np.maximum(reach, core[some, None], out=reach), far_core[None, :], out=reach)
                    reach[comp[some, None] == far[None, :]] = np.inf
                    limit = np.minimum(reach.min(axis=1), best[some]) * (1 + _SLACK)
                    row, col = np.nonzero((reach <= limit[:, None]) & np.isfinite(reach))
                    if not len(row):
                        continue
                    row += some.start
                    w = np.maximum(np.maximum(_exact_pairs(q, row, v, col), core[row]), far_core[col])
                    order = np.lexsort((there[col], w, row))
                    row, col, w = row[order], col[order], w[order]
                    head = np.r_[True, row[1:] != row[:-1]]
                    row, col, w = row[head], col[head], w[head]
                    less = (w < best[row]) | (w == best[row]) & (there[col] < names[row])
                    row, col = row[less], col[less]
                    best[row], names[row], other[row] = w[less], there[col], far[col]
            row = np.flatnonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(names[row]), pa.array(best[row]), pa.array(comp[row]), pa.array(other[row])], ["a", "b", "w", "comp", "other"])

        return run

    out = None
    for sent in _asked(queries, "core", "comp"):
        rows = materialize(vectors.select("id", "v", "core", "comp").mapInArrow(search(sent), "a long, b long, w double, comp long, other long"))
        sent.unpersist()
        out = rows if out is None else out.unionByName(rows)
    return out


def _edge(a: Column, b: Column, w: Column) -> Column:
    """Edges in an order without ties, the same from either end."""
    return F.struct(w.alias("w"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _roots(hooks: DataFrame) -> DataFrame:
    """node, root: where the pointers (node, to) of a forest end; roots point to themselves. The paths halve each round."""
    while True:
        far = hooks.select(F.col("node").alias("to"), F.col("to").alias("far"))
        moved = materialize(hooks.join(far, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        hooks = moved.select("node", "to")
        if moved.where("moved").isEmpty():
            return hooks.withColumnRenamed("to", "root")


def collapsed(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, members) of `vectors` (id, v): one place (id, v, n) per different vector, named by its smallest id, and (id, place) of all."""
    rows = vectors.where("id is not null and v is not null").select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    places = materialize(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "v", "n"))
    return places, rows.join(places.select("v", F.col("id").alias("place")), "v").select("id", "place")


def core_distances(places: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """id, core: the distance at which a place has `min_samples` points, its own among them; with fewer points at all, that to the farthest known."""
    own = places.select(F.col("id").alias("a"), F.col("n").alias("own"))
    seen = F.col("own") + F.sum("n").over(Window.partitionBy("a").orderBy("d", "b"))
    found = near.join(own, "a").select("a", "d", (seen >= min_samples).alias("enough")).groupBy("a").agg(F.coalesce(F.min(F.when(F.col("enough"), F.col("d"))), F.max("d")).alias("core"))
    return own.join(found, "a", "left").select(F.col("a").alias("id"), F.when(F.col("own") >= min_samples, 0.0).otherwise(F.coalesce("core", F.lit(0.0))).alias("core"))


def spanning_tree(places: DataFrame, min_samples: int, n_near: int = 16) -> tuple[DataFrame, DataFrame]:
    """(edges, cores): the minimum spanning tree of mutual reachability as (u, v, w), and (id, core) of all places.

    Boruvka's rounds: each component but the largest takes its least outgoing edge. Edges between near neighbours come
    from one exact search. A point whose list could miss a better one (its distance to the last of the list is no
    greater than its component's best edge) is asked again, in blocks, against all points outside its component, so the
    tree is exact. Every round at least halves the number of the other components.
    """
    n_near = max(n_near, min_samples)
    near = neighbours(places, n_near)
    cores = materialize(core_distances(places, near, min_samples))
    reach = near.groupBy(F.col("a").alias("id")).agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("k"))
    radius = F.when(F.col("k") < n_near, F.lit(float("inf"))).otherwise(F.greatest("core", "d") * (1 - _SLACK))
    points = materialize(places.join(cores, "id").join(reach, "id", "left").select("id", "v", "core", F.coalesce(radius, F.lit(float("inf"))).alias("radius")))
    core = lambda end: cores.select(F.col("id").alias(end), F.col("core").alias(f"core_{end}"))
    edges = materialize(near.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("core_a", "core_b", "d").alias("w")))
    comps, tree = points.select("id", F.col("id").alias("comp")), None
    while True:
        sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.orderBy(F.desc("n"), "comp").limit(2).collect()
        if len(largest) < 2:
            break
        giant = largest[0]["comp"]
        at = lambda end, name: comps.select(F.col("id").alias(end), F.col("comp").alias(name))
        edges = materialize(edges.join(at("a", "comp"), "a").join(at("b", "other"), "b").where("comp <> other"))
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", F.col("other").alias("comp"), F.col("comp").alias("other")))
        pick = F.min(F.struct(_edge(F.col("a"), F.col("b"), F.col("w")).alias("e"), "other"))
        known = materialize(ways.where(F.col("comp") != giant).groupBy("comp").agg(pick.alias("p")))
        here = points.join(comps, "id")
        unsure = here.where(F.col("comp") != giant).join(known, "comp", "left").where("p is null or radius <= p.e.w").select("id", "v", "core", "comp")
        asked = _nearest_outside(materialize(unsure), here)
        if asked is not None:
            more = asked.groupBy("comp").agg(pick.alias("p"))
            known = materialize(known.unionByName(more).groupBy("comp").agg(F.min("p").alias("p")))
        took = materialize(known.select("p.e.lo", "p.e.hi", "p.e.w").distinct())
        tree = took if tree is None else tree.unionByName(took)
        # Two components that took the same edge would point at each other: the smaller one is the root.
        back = known.select(F.col("comp").alias("other"), F.col("p.other").alias("back"))
        hooks = known.select("comp", F.col("p.other").alias("other")).join(back, "other", "left")
        hooks = hooks.select(F.col("comp").alias("node"), F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("to"))
        hooks = hooks.unionByName(sizes.select(F.col("comp").alias("node"), F.col("comp").alias("to")).where(F.col("node") == giant))
        comps = materialize(comps.join(_roots(hooks).withColumnsRenamed({"node": "comp"}), "comp").select("id", F.col("root").alias("comp")))
        edges = edges.select("a", "b", "w")
    if tree is None:
        tree = edges.select("a", "b", "w").toDF("lo", "hi", "w").limit(0)
    return materialize(tree.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "w")), cores


def first_clusters(edges: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """id, b: the edge (w, lo, hi) at which a place's component, as edges are added from the shortest on, first has `least` points.

    Only components with fewer points are worked on. Each takes its least outgoing edge: two that take the same one
    merge; one that leads, over others of its kind or not, to a component that is large enough gets there at its own
    edge, as those on the way have got there before. Places that have `least` points by themselves start at their core
    distance; with fewer points in all nothing is found and b is null.
    """
    e = materialize(edges.select("u", "v", _edge(F.col("u"), F.col("v"), F.col("w")).alias("e")))
    kind = "struct<w:double,lo:bigint,hi:bigint>"
    alone = F.when(F.col("n") >= least, F.struct(F.col("core").alias("w"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))).cast(kind)
    state = materialize(places.select("id", "n", F.col("id").alias("comp"), alone.alias("b"), (F.col("n") >= least).alias("big")))
    while True:
        at = lambda end, comp, big: state.select(F.col("id").alias(end), F.col("comp").alias(comp), F.col("big").alias(big))
        e = materialize(e.select("u", "v", "e").join(at("u", "cu", "bu"), "u").join(at("v", "cv", "bv"), "v").where("cu <> cv and not (bu and bv)"))
        if e.isEmpty():
            break
        ends = [e.select(F.col(c).alias("comp"), "e", F.col(d).alias("to"), F.col(far).alias("to_big")).where(~F.col(own)) for c, d, own, far in (("cu", "cv", "bu", "bv"), ("cv", "cu", "bv", "bu"))]
        picks = ends[0].unionByName(ends[1]).groupBy("comp").agg(F.min(F.struct("e", "to", "to_big")).alias("p"))
        sizes = state.where("not big").groupBy("comp").agg(F.sum("n").alias("n"))
        sized = materialize(picks.join(sizes, "comp").select("comp", "p.e", "p.to", "p.to_big", "n"))
        far = sized.select(F.col("comp").alias("to"), F.col("e").alias("far_e"), F.col("n").alias("far_n"))
        meet = F.coalesce(F.col("far_e") == F.col("e"), F.lit(False))
        how = F.when(F.col("to_big"), "join").when(meet & (F.col("n") + F.col("far_n") >= least), "join").when(meet, "merge").otherwise("open")
        jump = materialize(sized.join(far, "to", "left").select("comp", "e", how.alias("how"), F.when(meet, F.least("comp", "to")).otherwise(F.col("to")).alias("to")))
        for _ in range(2):  # up to four components on the way; longer ways take further rounds
            there = jump.select(F.col("comp").alias("to"), F.col("how").alias("far_how"), F.col("to").alias("far"))
            is_open, leads = F.col("how") == "open", F.col("far_how").isin("join", "open")
            jump = jump.join(there, "to", "left").select("comp", "e", F.when(~is_open, F.col("how")).when(leads, F.col("far_how")).otherwise("wait").alias("how"), F.when(is_open & leads, F.col("far")).otherwise(F.col("to")).alias("to"))
        found = jump.where("how in ('join', 'merge')").select("comp", F.col("e").alias("via"), "how", F.col("to").alias("next"))
        out = state.join(found, "comp", "left")
        joins = F.coalesce(F.col("how") == "join", F.lit(False)) & ~F.col("big")
        state = materialize(out.select("id", "n", F.coalesce("next", "comp").alias("comp"), F.when(joins, F.col("via")).otherwise(F.col("b")).alias("b"), (F.col("big") | joins).alias("big")))
    return state.select("id", "b")


@dataclass
class _Tree:
    """Clusters of a condensed tree: 0 .. leaves - 1 are basins, then one per split in order; parents follow their children."""

    names: np.ndarray  # of the basins
    parent: np.ndarray  # -1: none
    formed: list[tuple]  # (w, lo, hi) of the birth or of the split below

    def ended(self, k: int) -> tuple | None:
        return self.formed[self.parent[k]] if self.parent[k] >= 0 else None


def _condensed(births: list, splits: list) -> _Tree:
    """`births`: (basin, edge); `splits`: (edge, basin, basin) by edge. Basins meet from the shortest split on."""
    names = np.array(sorted(b for b, _ in births), np.int64)
    place = {int(b): i for i, b in enumerate(names)}
    formed: list[tuple] = [()] * len(names)
    for b, edge in births:
        formed[place[b]] = edge
    parent = np.full(len(names) + len(splits), -1, np.int64)
    top = list(range(len(names) + len(splits)))  # union-find with the newest cluster as the root

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for edge, a, b in splits:
        new = len(formed)
        for old in (root(place[a]), root(place[b])):
            parent[old] = top[old] = new
        formed.append(edge)
    return _Tree(names, parent, formed)


def _level(w: float) -> float:
    return 1.0 / max(w, LEAST_DISTANCE)


def _chosen(tree: _Tree, left: dict[int, tuple[int, float]]) -> np.ndarray:
    """For each cluster the chosen one that holds it, or -1. `left`: cluster -> (points that leave it for nothing, sum of their levels)."""
    n = len(tree.parent)
    stable, points, below = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
    best, chosen = np.zeros(n), np.zeros(n, bool)
    for k in range(n):  # children come before parents
        gone, levels = left.get(k, (0, 0.0))
        ended = tree.ended(k)
        born = _level(ended[0]) if ended is not None else 0.0
        inner = points[k]
        stable[k] = levels - gone * born + inner * (_level(tree.formed[k][0]) - born)
        points[k] += gone
        chosen[k] = stable[k] >= below[k]
        best[k] = max(stable[k], below[k])
        if tree.parent[k] >= 0:
            points[tree.parent[k]] += points[k]
            below[tree.parent[k]] += best[k]
    out = np.full(n, -1, np.int64)
    for k in range(n - 1, -1, -1):
        up = tree.parent[k]
        if up >= 0:  # all points together are no cluster
            out[k] = out[up] if out[up] >= 0 else k if chosen[k] else -1
    return out


def _holders(sent):
    """Rows (id, n, w, lo, hi, basin) -> those and the cluster whose time the edge falls in, climbing by powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ups, w, lo, hi = sent.value
        for batch in batches:
            at = np.searchsorted(names, batch["basin"].to_numpy())
            edge = [batch[c].to_numpy() for c in ("w", "lo", "hi")]
            for up in ups[::-1]:
                to = up[at]
                k = np.maximum(to, 0)
                over = (w[k] < edge[0]) | (w[k] == edge[0]) & ((lo[k] < edge[1]) | (lo[k] == edge[1]) & (hi[k] <= edge[2]))
                at = np.where((to >= 0) & over, to, at)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n"], batch["w"], pa.array(at.astype(np.int64))], ["id", "n", "w", "holder"])

    return run


def hdbscan(vectors: DataFrame, min_cluster_size: int = 30, min_samples: int | None = None) -> DataFrame:
    """id, cluster, probability: `vectors` (id, v) by density, clusters named by their smallest id, noise -1.

    Clusters are those of the condensed tree (splits with `min_cluster_size` points on both sides) that have the most
    excess of mass; all points together are none. probability is the level at which a point leaves its cluster as a
    share of the cluster's highest one, 0 for noise. `min_samples` is `min_cluster_size` if not given.

    Equal vectors are one place that counts as often as they come. The tree, the points' first clusters and their places in the
    hierarchy are joins; the driver sees one row per basin, a part of the tree between splits, of which there are at
    most points / min_cluster_size; more than MAX_SPLITS are an error. Rows without id or vector are left out; vectors
    must have one length and ids differ. An empty table gives no rows.
    """
    k = min_cluster_size if min_samples is None else min_samples
    places, members = collapsed(vectors)
    edges, cores = spanning_tree(places, k)
    firsts = materialize(first_clusters(edges, places.join(cores, "id").select("id", "n", "core"), min_cluster_size))
    at = lambda end: firsts.select(F.col("id").alias(end), F.col("b").alias(f"b_{end}"))
    order = materialize(edges.select("u", "v", _edge(F.col("u"), F.col("v"), F.col("w")).alias("e")).join(at("u"), "u").join(at("v"), "v"))
    split = F.coalesce((F.col("e") > F.col("b_u")) & (F.col("e") > F.col("b_v")), F.lit(False))
    basins = materialize(_components(order.where(~split).select(F.col("u").alias("a"), F.col("v").alias("b")), places.select("id")))
    held = materialize(firsts.where("b is not null").join(basins, "id").join(places.select("id", "n"), "id").select("id", "n", "b.w", "b.lo", "b.hi", "basin"))
    of = lambda end: basins.select(F.col("id").alias(end), F.col("basin").alias(f"basin_{end}"))
    cuts = materialize(order.where(split).join(of("u"), "u").join(of("v"), "v").select("e.w", "e.lo", "e.hi", "basin_u", "basin_v"))
    if cuts.count() > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits: take a larger min_cluster_size")
    births = [(r["basin"], tuple(r["e"])) for r in held.groupBy("basin").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).collect()]
    tree = _condensed(births, sorted(((r["w"], r["lo"], r["hi"]), r["basin_u"], r["basin_v"]) for r in cuts.collect()))
    ups = [tree.parent]
    while (ups[-1] >= 0).any():
        ups.append(np.where(ups[-1] >= 0, ups[-1][np.maximum(ups[-1], 0)], -1))
    w, lo, hi = (np.array([f[i] for f in tree.formed] or [0]) for i in range(3))
    sent = vectors.sparkSession.sparkContext.broadcast((tree.names, ups, w, lo, hi))
    left = materialize(held.mapInArrow(_holders(sent), "id long, n long, w double, holder long"))
    level = 1 / F.greatest(F.col("w"), F.lit(LEAST_DISTANCE))
    sums = {r["holder"]: (r["n"], r["levels"]) for r in left.groupBy("holder").agg(F.sum("n").alias("n"), F.sum(F.col("n") * level).alias("levels")).collect()}
    chosen = _chosen(tree, sums)
    names = vectors.sparkSession.createDataFrame([(k, int(c)) for k, c in enumerate(chosen) if c >= 0], "holder long, top long")
    told = left.join(F.broadcast(names), "holder").select("id", "top", level.alias("level"))
    named = told.groupBy("top").agg(F.min("id").alias("cluster"), F.max("level").alias("most"))
    labels = told.join(F.broadcast(named), "top").select(F.col("id").alias("place"), "cluster", (F.col("level") / F.col("most")).alias("probability"))
    return members.join(labels, "place", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def _components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    from incidence.operators.clustering import smallest_reachable

    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return smallest_reachable(both, nodes).withColumnRenamed("label", "basin")
