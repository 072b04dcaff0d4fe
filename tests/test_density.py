"""Density clustering against a plain version on small sets."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from incidence.operators import density


def plain(vectors, size, samples):
    """Labels by the definition: sorted edges of the full graph, a dendrogram, condensed from the top, excess of mass."""
    n = len(vectors)
    apart = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))
    core = np.sort(apart, axis=1)[:, min(samples, n) - 1]
    reach = np.maximum(apart, np.maximum(core[:, None], core[None]))
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    top, tree, joined = list(range(n)), [], {}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for w, i, j in edges:
        a, b = root(i), root(j)
        if a != b:
            new = len(top)
            top.append(new)
            top[a] = top[b] = new
            joined[new] = (a, b, w)
            tree.append(w)
    points = {}

    def count(k):
        points[k] = 1 if k < n else sum(count(c) for c in joined[k][:2])
        return points[k]

    def leaves(k):
        return [k] if k < n else leaves(joined[k][0]) + leaves(joined[k][1])

    level = lambda w: 1 / max(w, density.LEAST_DISTANCE)
    labels = np.full(n, -1)
    if n < size or n < 2:
        return labels, sorted(tree)
    count(len(top) - 1)

    def walk(k, born):
        """(stability, chosen clusters below or here as lists of points) of the cluster whose node is k."""
        total, everyone, children = 0.0, leaves(k), []
        while True:
            if k < n:
                total += level(0) - born
                break
            a, b, w = joined[k]
            big = [c for c in (a, b) if points[c] >= size]
            total += sum(points[c] for c in (a, b) if points[c] < size) * (level(w) - born)
            if len(big) == 2:
                total += points[k] * (level(w) - born)
                children = [walk(c, level(w)) for c in big]
            if len(big) == 1:
                k = big[0]
                continue
            break
        below = sum(s for s, _ in children)
        if children and below > total:
            return below, [x for _, found in children for x in found]
        return total, [everyone]

    def from_top(k):
        while k >= n:
            a, b, w = joined[k]
            big = [c for c in (a, b) if points[c] >= size]
            if len(big) == 2:
                return [x for c in big for x in walk(c, level(w))[1]]
            if not big:
                return []
            k = big[0]
        return []

    for members in from_top(len(top) - 1):
        labels[members] = min(members)
    return labels, sorted(tree)


def cloud(seed, n, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 3)) * 4
    rows = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, 3)) * rng.choice([0.3, 0.8, 2.5], (n, 1))
    rows[rng.choice(n, copies, replace=False)] = rows[0]
    return rows


@pytest.mark.parametrize("seed, n, size, samples, copies", [(1, 300, 15, 5, 0), (3, 90, 5, 4, 30)])
def test_hdbscan_equals_the_plain_version(spark, seed, n, size, samples, copies):
    rows = cloud(seed, n, copies)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")
    want, tree = plain(rows, size, samples)
    out = {r["id"]: r for r in density.hdbscan(df, size, samples).collect()}
    assert [out[i]["cluster"] for i in range(n)] == want.tolist()
    assert all((r["probability"] == 0) == (r["cluster"] == -1) and r["probability"] <= 1 for r in out.values())
    if not copies:
        places, _ = density.collapsed(df)
        edges, _ = density.spanning_tree(places, samples, n_near=samples)
        assert np.allclose(sorted(r["w"] for r in edges.collect()), tree)


def test_hdbscan_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (None, [1.0, 1.0]), (2, None)], "id long, v array<double>")
    assert [tuple(r) for r in density.hdbscan(df, 3).collect()] == [(1, -1, 0.0)]
    assert density.hdbscan(df.limit(0), 3).count() == 0
    same = spark.createDataFrame([(i, [1.0]) for i in range(40)] + [(100 + i, [50.0 + i]) for i in range(3)], "id long, v array<float>")
    assert {r["cluster"] for r in density.hdbscan(same, 5, 3).collect()} == {-1}


def test_two_heaps_of_copies(spark):
    rows = [(i, [float(i % 2 * 9)]) for i in range(60)] + [(100, [4.0])]
    out = {r["id"]: r["cluster"] for r in density.hdbscan(spark.createDataFrame(rows, "id long, v array<double>"), 5, 3).collect()}
    assert {out[i] for i in range(0, 60, 2)} == {0} and {out[i] for i in range(1, 60, 2)} == {1}


class Caught(Exception):
    """Carries the function that a task would run."""


class Rows:
    """In place of a table: gives away what would run over its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        raise Caught(run)


def in_a_task(monkeypatch, call, *sent):
    """What `call` runs in a task for a block of queries (ids, matrix, ...)."""
    monkeypatch.setattr(density, "_asked", lambda *_: iter([SimpleNamespace(value=sent)]))
    with pytest.raises(Caught) as caught:
        call(Rows())
    return caught.value.args[0]


def most_held(run, batches):
    """(rows, MB that Python held at most meanwhile)."""
    tracemalloc.start()
    try:
        out = list(run(iter(batches)))
        held = tracemalloc.get_traced_memory()[1] / 2**20
        return pa.Table.from_batches(out).to_pydict(), held
    finally:
        tracemalloc.stop()


def test_memory_of_a_task_is_bounded(spark, monkeypatch):
    """A full block of queries meets full batches, vectors at random and all equally far: Python holds little, rows are right."""
    rng, n, m = np.random.default_rng(5), density.BLOCK, 16
    q, v = rng.normal(size=(n, 10)), rng.normal(size=(2 * density.VECTORS, 10))
    ids, there = np.arange(n), np.arange(n, n + len(v))
    columns = [pa.array(there), pa.array(list(v)), pa.array(np.ones(len(v), np.int64))]
    run = in_a_task(monkeypatch, lambda rows: density.neighbours(rows, m, rows), ids, q)
    out, held = most_held(run, [pa.RecordBatch.from_arrays(columns, ["id", "v", "n"])])
    assert held < 40
    assert len(out["a"]) == n * m
    for i in (0, 511, 512, n - 1):
        far = np.sqrt(((v - q[i]) ** 2).sum(1))
        first = np.lexsort((there, far))[:m]
        found = sorted((d, b) for a, b, d in zip(out["a"][i * m : i * m + m], out["b"][i * m : i * m + m], out["d"][i * m : i * m + m], strict=True) if a == i)
        assert [b for _, b in found] == there[first].tolist() and np.allclose([d for d, _ in found], far[first], rtol=1e-12)
    # Cores beyond all distances make each reach the same, so that every pair is a candidate.
    core, far = np.full(n, 100.0), np.full(len(v), 100.0)
    columns = [*columns[:2], pa.array(far), pa.array(np.full(len(v), n))]
    run = in_a_task(monkeypatch, lambda rows: density._nearest_outside(rows, rows), ids, q, core, ids)
    out, held = most_held(run, [pa.RecordBatch.from_arrays(columns, ["id", "v", "core", "comp"])])
    assert held < 80
    assert out["a"] == ids.tolist() and set(out["b"]) == {n} and set(out["w"]) == {100.0} and set(out["other"]) == {n}
