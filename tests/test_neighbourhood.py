"""Neighbour graph, fuzzy links, layout and its trustworthiness against plain versions."""

import math

import numpy as np
import pytest

from incidence.operators import neighbourhood
from incidence.plans.topics import main_directions
from incidence.sources.files import materialize

K = 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 20)) * 4
    return np.concatenate([c + rng.normal(size=(25, 20)) for c in centres])


@pytest.fixture(scope="module")
def vectors(spark, data):
    return materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>"))


@pytest.fixture(scope="module")
def graph(vectors):
    return materialize(neighbourhood.neighbour_graph(vectors, K))


def plain_ranks(v):
    apart = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(apart, np.inf)
    order = np.argsort(apart, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(1, len(v) + 1)[None].repeat(len(v), 0), axis=1)
    return apart, order, ranks


def plain_trust(v, flat, k):
    _, near, _ = plain_ranks(flat)
    _, _, ranks = plain_ranks(v)
    n = len(v)
    lost = sum(max(0, ranks[i, j] - k) for i in range(n) for j in near[i, :k])
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def test_nearly_all_neighbours_are_found(data, vectors, graph):
    apart, order, _ = plain_ranks(data)
    rows = graph.collect()
    assert len(rows) == len(data) * K and len({(r["a"], r["b"]) for r in rows}) == len(rows)
    assert all(r["a"] != r["b"] and math.isclose(r["d"], apart[r["a"], r["b"]], rel_tol=1e-9) for r in rows)
    share = np.mean([r["b"] in order[r["a"], :K] for r in rows])
    assert share >= 0.95
    assert math.isclose(neighbourhood.recall(graph, vectors, vectors, K), share, abs_tol=1e-9)


def test_weights_of_links(graph):
    near = {}
    for r in graph.collect():
        near.setdefault(r["a"], []).append((r["d"], r["b"]))
    one_way = {}
    for a, found in near.items():
        first = min(found)[0]
        low, high = 1e-9, 1e9
        for _ in range(200):
            middle = math.sqrt(low * high)
            total = sum(math.exp(-(d - first) / middle) for d, _ in found)
            low, high = (middle, high) if total < math.log2(K) else (low, middle)
        one_way |= {(a, b): math.exp(-(d - first) / low) for d, b in found}
    links = {(r["lo"], r["hi"]): r["w"] for r in neighbourhood.fuzzy_links(graph).collect()}
    assert links.keys() == {(min(p), max(p)) for p in one_way}
    for (lo, hi), w in links.items():
        p, q = one_way.get((lo, hi), 0.0), one_way.get((hi, lo), 0.0)
        assert abs(w - (p + q - p * q)) < 1e-6 and 0 < w <= 1


def test_layout_keeps_more_neighbours_than_the_main_directions(spark, data, vectors, graph):
    start = main_directions(vectors)
    flat = neighbourhood.layout(materialize(neighbourhood.fuzzy_links(graph)), start, epochs=15)
    before, after = (np.array([[r["x"], r["y"]] for r in d.orderBy("id").collect()]) for d in (start, flat))
    assert after.shape == (len(data), 2) and np.isfinite(after).all()
    trusted = [neighbourhood.trust(vectors, d, vectors, K) for d in (start, flat)]
    assert np.allclose(trusted, [plain_trust(data, d, K) for d in (before, after)])
    assert trusted[1] > trusted[0]


def test_few_and_odd_rows(spark):
    schema = "id long, v array<double>"
    empty = spark.createDataFrame([], schema)
    assert neighbourhood.neighbour_graph(empty, 3).count() == 0
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [5.0, 5.0]), (4, [0.0, 0.0])], schema)
    rows = {(r["a"], r["b"]): r["d"] for r in neighbourhood.neighbour_graph(odd, 3).collect()}
    assert rows == {(1, 2): 1.0, (1, 4): 0.0, (2, 1): 1.0, (2, 4): 1.0, (4, 1): 0.0, (4, 2): 1.0}
    links = {(r["lo"], r["hi"]): r["w"] for r in neighbourhood.fuzzy_links(neighbourhood.neighbour_graph(odd, 3)).collect()}
    assert links.keys() == {(1, 2), (1, 4), (2, 4)} and links[1, 4] == 1.0
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    none = spark.createDataFrame([], "lo long, hi long, w double")
    assert [tuple(r) for r in neighbourhood.layout(none, one, epochs=2).collect()] == [(1, 0.0, 0.0)]
    assert math.isnan(neighbourhood.trust(odd.where("id is not null and v is not null"), one, one, 3))
