"""Boosted trees and exact Shapley values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidence.operators import boosting

CLASSES = ("low", "middle", "high")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = []
    for i in range(3000):
        x, y, kind = rng.normal(), rng.normal(), rng.choice(["a", "b", "c"])
        score = x + (y > 0.5) * (kind == "b") * 3 + rng.normal() * 0.4
        out.append((i, float(x) if i % 50 else None, float(y), str(kind) if i % 70 else None, float(rng.normal()), CLASSES[int(score > 0.7) + int(score > 2)]))
    return spark.createDataFrame(out, "id long, x double, y double, kind string, noise double, severity string").cache()


@pytest.fixture(scope="module")
def model(rows):
    return boosting.fit(rows.where("id % 5 <> 0"), "severity", ["x", "y", "noise"], ["kind"], CLASSES, F.col("id") % 5 == 1, rounds=25, patience=3)


def test_losses_fall_and_training_stops(model):
    training, validation = zip(*model.losses, strict=True)
    assert abs(training[0] - math.log(3)) < 1e-9
    assert all(b < a for a, b in zip(training, training[1:], strict=False))
    best = int(np.argmin(validation))
    assert len(model.trees) == best and validation[best] < 0.6 * validation[0]
    assert len(validation) <= 26 and (len(validation) == 26 or len(validation) - 1 - best == 3)


def test_predictions(rows, model):
    out = boosting.predicted(rows.where("id % 5 = 0"), model).collect()
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 and r["predicted"] == CLASSES[int(np.argmax(r["proba"]))] for r in out)
    assert np.mean([r["predicted"] == r["severity"] for r in out]) > 0.8


def test_histograms_give_the_best_stump(spark):
    """One round at depth 1 against all splits worked out directly."""
    rng = np.random.default_rng(1)
    data = [(int(a), int(b), CLASSES[int(a > 3) + int(b > 5 and a > 3)]) for a, b in rng.integers(0, 9, (400, 2))]
    df = spark.createDataFrame(data, "a long, b long, severity string")
    model = boosting.fit(df, "severity", ["a", "b"], [], CLASSES, F.lit(False), rounds=1, patience=5, depth=1, rate=1.0)
    counts = {c: sum(d[2] == c for d in data) for c in CLASSES}
    weight = np.array([400 / (3 * counts[d[2]]) for d in data])
    y = np.array([CLASSES.index(d[2]) for d in data])
    g = weight[:, None] * (1 / 3 - np.eye(3)[y])
    h = weight[:, None] * np.full((400, 3), 2 / 9)
    worth = lambda m: (g[m].sum(0) ** 2 / (h[m].sum(0) + 1)).sum()
    gains = {(f, cut): worth(side) + worth(~side) - worth(np.ones(400, bool)) for f in (0, 1) for cut in range(8) for side in [np.array([d[f] <= cut for d in data])]}
    # Without validation rows nothing is kept, so the tree is grown again from the sums.
    assert model.trees == [] and max(gains, key=gains.get) == (0, 3)
    kept = boosting.fit(df, "severity", ["a", "b"], [], CLASSES, F.rand(3) < 0.3, rounds=1, patience=5, depth=1)
    tree = kept.trees[0]
    assert tree.feature[0] == 0 and kept.numbers["a"][tree.cut[0] - 1] == 3


def brute_shapley(model, bins):
    """Subsets of features known; the others go both ways by cover."""

    def expected(tree, row, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        ends = tree.left[node], tree.right[node]
        if f in known:
            return expected(tree, row, known, ends[0] if row[f] <= tree.cut[node] else ends[1])
        return sum(tree.cover[e] / tree.cover[node] * expected(tree, row, known, e) for e in ends)

    n = len(model.features)
    worth = lambda row, known: model.start + sum(expected(t, row, known) for t in model.trees)
    out = np.zeros((len(bins), n, len(model.classes)))
    for r, row in enumerate(bins):
        for f in range(n):
            others = [o for o in range(n) if o != f]
            for k in range(n):
                for known in itertools.combinations(others, k):
                    out[r, f] += math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (worth(row, {*known, f}) - worth(row, {*known}))
    return out


def test_shapley_values_are_exact(model):
    bins = np.random.default_rng(2).integers(0, boosting.BINS, (12, 4)).astype(np.uint8)
    assert max(len(p) for t in model.trees for _, p in boosting._paths(t)) >= 3
    assert np.allclose(boosting.shapley(model, bins), brute_shapley(model, bins))
    assert np.allclose(boosting.base(model) + boosting.shapley(model, bins).sum(axis=1), model.margins(bins))


def test_attributions_add_up_and_rank(rows, model):
    base = boosting.base(model)
    for r in boosting.attributed(rows.limit(200), model).collect():
        assert np.allclose(base + np.array(r["attribution"]).sum(axis=0), r["margins"])
    ranked = {(r["class"], r["place"]): r["feature"] for r in boosting.ranked(rows, model).collect()}
    assert len(ranked) == 12 and ranked["low", 1] == "x" and all(ranked[c, 4] == "noise" for c in CLASSES)


def test_no_rows(spark, model):
    empty = spark.createDataFrame([], "x double, y double, noise double, kind string, severity string")
    assert boosting.predicted(empty, model).count() == 0 and boosting.ranked(empty, model).count() == 0
    assert boosting.fit(empty, "severity", ["x"], ["kind"], CLASSES, F.lit(False), rounds=2).trees == []


def test_trees_and_packed_bins_read_whole_columns():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    bins = rng.integers(0, boosting.BINS, (300, 3)).astype(np.uint8)
    packed = pa.array([r.tobytes() for r in bins], pa.binary())
    assert (boosting._unpacked(packed, 3) == bins).all() and (boosting._unpacked(packed.slice(7, 50), 3) == bins[7:57]).all()
    tree = boosting.Tree([0, -1, 2, -1, -1], [9, 0, 20, 0, 0], [1, 0, 3, 0, 0], [2, 0, 4, 0, 0], [np.zeros(1)] * 5, [1.0] * 5)
    assert tree.leaves_of(bins).tolist() == [1 if r[0] <= 9 else 3 if r[2] <= 20 else 4 for r in bins]
    assert boosting.Tree([-1], [0], [0], [0], [np.zeros(1)], [1.0]).leaves_of(bins).tolist() == [0] * 300


def test_a_pass_walks_few_trees_and_equal_rows_are_one(rows, monkeypatch):
    """What was walked grew with the rounds, and copies of a row were summed one by one."""
    walked, seen = [], []
    kept, records = boosting._histograms, boosting.materialize
    monkeypatch.setattr(boosting, "_histograms", lambda trees, *rest: walked.append(len(trees)) or kept(trees, *rest))
    monkeypatch.setattr(boosting, "materialize", lambda df: seen.append(out := records(df)) or out)
    fitted = lambda df, n: boosting.fit(df, "severity", ["x", "y", "noise"], ["kind"], CLASSES, F.col("id") % 5 == 1, rounds=n, patience=30)
    once = fitted(rows.where("id % 5 <> 0"), 25)
    assert len(walked) > 60 and max(walked) < boosting.KEPT
    size = lambda df: df.selectExpr("sum(length(y))").first()[0]
    packed = size(seen[1])
    seen.clear()
    often = fitted(rows.where("id % 5 <> 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(4)))).drop("_again"), 2)
    assert size(seen[1]) == packed <= rows.where("id % 5 <> 0").count()
    assert np.allclose(once.losses[0], often.losses[0])


def test_margins_are_those_of_all_trees(rows):
    """The losses that training tells of its last round are those of the whole model on all rows, read one by one."""
    learn = rows.where("id % 5 <> 0")
    model = boosting.fit(learn, "severity", ["x", "y", "noise"], ["kind"], CLASSES, F.col("id") % 5 == 1, rounds=23, patience=30)
    told = boosting.predicted(learn.where("id % 5 = 1"), model).collect()
    counts = {r[0]: r[1] for r in learn.where("id % 5 <> 1").groupBy("severity").count().collect()}
    weight = np.array([1 / counts[r["severity"]] for r in told])
    loss = -np.log([r["proba"][CLASSES.index(r["severity"])] for r in told])
    assert len(model.trees) > boosting.KEPT and np.isclose((weight * loss).sum() / weight.sum(), model.losses[len(model.trees)][1])
