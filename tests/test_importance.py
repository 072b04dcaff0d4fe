"""Importance by moved values: every row moves, missing values too, and every feature is in the report."""

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from incidence.plans import registry
from incidence.plans.learning import CATEGORIES, FLAGS, NUMBERS, prepared, train
from incidence.plans.training import permutation_importance

FEATURES = (*CATEGORIES, *NUMBERS, *FLAGS)


@pytest.fixture(scope="module")
def rows(spark):
    """Few rows, so few that parts by a hash would mostly hold one; missing ages tell the class."""
    kinds = {**{c: "string" for c in CATEGORIES}, **{c: "double" for c in NUMBERS}, **{c: "boolean" for c in FLAGS}}
    value = {"string": lambda i: "abc"[i % 3], "double": lambda i: float(i % 7), "boolean": lambda i: i % 2 == 0}
    out = [(i, "dead" if i % 3 == 0 else "light", *[None if c == "mean_age" and i % 3 == 0 else "a" if c == "np" else value[k](i * 5 // 2) for c, k in kinds.items()]) for i in range(60)]
    return spark.createDataFrame(out, "id long, severity string, " + ", ".join(f"{c} {k}" for c, k in kinds.items())).cache()


def test_importance_is_that_of_one_circle(spark, rows):
    model = train(rows, 5, 3)
    found = {r["feature"]: r["importance"] for r in permutation_importance(model, rows, FEATURES).collect()}
    assert set(found) == set(FEATURES) and found["np"] == 0
    measure = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")
    full = measure.evaluate(model.transform(prepared(rows)))
    circle = rows.orderBy(F.xxhash64("id"), "id").collect()
    for name in ("mean_age", "place", "is_weekend"):
        moved = [r.asDict() | {name: circle[(i + 1) % len(circle)][name]} for i, r in enumerate(circle)]
        expected = full - measure.evaluate(model.transform(prepared(spark.createDataFrame(moved, rows.schema))))
        assert found[name] == pytest.approx(expected, abs=1e-6)
    assert found["mean_age"] > 0.3


def test_no_rows(rows):
    none = permutation_importance(train(rows, 2, 2), rows.where("false"), ["hour", "np"]).collect()
    assert [(r["feature"], r["importance"]) for r in none] == [("hour", 0.0), ("np", 0.0)]


def test_the_report_has_every_feature(spark):
    report = registry.QUERIES["severity_report"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["name"] for r in report if r["kind"] == "importance") == sorted(FEATURES)
