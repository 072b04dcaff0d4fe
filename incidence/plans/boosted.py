"""The boosted severity model: training with early stop, held-out metrics, attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidence.operators import boosting
from incidence.plans.base import query
from incidence.plans.features import feature_frame
from incidence.plans.learning import CATEGORIES, CLASSES, FLAGS, NUMBERS, stratified
from incidence.sources.files import materialize


def split_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from with is_valid for every fifth of each class, rows to test on)."""
    rows = materialize(stratified(feature_frame(spark, sf_dir), "id", "severity"))
    learn = stratified(rows.where("not is_test").drop("is_test"), "id", "severity", 0.2).withColumnRenamed("is_test", "is_valid")
    return learn, rows.where("is_test").drop("is_test")


def trained(learn: DataFrame, **how) -> boosting.Model:
    return boosting.fit(learn, "severity", (*NUMBERS, *FLAGS), CATEGORIES, CLASSES, F.col("is_valid"), **how)


def macro_f1(told: DataFrame, label: str, predicted: str) -> float:
    """The mean over classes of the F1 score; `told` is summed to one row per pair of classes."""
    pairs = [(r[label], r[predicted], r["n"]) for r in told.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n")).collect()]
    names = {p[0] for p in pairs}
    scores = [2 * sum(n for a, b, n in pairs if a == b == c) / sum(n * ((a == c) + (b == c)) for a, b, n in pairs) for c in names]
    return sum(scores) / max(len(scores), 1)


@query()
def severity_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of every round on both folds, then the figures of the kept rounds on held-out accidents."""
    learn, test = split_rows(spark, sf_dir)
    model = trained(learn)
    told = materialize(boosting.predicted(test.select("severity", *model.features), model).select("severity", "predicted", F.get("proba", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("severity")).cast("int") - 1).alias("p")))
    loss, hits = told.agg(F.avg(-F.log(F.greatest("p", F.lit(1e-15)))), F.avg((F.col("severity") == F.col("predicted")).cast("double"))).first()
    rows = [(part, i, round(x, 6)) for i, pair in enumerate(model.losses) for part, x in zip(("training loss", "validation loss"), pair, strict=True)]
    rows += [(name, len(model.trees), round(float(x), 6)) for name, x in (("test loss", loss), ("test accuracy", hits), ("test f1_macro", macro_f1(told, "severity", "predicted")))]
    return spark.createDataFrame(rows, "figure string, round int, value double")


@query()
def severity_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class the features by the mean size of their exact Shapley values over all held-out accidents."""
    learn, test = split_rows(spark, sf_dir)
    out = boosting.ranked(test, trained(learn, rounds=20))
    return out.select("class", "feature", F.round("mean_abs", 6).alias("mean_abs"), "place")
