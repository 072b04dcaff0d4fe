"""Around the models: importance, search, topic descriptions, stop words, projections, stability, reports."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidence.model import table
from incidence.operators.gates import severity_failures
from incidence.operators.ranks import numbered
from incidence.plans.base import query
from incidence.plans.learning import CATEGORIES, FLAGS, NUMBERS, _parts, calibrated, prepared, train
from incidence.plans.learning import binned
from incidence.plans.text import adjusted_rand
from incidence.sources.files import materialize

#: Words that every post of the channel has and that tell no topic apart.
DOMAIN_STOP_WORDS = [
    "автомобиль", "автомобили", "автомобиля", "автомобилем", "автомобилю", "автомобилях", "авто", "машина", "машины", "машину", "машиной", "машине",
    "транспорт", "транспортного", "транспортные", "тс",
    "госавтоинспекция", "госавтоинспекции", "госавтоинспекцию", "гибдд", "мвд", "увд", "умвд", "полиция", "полицейские", "полицейский",
    "инспектор", "инспекторы", "инспекторов", "сотрудник", "сотрудники", "сотрудниками", "наряд", "наряды",
    "приморский", "приморского", "приморском", "приморье", "приморья", "приморью", "приморским", "приморской", "край", "края", "крае", "краю",
    "владивосток", "владивостока", "владивостоке",
    "произошло", "произошла", "случилось", "сообщает", "сообщили", "пресс", "служба", "службы", "сообщению", "напомнил", "напомнили",
    "предупреждает", "предупреждаем", "уважаемые", "граждане",
    "год", "года", "году", "годов", "час", "часа", "часов", "минут", "число", "числа", "первый", "второй", "третий",
    "также", "ещё", "более", "менее", "около", "примерно", "после", "которые", "которая", "которое", "которого", "которому",
    "место", "места", "месте", "местом", "местах", "случай", "случая", "случае", "случаи", "случаев",
]


def stop_words() -> list[str]:
    """Spark's Russian stop words and the channel's own."""
    return sorted({*StopWordsRemover.loadDefaultStopWords("russian"), *DOMAIN_STOP_WORDS})


def topic_words(text: Column, stops: Sequence[str]) -> Column:
    """Lower-cased Cyrillic words of three letters at least that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([а-яё]{3,})"), F.lit(1))
    return F.array_except(words, F.array(*map(F.lit, stops))) if not stops else F.filter(words, lambda w: ~w.isin(list(stops)))


def described_topics(rows: DataFrame, words: DataFrame, n_examples: int = 5, n_chars: int = 300) -> DataFrame:
    """topic, size, share_pct, top_words, examples: rows have topic, id, text; words have topic, word, place.

    The examples are the first rows of a topic by id, cut short. Only ids are ranked, in a window that keeps the first
    few; texts follow for these alone.
    """
    sizes = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("share_pct", F.round(100.0 * F.col("size") / F.sum("size").over(Window.partitionBy()), 2))  # a row per topic
    first = rows.select("topic", "id").withColumn("_place", F.row_number().over(Window.partitionBy("topic").orderBy("id"))).where(F.col("_place") <= n_examples)
    texts = first.join(rows.select("topic", "id", F.substring("text", 1, n_chars).alias("text")), ["topic", "id"])
    examples = texts.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "text"))), lambda x: x["text"]).alias("examples"))
    best = words.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), ",").alias("top_words"))
    return sizes.join(best, "topic", "left").join(examples, "topic", "left")


@query(r"""
with words as (select lang as topic, unnest(regexp_extract_all(lower(text), '([a-z]{3,})', 1)) as word from documents),
tf as (select topic, word, count(*) as n from words group by all),
sizes as (select avg(n) as mean from (select topic, sum(n) as n from tf group by topic)),
scored as (select topic, word, round(n * ln(1 + mean / sum(n) over (partition by word)), 5) as score from tf, sizes),
best as (select topic, string_agg(word, ',' order by place) as top_words from (select *, row_number() over (partition by topic order by score desc, word) as place from scored) where place <= 10 group by topic),
placed as (select lang as topic, substr(text, 1, 300) as text, row_number() over (partition by lang order by doc_id) as place from documents),
examples as (select topic, md5(string_agg(coalesce(text, ''), '|' order by place)) as examples_md5 from placed where place <= 5 group by topic)
select s.topic, s.size, s.share_pct, top_words, examples_md5 from (select lang as topic, count(*) as size, round(100e0 * count(*) / sum(count(*)) over (), 2) as share_pct from documents group by lang) s
left join best using (topic) left join examples using (topic)""")
def topic_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics (languages of the documents) with size, share, words and examples."""
    from incidence.plans.text import ctfidf_topic_words

    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("topic"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    out = described_topics(rows, ctfidf_topic_words(spark, sf_dir))
    return out.select("topic", "size", "share_pct", "top_words", F.md5(F.array_join("examples", "|").cast("binary")).alias("examples_md5"))


@query()
def topic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector in the plane of the two main directions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    flat = PCA(k=2, inputCol="v", outputCol="xy").fit(rows).transform(rows)
    xy = vector_to_array("xy")
    return flat.select("vec_id", "label", F.round(xy[0], 4).alias("x"), F.round(xy[1], 4).alias("y"))


def stability(rows: DataFrame, labellings: Mapping[str, Column]) -> DataFrame:
    """first, second, ari for each two labellings of the rows that have both (null: the row isn't in that sample)."""
    out = None
    names = list(labellings)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = rows.select(labellings[a].alias("a"), labellings[b].alias("b")).where("a is not null and b is not null")
            row = adjusted_rand(both).select(F.lit(a).alias("first"), F.lit(b).alias("second"), "ari")
            out = row if out is None else out.unionByName(row)
    return out


_SAMPLES = {f"sample {s}": s for s in range(3)}
_LABEL_SQL = "case when (vec_id * 7919 + {s} * 104729) % 10 <> 0 then (label + (vec_id * {k}) // 1000) % 5 end"


def _ari_sql(a: int, b: int) -> str:
    x, y = (_LABEL_SQL.format(s=s, k=s + 1) for s in (a, b))
    return f"""(with pairs as (select {x} as a, {y} as b from embeddings), cells as (select a, b, count(*) as n from pairs where a is not null and b is not null group by all),
s as (select sum(n * (n - 1) / 2e0) as s, sum(n) as n from cells), ra as (select sum(n * (n - 1) / 2e0) as s from (select sum(n) as n from cells group by a)), rb as (select sum(n * (n - 1) / 2e0) as s from (select sum(n) as n from cells group by b)),
e as (select s.s as index, ra.s * rb.s / (s.n * (s.n - 1) / 2e0) as expected, (ra.s + rb.s) / 2e0 as most from s, ra, rb)
select 'sample {a}' as first, 'sample {b}' as second, round((index - expected) / nullif(most - expected, 0), 6) as ari from e)"""


@query(" union all ".join(f"select * from {_ari_sql(a, b)}" for a in range(3) for b in range(a + 1, 3)))
def topic_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far labellings of nine-tenths samples agree on the rows that two of them share."""
    label = lambda s: F.when((F.col("vec_id") * 7919 + s * 104729) % 10 != 0, (F.col("label") + F.floor(F.col("vec_id") * (s + 1) / 1000)) % 5)
    return stability(table(spark, sf_dir, "embeddings"), {name: label(s) for name, s in _SAMPLES.items()})


def weighted_f1(pairs: Iterable[tuple[float, float, int]]) -> float:
    """The F1 scores of the classes weighted by their rows, from (label, prediction, rows)."""
    hits, labels, told = Counter(), Counter(), Counter()
    for label, prediction, n in pairs:
        labels[label] += n
        told[prediction] += n
        hits[label] += n * (label == prediction)
    return sum(n * 2 * hits[c] / (n + told[c]) for c, n in labels.items()) / max(sum(labels.values()), 1)


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Iterable[str]) -> DataFrame:
    """feature, importance: how much the weighted F1 falls when a feature's values change places among the rows.

    All rows stand in one circle by a hash of their id, and a row takes the value of the next one, a missing value too.
    The model sees each row once as it is and once per feature in a single pass; what comes back is a count per feature,
    class and prediction.
    """
    features = list(features)
    columns = ("severity", *CATEGORIES, *NUMBERS, *FLAGS)
    order = [F.col("_shuffled"), F.col("id")]
    placed = materialize(numbered(rows.select("id", *columns).withColumn("_shuffled", F.xxhash64("id")), order, "_place").drop("_shuffled"))
    before = F.when(F.col("_place") > 1, F.col("_place") - 1).otherwise(F.lit(placed.count()).cast("long"))
    paired = placed.join(placed.select(before.alias("_place"), F.struct(*features).alias("_next")), "_place").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    variant = lambda moved: F.struct(F.lit(moved).alias("_moved"), *[F.col(f"_next.{c}" if c == moved else c).alias(c) for c in columns])
    told = model.transform(prepared(paired.select(F.inline(F.array(*map(variant, ["", *features]))))))
    counts = {f: [] for f in ["", *features]}
    for r in told.groupBy("_moved", "label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["_moved"]].append((r["label"], r["prediction"], r["n"]))
    full = weighted_f1(counts[""])
    out = [(f, round(full - weighted_f1(counts[f]), 6)) for f in features]
    return rows.sparkSession.createDataFrame(sorted(out, key=lambda x: (-x[1], x[0])), "feature string, importance double")


def searched(rows: DataFrame, grid: Sequence[tuple[int, int]], folds: int = 3) -> tuple[tuple[int, int], DataFrame]:
    """The best (trees, depth) by the mean area under the curve of deadly accidents over stratified folds, and all results."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    placed = numbered(rows.withColumn("_shuffled", F.xxhash64("id")), [F.col("_shuffled"), F.col("id")], "_place", ["severity"])
    placed = materialize(placed.withColumn("_fold", F.col("_place") % folds).drop("_shuffled", "_place"))
    auc, out = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y"), []
    for trees, depth in grid:
        areas = []
        for k in range(folds):
            model = train(placed.where(F.col("_fold") != k).drop("_fold"), trees, depth)
            at = model.stages[0].labels.index("dead")
            told = model.transform(prepared(placed.where(F.col("_fold") == k))).select(vector_to_array("probability")[at].alias("p"), (F.col("severity") == "dead").cast("double").alias("y"))
            areas.append(auc.evaluate(told))
        out.append((trees, depth, round(sum(areas) / folds, 6)))
    best = max(out, key=lambda x: x[2])
    return best[:2], rows.sparkSession.createDataFrame(out, "trees int, depth int, auc_dead double")


@query()
def severity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small grid of forests."""
    fit, _, _ = _parts(spark, sf_dir)
    return searched(fit, [(5, 3), (10, 5)], folds=3)[1]


@query()
def severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of a severity model before it goes live: metrics, the gate's verdict and the features' importance."""
    fit, validation, test = _parts(spark, sf_dir)
    model = train(fit, 10, 5)
    out = materialize(calibrated(model, validation, test).select("severity", "prediction", "proba"))
    at = model.stages[0].labels
    hits = out.select("severity", F.get(F.array(*map(F.lit, at)), F.col("prediction").cast("int")).alias("told"))
    each = hits.groupBy("severity", "told").count().collect()  # a row per pair of classes
    f1 = []
    for c in at:
        both = sum(r["count"] for r in each if r["severity"] == r["told"] == c)
        total = sum(r["count"] for r in each if r["severity"] == c) + sum(r["count"] for r in each if r["told"] == c)
        f1.append(2 * both / total if total else 0.0)
    dead = out.select(F.col("proba")["dead"].alias("p"), (F.col("severity") == "dead").cast("double").alias("y"))
    ece = binned(dead, 15).agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).first()[0]
    failures = severity_failures(sum(f1) / len(f1), ece)
    told = [("f1_macro", round(sum(f1) / len(f1), 4)), ("ece_dead", round(float(ece), 4)), ("gate_failures", float(len(failures)))]
    report = spark.createDataFrame([("metric", k, v) for k, v in told], "kind string, name string, value double")
    ranked = permutation_importance(model, test, (*CATEGORIES, *NUMBERS, *FLAGS))
    return report.unionByName(ranked.select(F.lit("importance").alias("kind"), F.col("feature").alias("name"), F.col("importance").alias("value")))
