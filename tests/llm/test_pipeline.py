"""The pipeline's stages in order, each on what the one before kept."""

import corpus_pipeline
from incidence.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        found = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids is None or found <= ids
        ids, docs = found, spark.createDataFrame(out.toPandas(), docs.schema)
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_queries_cover_all_rows(spark):
    for name in ("op3_url_filters", "op4_best_fit_packing", "op5_simhash_near_dedup", "op7_quality_rules", "op8_line_dedup", "op10_sharding"):
        out, table = queries.QUERIES[name](spark, SF), "pages" if name.startswith("op3") else "documents"
        key = "page_id" if table == "pages" else "doc_id"
        assert out.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def _words(seed, n):
    import random

    rng = random.Random(seed)
    return ". ".join(" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(12)).capitalize() for _ in range(n // 12)) + "."


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words int, removed string, component_id long, _id int, _row string, failed string"


def _docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", None, None if t is None else len(t), False, 7, "x", 1, 2, "r", "f") for k, t in rows], SCHEMA)


def test_stages_keep_columns_whatever_their_names_and_take_odd_rows(spark):
    """Null, empty and very long texts, null and repeated keys, repeated rows: clean documents stay as they are, others as the stages say."""
    good, other, long = _words(1, 120), _words(2, 240), _words(3, 24_000)
    rows = [(1, good), (1, good), (2, good), (3, None), (4, ""), (5, long), (None, other), (6, other + "\n" + _words(4, 240)), (7, "short text")]
    docs = _docs(spark, rows)
    told = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES[:-1]}
    for out in told.values():
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    kept = {name: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in out.collect()) for name, out in told.items()}
    assert {k for k, _ in kept["quality rules"]} == {1, 2, 5, -1, 6} and (5, long) in kept["quality rules"]
    assert len(kept["line dedup"]) == len(rows) and (5, long) in kept["line dedup"] and (7, "short text") in kept["line dedup"]
    near = [k for k, _ in kept["SimHash near-dedup"]]
    assert near.count(2) == 0 and 1 in near and 5 in near and 6 in near and -1 in near
    assert len(kept["benchmark decontamination"]) == len(rows)
    assert all(r["kept"] is False and r["_row"] == "r" and r["failed"] == "f" and r["n_words"] == 7 for r in told["quality rules"].collect())


def test_stages_take_empty_tables(spark):
    docs = _docs(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
