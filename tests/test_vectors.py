"""The vector search over all queries that are due."""

import pytest

from incidence.operators import vectors
from incidence.plans import registry
from tests.compare import connect, same

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("block, rows", [(vectors.BLOCK, vectors.ROWS), (5, 3)])
def test_every_hundredth_vector_asks(spark, monkeypatch, block, rows):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "ROWS", rows)
    monkeypatch.setattr(vectors, "VECTORS", 7 if rows == 3 else vectors.VECTORS)
    found = registry.QUERIES["vector_search_all"](spark, SF)
    due = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    assert {r["query_id"] for r in found.collect()} == due and len(due) > 3
    same(connect(SF), found, registry.SQL["vector_search_all"])


def test_equal_vectors_go_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 0.0]), (101, None)], "vec_id long, embedding array<float>")
    rows = vectors.nearest(df, df.where("vec_id in (3, 100)"), 4).collect()
    assert [(r["vec_id"], r["similarity"]) for r in sorted(rows, key=lambda r: r["place"]) if r["query_id"] == 3] == [(0, 1.0), (1, 1.0), (2, 1.0), (4, 1.0)]
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["place"]) if r["query_id"] == 100] == [0, 1, 2, 3]
