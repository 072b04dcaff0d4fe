"""The nearest vectors by cosine, exact, for many queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidence.sources.files import materialize

#: Queries that every task holds at a time (8 MB of 64 numbers each, and as much again for their best), and the vectors and queries of a product.
BLOCK, VECTORS, ROWS = 1 << 14, 1 << 10, 1 << 10
#: Similarities count in steps of 1e-5.
STEPS = 100_000
#: Below any similarity.
_NONE = -2 * STEPS


def _units(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row per vector, at length 1; a zero vector stays."""
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = np.asarray(whole.flatten(), np.float64).reshape(len(whole), -1)
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1.0, norm)


def _best(asked, k: int):
    """Batches of vectors -> the k nearest of a task for each query: similarity in steps, then the smaller id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = asked.value
        steps, ids = np.full((len(query_ids), k), _NONE, np.int64), np.zeros((len(query_ids), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                names = part["vec_id"].to_numpy()
                order = np.argsort(names, kind="stable")
                names, units = names[order], _units(part["embedding"])[order].T
                n = len(names)
                for a in range(0, len(query_ids), ROWS):
                    met = np.rint(queries[a : a + ROWS] @ units * STEPS).astype(np.int64)
                    met[query_ids[a : a + ROWS, None] == names[None, :]] = _NONE
                    rows = np.flatnonzero(met.max(axis=1) >= steps[a : a + ROWS, -1])
                    if not len(rows):
                        continue
                    met, rows = met[rows], rows + a
                    first = np.argpartition(met * n - np.arange(n), n - min(k, n), axis=1)[:, n - min(k, n) :]
                    all_steps = np.concatenate([steps[rows], np.take_along_axis(met, first, axis=1)], axis=1)
                    all_ids = np.concatenate([ids[rows], names[first]], axis=1)
                    kept = np.lexsort((all_ids, -all_steps), axis=-1)[:, :k]
                    steps[rows], ids[rows] = np.take_along_axis(all_steps, kept, axis=1), np.take_along_axis(all_ids, kept, axis=1)
        row, place = np.nonzero(steps > _NONE)
        columns = [pa.array(query_ids[row]), pa.array(ids[row, place]), pa.array(steps[row, place])]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "steps"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, place, similarity: the k nearest of `vectors` for each of `queries` (both vec_id, embedding), itself left out.

    Order is similarity at five places, then the id. Queries go out in blocks of about BLOCK, one block after the
    other; a task keeps k rows per query, and a fixed number of tasks keeps what is shuffled to that many times the
    result. Null vectors are left out; all others must have the same length, and ids of queries differ.
    """
    context = vectors.sparkSession.sparkContext
    vectors = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").coalesce(4 * context.defaultParallelism)
    queries = queries.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    blocks = max(1, -(-queries.count() // BLOCK))
    best = Window.partitionBy("query_id").orderBy(F.desc("steps"), "vec_id")
    found = []
    for block in range(blocks):
        dealt = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        asked = context.broadcast((dealt["vec_id"].to_numpy(), _units(dealt["embedding"]) if dealt.num_rows else np.zeros((0, 1))))
        rows = vectors.mapInArrow(_best(asked, k), "query_id long, vec_id long, steps long") if dealt.num_rows else vectors.select(F.lit(0).cast("long").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("steps")).limit(0)
        rows = rows.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k)
        found.append(rows.select("query_id", "vec_id", "place", (F.col("steps") / STEPS).alias("similarity")))
        if blocks > 1:
            found[-1] = materialize(found[-1])
            asked.unpersist()
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out
