"""Exact nearest neighbours by cosine.

The queries of a search are a stated set; they are taken in blocks to the tasks as
one matrix, every task multiplies its points with it, strip by strip, and keeps the k
best of each query, and a window ranks what the tasks kept. Points are read once a
block and never shuffled; the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DataError
from tessera.operators.indexing import ensure_empty
from tessera.runtime import ship

#: Queries that are sent together (32 MB at 64 dimensions), and those that are compared with a batch at a time.
BLOCK, STRIP = 1 << 16, 512


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows without length stay 0, so their cosine is 0."""
    size = np.sqrt((rows**2).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _block(points: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, places: int) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast((ids, unit(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        strips = [(q[a : a + STRIP], [np.zeros((len(q[a : a + STRIP]), 0)), np.zeros((len(q[a : a + STRIP]), 0), np.int64)]) for a in range(0, len(q), STRIP)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), unit(matrix(batch.column(1))).T
            for own, kept in strips:
                score = np.hstack([kept[0], np.round(own @ vectors, places)])
                pid = np.hstack([kept[1], np.broadcast_to(ids, (len(own), len(ids)))])
                order = np.lexsort((pid, -score), axis=1)[:, :k]
                kept[:] = np.take_along_axis(score, order, 1), np.take_along_axis(pid, order, 1)
        for i, (_, (score, pid)) in enumerate(strips):
            names = np.repeat(qid[i * STRIP : i * STRIP + len(score)], score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(pid.ravel()), pa.array(score.ravel())], names=["qid", "id", "score"])

    return points.select(F.col("id").cast("long"), "vector").mapInArrow(run, "qid long, id long, score double")


def top_k(points: DataFrame, queries: DataFrame, k: int, places: int = 9) -> DataFrame:
    """qid, id, score, rank: the k points (id, vector) with the largest cosine for each query (qid, qvec).

    Points without a vector are no candidates. Vectors of different dimensions, among the queries or between queries and
    points, are an error.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = points.sparkSession
    ship(spark)
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "qvec").filter("qvec IS NOT NULL")
    sizes = [r[0] for r in asked.select(F.size("qvec")).distinct().take(2)]
    found = spark.createDataFrame([], "qid long, id long, score double")
    if len(sizes) > 1:
        raise DataError(f"queries have {sorted(sizes)} dimensions")
    if sizes:
        ensure_empty(points.filter(F.size("vector") != sizes[0]).select("id"), f"points have other dimensions than the {sizes[0]} of the queries")
        usable, held = points.filter("vector IS NOT NULL"), []
        for r in asked.toLocalIterator():
            held.append(r)
            if len(held) == BLOCK:
                found, held = found.unionByName(_sent(usable, held, k, places)), []
        if held:
            found = found.unionByName(_sent(usable, held, k, places))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _sent(points: DataFrame, rows: list, k: int, places: int) -> DataFrame:
    return _block(points, np.array([r.qid for r in rows], np.int64), np.array([r.qvec for r in rows], float), k, places)
