"""Vectors for records from a pluggable embedder, batch by batch.

An embedder takes texts and returns (position, vector) pairs in any order, as services do. Positions put them back in
order; a missing, repeated or unknown position and a vector of another dimension are errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.config import DataError
from tessera.runtime import ship

Embedder = Callable[[list[str]], Iterable[tuple[int, list[float]]]]


def in_order(answer: Iterable[tuple[int, list[float]]], n: int, dimensions: int) -> list[list[float]]:
    """The vectors of ``n`` texts by their positions."""
    by_place: dict[int, list[float]] = {}
    for place, vector in answer:
        if place in by_place or not 0 <= place < n:
            raise DataError(f"the embedder answered position {place} of {n} twice or out of range")
        if len(vector) != dimensions:
            raise DataError(f"a vector has {len(vector)} dimensions, not {dimensions}")
        by_place[place] = list(map(float, vector))
    if len(by_place) != n:
        raise DataError(f"the embedder answered {len(by_place)} of {n} texts")
    return [by_place[i] for i in range(n)]


def embedded(records: DataFrame, embedder: Embedder, dimensions: int, key: str = "chunk_id", text: str = "embedding_text", size: int = 10) -> DataFrame:
    """``key`` and vector of each record; the embedder gets at most ``size`` texts at a time."""
    if size < 1:
        raise ValueError("size must be positive")
    ship(records.sparkSession)
    rows = records.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                texts = [t or "" for t in part.column(1).to_pylist()]
                vectors = pa.array(in_order(embedder(texts), len(texts), dimensions), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[key, "vector"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("vector", T.ArrayType(T.DoubleType()))]))
