"""Index records, versions and the checks that a stored index has to pass."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DataError, IndexContract, as_dict
from tessera.functions.ids import sha256, uuid5
from tessera.functions.vectors import is_finite


def point_id(chunk_id: Column, namespace: str = IndexContract.point_namespace) -> Column:
    return uuid5(F.concat(F.lit(f"{namespace}:"), chunk_id))


def records(chunks: DataFrame, namespace: str = IndexContract.point_namespace) -> DataFrame:
    """Chunks with source_path, point_id and embedding_input_hash."""
    return chunks.withColumnRenamed("path", "source_path").withColumns(
        {"point_id": point_id(F.col("chunk_id"), namespace), "embedding_input_hash": sha256(F.col("embedding_text"))}
    )


def index_version(index: DataFrame, contract: IndexContract) -> DataFrame:
    """index_version, n_records: SHA-256 over contract and records, independent of their order.

    Records are hashed one by one and the hashes added up in four lanes of 64 bits, so no task ever holds
    all of them; a version is thus not the hash of one long text.
    """
    each = F.sha2(F.concat_ws("\x1f", "source_path", "chunk_id", "embedding_input_hash"), 256)
    lanes = [F.sum(F.conv(F.substring(each, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    told = json.dumps(as_dict(contract), sort_keys=True, ensure_ascii=False)
    total = index.agg(F.count(F.lit(1)).alias("n_records"), *[F.coalesce(x, F.lit("0")).alias(f"lane{i}") for i, x in enumerate(lanes)])
    whole = F.concat_ws("\x1f", F.lit(told), F.col("n_records").cast("string"), *(f"lane{i}" for i in range(4)))
    return total.select(F.sha2(whole, 256).alias("index_version"), "n_records")


def duplicate_ids(index: DataFrame) -> DataFrame:
    """Ids that name different records; empty for a sound index."""
    checks = [
        ("chunk_id", F.struct("source_path", "content_hash", "chunk_order")),
        ("point_id", F.struct("chunk_id")),
    ]
    found = [
        index.groupBy(F.col(k).alias("id")).agg(F.count_distinct(v).alias("n"), F.count(F.lit(1)).alias("rows"))
        .filter("n > 1 OR rows > 1").select(F.lit(k).alias("kind"), "id", "rows")
        for k, v in checks
    ]
    return found[0].unionByName(found[1])


def order_violations(index: DataFrame) -> DataFrame:
    """Documents whose chunk orders are not 0 to n - 1, each once."""
    stats = index.groupBy("document_id").agg(
        F.count("chunk_order").alias("n"), F.count_distinct("chunk_order").alias("distinct_orders"),
        F.min("chunk_order").alias("first"), F.max("chunk_order").alias("last"),
    )
    return stats.filter("n <> distinct_orders OR first <> 0 OR last <> n - 1")


def payload_violations(points: DataFrame, dimensions: int, version: str | None = None) -> DataFrame:
    """chunk_id and reason of points that no search may use."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reason = (
        F.when(blank("chunk_id"), "no chunk_id")
        .when(blank("document_id"), "no document_id")
        .when(blank("text"), "no text")
        .when(F.col("token_count").isNull() | (F.col("token_count") <= 0), "token_count not positive")
        .when(F.col("chunk_order").isNull() | (F.col("chunk_order") < 0), "chunk_order negative")
        .when(F.col("vector").isNull() | (F.size("vector") != dimensions), "wrong dimensions")
        .when(~is_finite(F.col("vector")), "vector not finite")
    )
    if version is not None:
        reason = reason.when(F.col("index_version") != version, "other version")
    return points.select("chunk_id", reason.alias("reason")).filter("reason IS NOT NULL")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def ensure_empty(violations: DataFrame, what: str) -> None:
    """Raise DataError with a few examples if there are violations."""
    if rows := violations.take(3):
        raise DataError(f"{what}: {rows}")


def ensure_count(df: DataFrame, expected: int, what: str) -> None:
    if (found := df.count()) != expected:
        raise DataError(f"{what}: {found} instead of {expected}")
