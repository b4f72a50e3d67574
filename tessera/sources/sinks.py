"""Sinks: versioned points, manifest, token artifact, evaluation results.

Each version has a path or partition of its own; a marker is written last, so a
reader that asks for it never sees half a version.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DataError, IndexContract, as_dict
from tessera.operators.indexing import ensure_count
from tessera.runtime import remove

MANIFEST_SCHEMA_VERSION, ARTIFACT_SCHEMA_VERSION = 1, 1


def sorted_json(*columns: str) -> Column:
    """A JSON object with its keys in order and nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def metadata(contract: IndexContract, version: str, n: int) -> dict:
    return {
        "record_type": "metadata", "manifest_schema_version": MANIFEST_SCHEMA_VERSION, "index_version": version,
        "collection_name": contract.collection(version), "chunk_count": n, **as_dict(contract),
    }


def manifest_lines(records: DataFrame) -> DataFrame:
    """One line of JSON for each record."""
    typed = records.withColumn("record_type", F.lit("chunk"))
    return typed.select(sorted_json(*typed.columns).alias("value"))


def write_manifest(records: DataFrame, contract: IndexContract, version: str, path: str) -> None:
    """``path``/metadata and ``path``/chunks as lines of JSON."""
    spark = records.sparkSession
    ordered = manifest_lines(records.orderBy("source_path", "chunk_order"))
    ordered.write.mode("overwrite").text(f"{path}/chunks")
    head = json.dumps(metadata(contract, version, records.count()), sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(head,)], "value string").write.mode("overwrite").text(f"{path}/metadata")


def write_token_artifact(entries: DataFrame, path: str, header: dict[str, str]) -> None:
    """Entries (chunk_id, tokens) by id, then the header that makes them valid."""
    spark = entries.sparkSession
    entries.select("chunk_id", "tokens").orderBy("chunk_id").write.mode("overwrite").json(f"{path}/entries")
    full = header | {"chunk_count": entries.count(), "schema_version": ARTIFACT_SCHEMA_VERSION}
    spark.createDataFrame([(json.dumps(full, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/header")


def ensure_collection(spark: SparkSession, path: str, dimensions: int) -> bool:
    """Whether points are stored at ``path``; an error if theirs have other dimensions."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return False
    other = spark.read.parquet(path).filter(F.size("vector") != dimensions).select("chunk_id", F.size("vector").alias("n")).first()
    if other is not None:
        raise DataError(f"the stored vector of {other.chunk_id} has {other.n} dimensions, not {dimensions}")
    return True


def write_points(points: DataFrame, path: str, version: str, expected: int) -> None:
    """Replace the partition of one version, sorted by chunk id for lookups; other versions stay.

    The new points are counted in a place beside it first, so a version is replaced whole or not at all.
    """
    spark = points.sparkSession
    points.withColumn("index_version", F.lit(version)).sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{path}-new-{version}")
    new = spark.read.parquet(f"{path}-new-{version}")
    ensure_count(new, expected, "points of this version")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_version").parquet(path)
    remove(spark, f"{path}-new-{version}")


def upsert_points(new: DataFrame, path: str, version: str, key: str = "point_id") -> None:
    """Points of one version with those of ``new`` put in place of theirs with the same ``key``, or added."""
    spark = new.sparkSession
    old = spark.read.parquet(path).filter(F.col("index_version") == version).drop("index_version")
    once = new.dropDuplicates([key])
    if (n := new.count()) != once.count():
        raise DataError(f"{n} new points, but some {key} twice")
    both = old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    write_points(both, path, version, both.count())


def write_results(metrics: DataFrame, source: str, params: dict, path: str) -> None:
    """Metrics as JSON with the parameters and the SHA-256 of the case file; no query texts."""
    spark = metrics.sparkSession
    digest = spark.read.format("binaryFile").load(source).select(F.sha2("content", 256).alias("source_sha256"))
    metrics.crossJoin(F.broadcast(digest)).withColumn("params", F.lit(json.dumps(params, sort_keys=True))).write.mode("overwrite").json(path)
