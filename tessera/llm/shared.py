"""Helpers that several operators use: shared storage, crc folds, row keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import fresh_path, shared_dir, ship, spread, written

__all__ = ["fresh_path", "shared_dir", "written"]

#: The six white-space characters of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def release() -> None:
    """Give memory that is free back to the system: workers live on, and their free memory adds up over stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with this package's code on the executors, which keep no free memory afterwards."""
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stripped(text: Column) -> Column:
    """``text`` without the six white-space characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


#: Rows up to which a side of a join is broadcast after they are counted; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: What tells rows of a documents table apart, whatever their order: id, code points and hash of the text.
KEY = ("doc_id", "n_points", "content")


def row_key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_points"), F.xxhash64(text).alias("content")]


def keep_rows(spark: SparkSession, docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (KEY and kept, a row for each row of ``docs``) keep, all columns.

    Rows with the same key are the same row repeated, as far as operators can tell; one of them stays if any does: the one
    with the smallest hash of all its columns.
    """
    keys = verdicts.groupBy(*KEY).agg(F.max("kept").alias("__stays"), F.count(F.lit(1)).alias("copies"))
    special = keys.filter("copies > 1 OR NOT __stays").select(*[F.col(k).alias(f"__{k}") for k in KEY], "__stays")
    special = written(spark, special, "dropped")
    side = F.broadcast(special) if special.count() <= BROADCAST_ROWS else special
    same = [c.eqNullSafe(F.col(f"__{k}")) for k, c in zip(KEY, row_key(), strict=True)]
    on = same[0] & same[1] & same[2]
    rest = docs.join(side, on, "left_anti")
    repeated = special.filter("__stays")
    if repeated.isEmpty():
        return rest
    both = docs.join(repeated, on, "inner")
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")
    return rest.unionByName(both.groupBy(*[f"__{k}" for k in KEY]).agg(first).select("__row.*"))


def fold(doc_id: Column) -> Column:
    """The fifth of the rows that an id falls in, 0 to 4: crc32 of the id as text, mod 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that training never sees: ``fold`` 0."""
    return fold(doc_id) == 0
