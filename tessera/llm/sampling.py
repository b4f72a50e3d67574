"""Labelled rows for fitting classifiers: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import BROADCAST_ROWS, held_out


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str, per_class: int | None = None) -> DataFrame:
    """``docs`` with ``target`` (0 or 1): the rows that have a value of ``label``, or at most ``per_class`` of each value.

    Rows of the held-out fold never get in. Of more than ``per_class`` those with the smallest hashes of their ids, so the
    choice is the same at every run and looks at nothing but the id. Up to ``BROADCAST_ROWS`` ids are broadcast; beyond,
    the join shuffles.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("target"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("target").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    if per_class is not None:
        sides = [usable.filter(F.col("target") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
        usable = sides[0].unionByName(sides[1])
    chosen = usable.withColumnRenamed("doc_id", "sample_id")
    side = F.broadcast(chosen) if per_class is not None or chosen.count() <= BROADCAST_ROWS else chosen
    return docs.join(side, F.col("doc_id").cast("long") == F.col("sample_id")).drop("sample_id")
