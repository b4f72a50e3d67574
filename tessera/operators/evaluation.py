"""Ranking quality: first relevant rank of each case, HitRate and MRR, overall and by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)
UNSPECIFIED = "unspecified"


def cases(raw: DataFrame) -> DataFrame:
    """case_id, query, relevant, stress_type from rows with target_chunk_id or relevant_chunks[].chunk_id.

    A target wins over a list. Rows without id, query or relevant chunk are marked in ``error``.
    """
    has = raw.columns
    null_list = F.lit(None).cast("array<string>")
    listed = F.transform("relevant_chunks", lambda c: F.trim(c["chunk_id"])) if "relevant_chunks" in has else null_list
    listed = F.array_distinct(F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    target = F.trim("target_chunk_id") if "target_chunk_id" in has else F.lit(None).cast("string")
    group = F.trim("stress_type") if "stress_type" in has else F.lit(None).cast("string")
    out = raw.select(
        F.trim("case_id").alias("case_id"), F.trim("query").alias("query"),
        F.when(target != "", F.array(target)).otherwise(listed).alias("relevant"),
        F.coalesce(F.nullif(group, F.lit("")), F.lit(UNSPECIFIED)).alias("stress_type"),
    )
    error = (
        F.when(F.coalesce(F.col("case_id"), F.lit("")) == "", "no case_id")
        .when(F.coalesce(F.col("query"), F.lit("")) == "", "no query")
        .when(F.size("relevant") == 0, "nothing relevant")
    )
    return out.withColumn("error", error)


def first_ranks(ranked: DataFrame, relevant: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``asked`` (mode, case_id, stress_type) with rank: of the first relevant of the k results, else null.

    ``ranked``: mode, case_id, id, rank; ``relevant``: case_id, id.
    """
    hits = ranked.filter(F.col("rank") <= k).join(relevant.distinct(), ["case_id", "id"], "left_semi")
    first = hits.groupBy("mode", "case_id").agg(F.min("rank").cast("int").alias("rank"))
    return asked.join(first, ["mode", "case_id"], "left")


def metrics(ranks: DataFrame, k: int) -> DataFrame:
    """mode, stress_type (null: all), case_count, hit_rate_<c> for each cutoff up to k, and mrr."""
    hit = lambda c: F.avg(F.when(F.col("rank") <= c, 1.0).otherwise(0.0))
    mrr = F.avg(F.when(F.col("rank") <= k, F.lit(1.0) / F.col("rank")).otherwise(0.0))
    measures = [F.count(F.lit(1)).alias("case_count"), *[F.round(hit(c), 4).alias(f"hit_rate_{c}") for c in CUTOFFS if c <= k], F.round(mrr, 4).alias("mrr")]
    # Both levels come out of one pass; the overall row of a mode has no group.
    return ranks.groupingSets([["mode"], ["mode", "stress_type"]], "mode", "stress_type").agg(*measures)
