"""Reciprocal-rank fusion of dense and lexical candidates, and its normalised score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import RetrievalParams
from tessera.functions.vectors import is_close


def order() -> list[Column]:
    """Best first: score, better of both ranks, dense rank, lexical rank, id; a missing rank is last."""
    return [F.desc("rrf_score"), F.least("dense_rank", "bm25_rank").asc(), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("id")]


def rrf(dense: DataFrame, lexical: DataFrame, params: RetrievalParams) -> DataFrame:
    """qid, id, rrf_score, dense_rank, bm25_rank, rrf_rank over the union of both lists (qid, id, rank)."""
    sides = [x.select("qid", "id", F.col("rank").alias(name)) for x, name in ((dense, "dense_rank"), (lexical, "bm25_rank"))]
    part = lambda w, name: F.coalesce(F.lit(float(w)) / (F.lit(float(params.rank_constant)) + F.col(name)), F.lit(0.0))
    score = part(params.dense_weight, "dense_rank") + part(params.bm25_weight, "bm25_rank")
    both = sides[0].join(sides[1], ["qid", "id"], "full_outer").withColumn("rrf_score", F.round(score, 12))
    return both.withColumn("rrf_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order())))


def normalised(fused: DataFrame) -> DataFrame:
    """``relevance`` from 0 to 1 within a query; 1 for all where all scores are equal."""
    whole = Window.partitionBy("qid")
    low, high = F.min("rrf_score").over(whole), F.max("rrf_score").over(whole)
    bounds = fused.withColumn("low", low).withColumn("high", high)
    spread = F.when(is_close(F.col("low"), F.col("high")), 1.0).otherwise((F.col("rrf_score") - F.col("low")) / (F.col("high") - F.col("low")))
    return bounds.withColumn("relevance", spread).drop("low", "high")
