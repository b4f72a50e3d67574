"""Maximal marginal relevance: greedy picks that trade relevance against likeness to earlier picks.

The picks of a query depend on each other, over at most 2 * candidate_top_k rows, so
a query is one group of a grouped function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import DataError
from tessera.operators.dense import unit
from tessera.runtime import ship

SCHEMA = "qid long, id long, score double, mmr_score double, mmr_rank int"


def picks(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float, places: int = 9) -> list[tuple[int, float]]:
    """Rows in the order picked, with their score then; ``relevance`` is in order of preference for ties."""
    alike = unit(vectors) @ unit(vectors).T
    nearest = np.full(len(relevance), -np.inf)
    left = np.ones(len(relevance), bool)
    out = []
    while left.any() and len(out) < k:
        penalty = np.where(np.isneginf(nearest), 0.0, nearest)
        score = np.where(left, np.round(weight * relevance - (1 - weight) * penalty, places), -np.inf)
        i = int(score.argmax())
        out.append((i, float(score[i])))
        left[i] = False
        nearest = np.maximum(nearest, alike[i])
    return out


def select(candidates: DataFrame, points: DataFrame, k: int, weight: float, unlike: bool = False) -> DataFrame:
    """``candidates``: qid, id, rrf_score, rrf_rank, relevance; ``points``: id, vector, each id once.

    A candidate without a vector is an error; with ``unlike`` it is like no other (cosine 0), as is a vector without length.
    """
    if k <= 0 or not 0 < weight <= 1:
        raise ValueError("k must be positive and the weight above 0 and at most 1")
    ship(candidates.sparkSession)
    joined = candidates.join(points.select("id", "vector"), "id", "left")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rrf_rank")
        if group["id"].duplicated().any():
            raise DataError(f"repeated points or candidates: {group.loc[group['id'].duplicated(), 'id'].tolist()[:3]}")
        bare = group["vector"].isna()
        if bare.any() and not unlike:
            raise DataError(f"no vector for {group.loc[group['vector'].isna(), 'id'].tolist()[:3]}")
        wide = max((len(v) for v in group.loc[~bare, "vector"]), default=1)
        vectors = np.array([np.zeros(wide) if b else v for v, b in zip(group["vector"], bare, strict=True)], float)
        if not np.isfinite(vectors).all():
            raise DataError("a candidate's vector is not finite")
        chosen = picks(group["relevance"].to_numpy(), vectors, k, weight)
        at = [i for i, _ in chosen]
        return pd.DataFrame(
            {
                "qid": group["qid"].to_numpy()[at],
                "id": group["id"].to_numpy()[at],
                "score": group["rrf_score"].to_numpy()[at],
                "mmr_score": [s for _, s in chosen],
                "mmr_rank": range(1, len(at) + 1),
            }
        )

    needed = joined.select(F.col("qid").cast("long"), F.col("id").cast("long"), "rrf_score", "rrf_rank", "relevance", "vector")
    return needed.groupBy("qid").applyInPandas(one, SCHEMA)
