"""The corpus pipeline: toxic documents go, copies and near copies go, secrets are masked, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes what a stage returns to the shared
folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, secrets, simhash, toxicity
from tessera.llm.bpe import default_tokenizer
from tessera.llm.shared import documents, keep_rows, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    model, limits = toxicity.trained(spark, docs, sf_dir)
    return toxicity.scored(spark, docs, model, limits).filter("NOT toxic_rejected").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal up to white space: the longest, then the smallest id."""
    return keep_rows(spark, docs, exact_dedup.exact_dedup(spark, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return keep_rows(spark, docs, simhash.near_duplicates(spark, docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return secrets.redact(spark, docs, "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences."""
    return packing.pack_documents(spark, docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: A trained classifier and a tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
