"""Index building, hybrid search over a batch of queries, and evaluation, as one plan each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import IndexContract, RetrievalParams
from tessera.functions.text import tokenised, valid_query
from tessera.operators import bm25, context, dense, evaluation, fusion, indexing, markdown, mmr
from tessera.sources import readers, sinks


@dataclass
class Corpus:
    """What a search runs over: points (id, vector) and an inverted index over the same ids."""

    points: DataFrame
    lexical: bm25.Bm25Index


def build(docs: DataFrame, contract: IndexContract, count: Callable[[str], int] = len) -> tuple[DataFrame, str]:
    """Checked index records of Markdown documents (path, text), and their version."""
    records = indexing.records(markdown.chunks(docs, contract, count)).persist()
    indexing.ensure_empty(indexing.duplicate_ids(records), "repeated ids")
    indexing.ensure_empty(indexing.order_violations(records), "broken chunk orders")
    return records, indexing.index_version(records, contract).first().index_version


def store(records: DataFrame, vectors: DataFrame, contract: IndexContract, version: str, path: str) -> None:
    """Points first, then manifest and token artifact, which mark the version as complete.

    ``vectors``: chunk_id, vector; every record needs one.
    """
    spark = records.sparkSession
    sinks.ensure_collection(spark, f"{path}/points", contract.embedding_dimensions)
    points = records.drop("embedding_text").join(vectors, "chunk_id", "left")
    indexing.ensure_empty(indexing.payload_violations(points, contract.embedding_dimensions), "unusable points")
    sinks.write_points(points, f"{path}/points", version, records.count())
    sinks.write_manifest(records, contract, version, f"{path}/manifest-{version}")
    entries = tokenised(records.select("chunk_id", F.col("embedding_text").alias("tokens")), "tokens")
    sinks.write_token_artifact(entries, f"{path}/bm25-{version}", artifact_header(contract, version))


def artifact_header(contract: IndexContract, version: str) -> dict[str, str]:
    return {"index_version": version, "collection_name": contract.collection(version), "tokenizer_version": contract.bm25_tokenizer_version}


def load(spark: SparkSession, path: str, contract: IndexContract, version: str) -> tuple[DataFrame, DataFrame]:
    """Points and token entries of one version, which must hold the same chunks."""
    points = readers.points(spark, f"{path}/points", version)
    entries = readers.token_artifact(spark, f"{path}/bm25-{version}", artifact_header(contract, version))
    indexing.ensure_empty(indexing.set_difference(points, entries, "chunk_id"), "points and token entries differ")
    return points, entries


def candidates(corpus: Corpus, queries: DataFrame, params: RetrievalParams) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical candidates for queries with qid, qvec and tokens."""
    near = dense.top_k(corpus.points, queries.select("qid", "qvec"), params.candidate_top_k)
    found = bm25.top_k(corpus.lexical, queries.select("qid", "tokens"), params.candidate_top_k)
    return near, found


def hybrid(corpus: Corpus, queries: DataFrame, params: RetrievalParams, unlike: bool = False) -> DataFrame:
    """qid, id, score, mmr_score, mmr_rank: the cores of each query. ``unlike``: as in ``mmr.select``."""
    near, found = candidates(corpus, queries, params)
    return mmr.select(fusion.normalised(fusion.rrf(near, found, params)), corpus.points, params.top_k, params.mmr_lambda, unlike)


def search(points: DataFrame, lexical: bm25.Bm25Index, queries: DataFrame, params: RetrievalParams, top_k: int) -> DataFrame:
    """qid, contexts (an array of texts, best first) of each query (qid, query, qvec): the whole way at once.

    ``points``: chunks of one version with their vectors. A blank or too long query, a ``top_k`` out of its range and a
    lexical result without a point are errors.
    """
    params = params.asked(top_k)
    indexing.ensure_empty(queries.filter(~F.coalesce(valid_query(F.col("query")), F.lit(False))).select("qid"), "queries that are blank or too long")
    asked = tokenised(queries.select("qid", F.col("query").alias("tokens"), "qvec"), "tokens")
    numbered = points.select("chunk_id", "vector")
    near = dense.top_k(_numbers(numbered), asked.select("qid", "qvec"), params.candidate_top_k)
    near = near.join(_numbers(numbered).select("id", "chunk_id"), "id").drop("id").withColumnRenamed("chunk_id", "id")
    found = bm25.resolve(bm25.top_k(lexical, asked.select("qid", "tokens"), params.candidate_top_k), numbered.withColumnRenamed("chunk_id", "id"))
    fused = fusion.normalised(fusion.rrf(near, found, params))
    ids = _numbers(numbered).select("id", F.col("chunk_id"), "vector")
    picked = mmr.select(fused.withColumnRenamed("id", "chunk_id").join(ids.select("chunk_id", "id"), "chunk_id").drop("chunk_id"), ids, params.top_k, params.mmr_lambda)
    cores = picked.join(ids.select("id", "chunk_id"), "id").select("qid", "chunk_id", F.col("mmr_rank").alias("core_rank"))
    shown = contexts(cores, points, params)
    ordered = F.array_sort(F.collect_list(F.struct("core_rank", "context")))
    return shown.groupBy("qid").agg(F.transform(ordered, lambda x: x["context"]).alias("contexts"))


def _numbers(points: DataFrame) -> DataFrame:
    """``points`` with a number in place of the text id, as the vector operators take numbers."""
    return points.withColumn("id", F.xxhash64("chunk_id"))


def contexts(cores: DataFrame, chunks: DataFrame, params: RetrievalParams) -> DataFrame:
    """Rendered context of each core (qid, chunk_id, core_rank)."""
    return context.render(context.select(cores, chunks, params.no_expand_tokens, params.context_tokens), chunks)


def trace(near: DataFrame, found: DataFrame, fused: DataFrame, cores: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Counts of candidates by stage for each query; ``shown``, the chunks of the contexts, counts as expanded."""
    count = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    out = count(fused, "fused")
    for df, name in ((near, "dense"), (found, "bm25"), (cores, "selected"), *([(shown, "expanded")] if shown is not None else [])):
        out = out.join(count(df, name), "qid", "left").fillna(0, [name])
    return out.withColumn("mmr_discarded", F.col("fused") - F.col("selected"))


def ranked(corpus: Corpus, queries: DataFrame, params: RetrievalParams, unlike: bool = False) -> DataFrame:
    """mode, case_id, id, rank of dense and lexical search alone and of both together (hybrid), up to ``top_k_max`` results."""
    near, found = candidates(corpus, queries, params)
    fused = fusion.normalised(fusion.rrf(near, found, params))
    cores = mmr.select(fused, corpus.points, params.top_k_max, params.mmr_lambda, unlike).withColumnRenamed("mmr_rank", "rank")
    modes = [df.select(F.lit(m).alias("mode"), F.col("qid").alias("case_id"), "id", "rank") for m, df in zip(MODES, (found, near, cores), strict=True)]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


MODES = ("bm25", "dense", "hybrid")


def cases(asked: DataFrame) -> DataFrame:
    """``asked`` (case_id, stress_type) once for each mode."""
    return asked.select(F.explode(F.array(*map(F.lit, MODES))).alias("mode"), "case_id", "stress_type")


def evaluate(corpus: Corpus, queries: DataFrame, relevant: DataFrame, params: RetrievalParams, unlike: bool = False) -> DataFrame:
    """HitRate and MRR of each mode, overall and by stress_type, cut at top_k_max.

    ``queries``: qid, stress_type, qvec, tokens; ``relevant``: qid, id.
    """
    asked = cases(queries.select(F.col("qid").alias("case_id"), "stress_type"))
    found = ranked(corpus, queries, params, unlike)
    ranks = evaluation.first_ranks(found, relevant.select(F.col("qid").alias("case_id"), "id"), asked, params.top_k_max)
    return evaluation.metrics(ranks, params.top_k_max)
