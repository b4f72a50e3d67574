"""BM25-Okapi over an inverted index in shards of documents.

A text is tokenised once, in the task that reads it. The task collects the postings of some documents, a shard, and
writes them by term, so building the index shuffles nothing but one count for each term and task. A search reads the
postings of its own terms (they are sorted by term, so Parquet skips the others), brings those of a shard together, and
scores a shard and a block of queries as one matrix, of which the k best rows of each query go on. So a term that
stands in all documents is spread over all shards, and scores that cannot be among the k best are never shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.config import DataError
from tessera.functions.text import search_tokens, tokenised
from tessera.operators.indexing import ensure_empty
from tessera.runtime import fresh_path, ship

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents and postings that a shard holds at most (one document may hold more), and queries scored together.
SHARD_DOCS, SHARD_POSTINGS, QUERIES = 8192, 4_000_000, 512
#: Query terms up to which they are broadcast after they are counted.
BROADCAST_TERMS = 1_000_000


@dataclass
class Bm25Index:
    """postings (shard, term, ids, tfs, lengths), shards (shard, n_docs, n_tokens), terms (term, df, idf)."""

    postings: DataFrame
    shards: DataFrame
    terms: DataFrame

    @property
    def stats(self) -> DataFrame:
        """n_docs, avgdl in one row; documents without tokens count."""
        n, total = F.coalesce(F.sum("n_docs"), F.lit(0)), F.sum("n_tokens").cast("double")
        return self.shards.agg(n.cast("long").alias("n_docs"), F.when(n > 0, total / n).alias("avgdl"))


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, tokens (an array) of each row."""
    return tokenised(docs.select(F.col(key).alias("id"), F.col(text).alias("tokens")), "tokens")


def ensure_ids(docs: DataFrame, key: str) -> None:
    """Refuse null, blank and repeated ids."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    ensure_empty(docs.filter(blank).select(key), "documents without an id")
    ensure_empty(docs.groupBy(key).count().filter("count > 1"), "repeated document ids")


def _inverted(docs: DataFrame, made) -> DataFrame:
    """Postings of the rows (id, text or tokens) by shard and term; a row without a term holds what a shard is in all."""
    ship(docs.sparkSession)
    kind = docs.schema["id"].dataType
    schema = T.StructType().add("shard", "long").add("term", "string").add("ids", T.ArrayType(kind)).add("tfs", T.ArrayType(T.IntegerType())).add("lengths", T.ArrayType(T.LongType()))
    types = [pa.int64(), pa.string(), pa.list_(to_arrow_type(kind)), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, size, total = TaskContext.get().partitionId() << 32, 0, 0, 0
        held: dict[str, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))

        def out() -> Iterator[pa.RecordBatch]:
            terms = sorted(held)
            columns = [[shard] * (len(terms) + 1), [None, *terms], *([first, *(held[t][i] for t in terms)] for i, first in enumerate(([], [], [n, total])))]
            table = pa.table([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=schema.names)
            yield from table.to_batches(max_chunksize=50_000)

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = made(value)
                for term, tf in Counter(found).items():
                    ids, tfs, lengths = held[term]
                    ids.append(i)
                    tfs.append(tf)
                    lengths.append(len(found))
                    size += 1
                n, total = n + 1, total + len(found)
                if n >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield from out()
                    held.clear()
                    shard, n, size, total = shard + 1, 0, 0, 0
        if n:
            yield from out()

    return docs.mapInArrow(run, schema)


def build(docs: DataFrame, path: str | None = None, key: str = "id", text: str | None = None) -> Bm25Index:
    """The index of ``docs`` with ``key`` and either ``text`` or an array column ``tokens``, stored at ``path``."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "bm25")
    rows = docs.select(F.col(key).alias("id"), F.col(text or "tokens"))
    _inverted(rows, search_tokens if text else lambda found: found or []).write.mode("overwrite").parquet(f"{path}/postings")
    index = load(spark, path, terms=False)
    n_docs = F.broadcast(index.stats.select("n_docs"))
    df = index.postings.groupBy("term").agg(F.sum(F.size("ids")).cast("long").alias("df"))
    raw = F.log(F.col("n_docs").cast("double") - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
    df.crossJoin(n_docs).select("term", "df", raw.alias("raw")).write.mode("overwrite").parquet(f"{path}/terms")
    return load(spark, path)


def load(spark: SparkSession, path: str, terms: bool = True) -> Bm25Index:
    """A stored index. The mean idf, which replaces negative ones in part, is a table of one row."""
    all_ = spark.read.parquet(f"{path}/postings")
    shards = all_.filter("term IS NULL").select("shard", F.col("lengths")[0].alias("n_docs"), F.col("lengths")[1].alias("n_tokens"))
    index = Bm25Index(all_.filter("term IS NOT NULL"), shards, spark.createDataFrame([], "term string, df long, idf double"))
    if terms:
        found = spark.read.parquet(f"{path}/terms")
        mean = found.agg(F.coalesce(F.avg("raw"), F.lit(0.0)).alias("mean"))
        idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
        index.terms = found.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))
    return index


def _scored(k: int, places: int):
    """The k best documents of a shard for each query of a block, as one matrix of queries and documents."""

    def run(rows: pa.Table) -> pa.Table:
        ids: dict = {}
        at, part, who, value = [], [], [], []
        avgdl = rows["avgdl"][0].as_py()
        for r in range(rows.num_rows):
            own = rows["ids"][r].as_py()
            place = np.array([ids.setdefault(i, len(ids)) for i in own], np.int64)
            tf, size = (rows[c][r].values.to_numpy().astype(float) for c in ("tfs", "lengths"))
            each = tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * size / avgdl))
            at.append(place)
            part.append(each)
            who.append(rows["qids"][r].values.to_numpy())
            value.append(rows["weights"][r].values.to_numpy())
        asked, inverse = np.unique(np.concatenate(who), return_inverse=True)
        total = np.zeros((len(asked), len(ids)))
        first = 0
        for place, each, w in zip(at, part, value, strict=True):
            q = inverse[first : first + len(w)]
            first += len(w)
            np.add.at(total, (q[:, None], place[None]), w[:, None] * each[None])  # repeated ids add up
        total = np.round(total, places)
        names = np.array(list(ids), object)
        out_q, out_i, out_s = [], [], []
        for q, row in zip(asked.tolist(), total, strict=True):
            good = np.flatnonzero(row > 0)
            if len(good) > k:
                edge = np.partition(row[good], len(good) - k)[len(good) - k]
                good = good[row[good] >= edge]  # ties at the edge stay; ids decide among all shards
            if len(good) > k:
                good = np.array(sorted(good, key=lambda x: (-row[x], names[x]))[:k])
            out_q += [q] * len(good)
            out_i += [names[g] for g in good]
            out_s += row[good].tolist()
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_i, rows.schema.field("ids").type.value_type), pa.array(out_s, pa.float64())], names=["qid", "id", "score"])

    return run


def top_k(index: Bm25Index, queries: DataFrame, k: int, places: int = 9) -> DataFrame:
    """qid, id, score, rank: the k best documents with a positive score of each query (qid, tokens).

    Repeated query terms count again; ties go to the smaller id. ``queries`` is a stated set, whatever its size: its terms
    are broadcast behind a count, and beyond it shuffled.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    ship(spark)
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    weights = asked.join(index.terms, "term").select("term", "qid", (F.col("times") * F.col("idf")).alias("weight"))
    block = F.pmod(F.xxhash64("qid"), F.greatest(F.ceil(F.lit(queries.count()) / QUERIES), F.lit(1))).alias("block")
    by_term = weights.groupBy("term", block).agg(F.collect_list(F.struct("qid", "weight")).alias("asked"))
    by_term = by_term.select("term", "block", F.col("asked.qid").alias("qids"), F.col("asked.weight").alias("weights"))
    n_terms = by_term.count()
    side = F.broadcast(by_term) if n_terms <= BROADCAST_TERMS else by_term
    hits = index.postings.join(side, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    kind = index.postings.schema["ids"].dataType.elementType
    schema = T.StructType().add("qid", "long").add("id", kind).add("score", "double")
    best = hits.select("shard", "block", "ids", "tfs", "lengths", "qids", "weights", "avgdl").groupBy("shard", "block").applyInArrow(_scored(k, places), schema)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def resolve(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """``found``, if every id that it names is among ``known``; else an error, as the index and the points differ then."""
    missing = found.select(key).distinct().join(known.select(key), key, "left_anti").take(3)
    if missing:
        raise DataError(f"found ids without a point: {[r[0] for r in missing]}")
    return found
