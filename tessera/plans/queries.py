"""The registered queries over the tables of a folder, each with the same rows in DuckDB SQL where it can be."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import IndexContract, RetrievalParams, as_dict
from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.functions.ids import sha256, stable_id
from tessera.operators import accounts, bm25, context, dense, evaluation, fusion, history, indexing, markdown, mmr
from tessera.plans import relevance, search
from tessera.runtime import fresh_path, modified, spread
from tessera.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CONTRACT, PARAMS = IndexContract(), RetrievalParams()
BALANCED = RetrievalParams(rank_constant=60, bm25_weight=1.0)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- inputs ---------------------------------------------------------------------------------------


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document for each row of documents: its source, its id and language, its text."""
    d = read(spark, sf_dir, "documents")
    head = F.concat(F.lit("# "), "source", F.lit("\n\n## doc "), F.col("doc_id").cast("string"), F.lit(" ("), "lang", F.lit(")\n\n"))
    return d.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text")
    )


COMPOSED_SQL = """
md AS (
  SELECT source || '/' || doc_id || '.md' AS path,
         '# ' || source || chr(10) || chr(10) || '## doc ' || doc_id || ' (' || lang || ')' || chr(10) || chr(10) || coalesce(text, '') AS text
  FROM documents),
raw AS (SELECT path, string_split(text, chr(10)) AS parts FROM md),
numbered AS (SELECT path, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line, len(parts) AS n FROM raw),
lines AS (
  SELECT path, line, text,
         CASE WHEN regexp_matches(text, '^ {0,3}#{1,6}[ \\t]+.+') THEN 'heading'
              WHEN regexp_matches(text, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]*$') THEN 'blank' ELSE 'text' END AS role
  FROM numbered WHERE NOT (line = n AND text = ''))"""


def stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents as chunks: twenty in a document, sections by language, parents by source."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.floor(F.col("doc_id") / 20).cast("string").alias("document_id"),
        F.col("lang").alias("section_id"),
        F.col("source").alias("parent_section_id"),
        (F.col("doc_id") % 20).cast("int").alias("chunk_order"),
        (100 + F.col("n_chars") % 900).cast("int").alias("token_count"),
        F.array(F.struct(F.lit(1).alias("level"), F.col("source").alias("text"), F.lit(1).alias("line"))).alias("heading_path"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(3).alias("line_start"),
        F.lit(9).alias("line_end"),
    )


CHUNKS_SQL = """
chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id // 20 AS VARCHAR) AS document_id, lang AS section_id, source AS parent_section_id,
         CAST(doc_id % 20 AS INTEGER) AS chunk_order, CAST(100 + n_chars % 900 AS INTEGER) AS token_count, coalesce(text, '') AS text
  FROM documents)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), role.alias("role"), F.coalesce("text", F.lit("")).alias("content")
    )


MESSAGES_SQL = """
messages AS (
  SELECT conv_id AS conversation_id, turn AS id, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS role,
         coalesce(text, '') AS content
  FROM conversations)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("id"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("mobile"), F.col("c_name").alias("nickname"),
        (F.col("c_nationkey") % 3).cast("int").alias("sex"), F.col("c_acctbal").alias("balance"),
    )


USERS_SQL = """
users AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, 'm' || c_custkey AS mobile, c_name AS nickname, CAST(c_nationkey % 3 AS INTEGER) AS sex, c_acctbal AS balance
  FROM customer)"""

# --- tokens and BM25 ------------------------------------------------------------------------------

_IDENTIFIERS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*')"
_SEGMENTS = f"flatten(list_transform({_IDENTIFIERS}, lambda x: list_filter(regexp_split_to_array(x, '[._/-]+'), lambda y: y <> '')))"
_HUMPS = (
    "flatten(list_transform({0}, lambda s: list_filter(string_split(regexp_replace(regexp_replace(s, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'),"
    " '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda y: y <> '')))"
)
TOKENS_SQL = (
    "list_concat(list_concat(list_concat(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x)),"
    f" list_transform({_IDENTIFIERS}, lambda x: lower(x))), list_transform({_SEGMENTS}, lambda x: lower(x))), list_transform({_HUMPS.format(_SEGMENTS)}, lambda x: lower(x)))"
)


@query(
    "tokenize_identifiers",
    f"""
WITH d AS (SELECT doc_id, {_IDENTIFIERS} AS ids, {_SEGMENTS} AS parts FROM documents)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_identifiers, CAST(len(parts) AS INTEGER) AS n_parts,
       sha256(array_to_string(ids, chr(10))) AS identifiers_sha256, sha256(array_to_string(parts, chr(10))) AS parts_sha256
FROM d""",
)
def tokenize_identifiers(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", tx.identifiers(F.coalesce("text", F.lit(""))).alias("ids"))
    parts = d.withColumn("parts", F.flatten(F.transform("ids", tx.identifier_parts)))
    return parts.select(
        "doc_id", F.size("ids").alias("n_identifiers"), F.size("parts").alias("n_parts"),
        sha256(F.array_join("ids", "\n")).alias("identifiers_sha256"), sha256(F.array_join("parts", "\n")).alias("parts_sha256"),
    )


@query(
    "camel_split",
    f"""
WITH d AS (SELECT doc_id, {_HUMPS.format(_SEGMENTS)} AS humps FROM documents)
SELECT doc_id, CAST(len(humps) AS INTEGER) AS n_humps, sha256(array_to_string(humps, chr(10))) AS humps_sha256 FROM d""",
)
def camel_split(spark, sf_dir):
    segments = F.flatten(F.transform(tx.identifiers(F.coalesce("text", F.lit(""))), tx.identifier_parts))
    d = read(spark, sf_dir, "documents").select("doc_id", F.flatten(F.transform(segments, tx.camel_parts)).alias("humps"))
    return d.select("doc_id", F.size("humps").alias("n_humps"), sha256(F.array_join("humps", "\n")).alias("humps_sha256"))


@query(
    "cjk_tokens",
    """
WITH d AS (SELECT doc_id, '标题路径：' || coalesce(source, '') || '你好世界' AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{Han}+')) AS run FROM d),
g AS (SELECT doc_id, substr(run, CAST(i AS BIGINT), 2) AS term FROM w, range(1, 20) r(i) WHERE i < length(run))
SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL""",
)
def cjk_tokens(spark, sf_dir):
    """Pairs of Chinese characters behind a source's name in compatibility form: NFKC gives ASCII, which is left out here."""
    wide = F.translate(F.coalesce("source", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("标题路径："), wide, F.lit("你好世界")).alias("tokens"))
    terms = tx.tokenised(d, "tokens").select("doc_id", F.explode("tokens").alias("term"))
    return terms.filter(~F.col("term").rlike("[\\x00-\\x7F]")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


BM25_SQL = f"""
tok AS (SELECT doc_id AS id, {TOKENS_SQL} AS tokens FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(CAST(len(tokens) AS DOUBLE)) AS avgdl FROM tok),
terms0 AS (SELECT id, CAST(len(tokens) AS DOUBLE) AS length, unnest(tokens) AS term FROM tok),
postings AS (SELECT id, length, term, CAST(count(*) AS DOUBLE) AS tf FROM terms0 GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raws AS (SELECT term, df, ln(CAST(n_docs AS DOUBLE) - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS raw FROM dfs, stats),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


#: Paths of the indexes that this session has stored, by the state of the files that they were made of.
_stored: dict[tuple, str] = {}


def lexical(spark: SparkSession, sf_dir: str) -> bm25.Bm25Index:
    """The index of all documents; it is stored once, and later queries load it as long as the table stays the same."""
    state = spark.sparkContext.applicationId, modified(spark, f"{sf_dir}/documents.parquet")
    if state not in _stored:
        path = fresh_path(spark, "bm25")
        bm25.build(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), path, "doc_id", "text")
        _stored[state] = path
    return bm25.load(spark, _stored[state])


@query("bm25_stats", f"WITH {BM25_SQL} SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats")
def bm25_stats(spark, sf_dir):
    return lexical(spark, sf_dir).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_idf", f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_idf(spark, sf_dir):
    return lexical(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


QUERIES_SQL = f"""
asked AS (
  SELECT b.item_id AS qid, {TOKENS_SQL} AS tokens, CAST(e.embedding AS DOUBLE[]) AS qvec
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
wanted AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS times FROM (SELECT qid, unnest(tokens) AS term FROM asked) GROUP BY ALL),
scored AS (
  SELECT w.qid, p.id,
         round(sum(times * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / avgdl))), 9) AS score
  FROM wanted w JOIN terms USING (term) JOIN postings p USING (term), stats GROUP BY w.qid, p.id),
lexical AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE score > 0)
  WHERE rank <= 15)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries, with the vector of the same number."""
    b = tx.tokenised(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("tokens")), "tokens")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return b.join(e, "qid", "left")


@query("bm25_topk", f"WITH {BM25_SQL}, {QUERIES_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM lexical")
def bm25_topk(spark, sf_dir):
    found = bm25.top_k(lexical(spark, sf_dir), asked(spark, sf_dir).select("qid", "tokens"), PARAMS.candidate_top_k)
    return found.withColumn("score", F.round("score", 6))


# --- dense, fusion, diversity ---------------------------------------------------------------------

DENSE_SQL = """
near0 AS (
  SELECT a.qid, p.vec_id AS id,
         round(CASE WHEN list_inner_product(a.qvec, a.qvec) = 0 OR list_inner_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) = 0 THEN 0.0
               ELSE list_cosine_similarity(a.qvec, CAST(p.embedding AS DOUBLE[])) END, 9) AS score
  FROM asked a, embeddings p WHERE a.qvec IS NOT NULL),
dense AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM near0) WHERE rank <= 15)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("dense_topk", f"WITH {BM25_SQL}, {QUERIES_SQL}, {DENSE_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark, sf_dir):
    found = dense.top_k(points(spark, sf_dir), asked(spark, sf_dir).select("qid", "qvec"), PARAMS.candidate_top_k)
    return found.withColumn("score", F.round("score", 6))


@query(
    "cosine_pairs",
    """
WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_inner_product(a.v, b.v), 6) AS dot
FROM p a JOIN p b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark, sf_dir):
    a = points(spark, sf_dir)
    b = a.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    u, v = F.col("vector"), F.col("other")
    return a.join(b, "id").select(F.col("id").alias("vec_id"), F.round(vx.cosine(u, v), 6).alias("cosine"), F.round(vx.dot(u, v), 6).alias("dot"))


def rrf_sql(p: RetrievalParams) -> str:
    part = lambda w, c: f"coalesce(CAST({w} AS DOUBLE) / (CAST({p.rank_constant} AS DOUBLE) + {c}), CAST(0 AS DOUBLE))"
    return f"""
fused AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, least(dense_rank, bm25_rank), dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, id)
            AS INTEGER) AS rrf_rank
  FROM (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.id, l.id) AS id, d.rank AS dense_rank, l.rank AS bm25_rank,
               round({part(p.dense_weight, "d.rank")} + {part(p.bm25_weight, "l.rank")}, 12) AS rrf_score
        FROM dense d FULL JOIN lexical l ON d.qid = l.qid AND d.id = l.id)),
bounds AS (SELECT *, min(rrf_score) OVER (PARTITION BY qid) AS low, max(rrf_score) OVER (PARTITION BY qid) AS high FROM fused),
relevant AS (
  SELECT *, CASE WHEN abs(low - high) <= 1e-9 * greatest(abs(low), abs(high)) THEN 1.0 ELSE (rrf_score - low) / (high - low) END AS relevance FROM bounds)"""


def searchable(spark: SparkSession, sf_dir: str) -> search.Corpus:
    """All documents and all points. Few documents have a vector; in MMR those without one are like no other."""
    return search.Corpus(points(spark, sf_dir), lexical(spark, sf_dir))


FUSED_SQL = f"WITH RECURSIVE {BM25_SQL}, {QUERIES_SQL}, {DENSE_SQL}, {rrf_sql(PARAMS)}"
BALANCED_SQL = f"WITH RECURSIVE {BM25_SQL}, {QUERIES_SQL}, {DENSE_SQL}, {rrf_sql(BALANCED)}"


def fused(spark: SparkSession, sf_dir: str, params: RetrievalParams) -> DataFrame:
    near, found = search.candidates(searchable(spark, sf_dir), asked(spark, sf_dir), params)
    return fusion.rrf(near, found, params)


_RRF_COLUMNS = "qid, id, dense_rank, bm25_rank, round(rrf_score, 9) AS rrf_score, rrf_rank"


@query("rrf_fusion", f"{FUSED_SQL} SELECT {_RRF_COLUMNS} FROM fused")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir, PARAMS).withColumn("rrf_score", F.round("rrf_score", 9))


@query("rrf_balanced", f"{BALANCED_SQL} SELECT {_RRF_COLUMNS} FROM fused")
def rrf_balanced(spark, sf_dir):
    return fused(spark, sf_dir, BALANCED).withColumn("rrf_score", F.round("rrf_score", 9))


@query("rrf_normalized", f"{FUSED_SQL} SELECT qid, id, rrf_rank, round(relevance, 6) AS relevance FROM relevant")
def rrf_normalized(spark, sf_dir):
    out = fusion.normalised(fused(spark, sf_dir, PARAMS))
    return out.select("qid", "id", "rrf_rank", F.round("relevance", 6).alias("relevance"))


def mmr_sql(k: int, weight: float) -> str:
    """The picks one after the other, each from what the earlier ones left; a candidate without a vector is like no other."""
    w = f"CAST({weight} AS DOUBLE)"
    alike = "coalesce(list_max(list_transform(p.vecs, lambda v: coalesce(list_cosine_similarity(c.vec, v), 0.0))), 0.0)"
    return f"""
cand AS (SELECT r.qid, r.id, r.rrf_score, r.rrf_rank, r.relevance, CAST(e.embedding AS DOUBLE[]) AS vec FROM relevant r LEFT JOIN embeddings e ON e.vec_id = r.id),
picks AS (
  SELECT DISTINCT qid, 0 AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS vecs, CAST(NULL AS BIGINT) AS id,
         CAST(NULL AS DOUBLE) AS rrf_score, CAST(NULL AS DOUBLE) AS mmr_score FROM cand
  UNION ALL
  SELECT qid, n + 1, list_append(ids, id), list_append(vecs, vec), id, rrf_score, mmr_score
  FROM (SELECT p.qid, p.n, p.ids, p.vecs, c.id, c.vec, c.rrf_score, c.rrf_rank, round({w} * c.relevance - (CAST(1 AS DOUBLE) - {w}) * {alike}, 9) AS mmr_score
        FROM picks p JOIN cand c ON c.qid = p.qid AND NOT list_contains(p.ids, c.id) WHERE p.n < {k})
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY mmr_score DESC, rrf_rank) = 1),
cores AS (SELECT qid, id, rrf_score, mmr_score, n AS mmr_rank FROM picks WHERE n > 0)"""


@query(
    "mmr_select",
    f"{BALANCED_SQL}, {mmr_sql(3, 0.7)} SELECT qid, id, round(rrf_score, 9) AS score, round(mmr_score, 6) AS mmr_score, CAST(mmr_rank AS INTEGER) AS mmr_rank FROM cores",
)
def mmr_select(spark, sf_dir):
    found = mmr.select(fusion.normalised(fused(spark, sf_dir, BALANCED)), points(spark, sf_dir), 3, 0.7, unlike=True)
    return found.withColumn("score", F.round("score", 9)).withColumn("mmr_score", F.round("mmr_score", 6))


@query(
    "search_trace",
    f"""{FUSED_SQL}
SELECT qid, count(*) AS fused, count(dense_rank) AS dense, count(bm25_rank) AS bm25, least(count(*), 3) AS selected, count(*) - least(count(*), 3) AS mmr_discarded
FROM fused GROUP BY qid""",
)
def search_trace(spark, sf_dir):
    corpus, q = searchable(spark, sf_dir), asked(spark, sf_dir)
    near, found = search.candidates(corpus, q, PARAMS)
    both = fusion.rrf(near, found, PARAMS)
    return search.trace(near, found, both, mmr.select(fusion.normalised(both), corpus.points, PARAMS.top_k, PARAMS.mmr_lambda, unlike=True))


# --- evaluation -----------------------------------------------------------------------------------

RELEVANT_SQL = """
qrels AS (SELECT b.item_id AS case_id, d.doc_id AS id, d.lang FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
groups AS (SELECT b.item_id AS case_id, coalesce(min_by(q.lang, q.id), 'unspecified') AS stress_type FROM benchmark b LEFT JOIN qrels q ON q.case_id = b.item_id GROUP BY 1),
found AS (
  SELECT 'bm25' AS mode, qid, id, rank FROM lexical
  UNION ALL SELECT 'dense', qid, id, rank FROM dense
  UNION ALL SELECT 'hybrid', qid, id, mmr_rank FROM cores),
hits AS (SELECT f.mode, f.qid, min(f.rank) AS rank FROM found f JOIN qrels q ON q.case_id = f.qid AND q.id = f.id WHERE f.rank <= 10 GROUP BY ALL),
ranks AS (
  SELECT m.mode, g.case_id, g.stress_type, CAST(h.rank AS INTEGER) AS rank
  FROM groups g CROSS JOIN (VALUES ('bm25'), ('dense'), ('hybrid')) m(mode) LEFT JOIN hits h ON h.mode = m.mode AND h.qid = g.case_id)"""
EVALUATED_SQL = f"{FUSED_SQL}, {mmr_sql(PARAMS.top_k_max, PARAMS.mmr_lambda)}, {RELEVANT_SQL}"


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    qrels = relevance.containing(d, b).select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("id"))
    first = qrels.join(d.select(F.col("doc_id").alias("id"), "lang"), "id").groupBy("case_id").agg(F.min_by("lang", "id").alias("lang"))
    groups = b.select(F.col("item_id").alias("case_id")).join(first, "case_id", "left").select("case_id", F.coalesce("lang", F.lit("unspecified")).alias("stress_type"))
    found = search.ranked(searchable(spark, sf_dir), asked(spark, sf_dir), PARAMS, unlike=True)
    return evaluation.first_ranks(found, qrels, search.cases(groups), PARAMS.top_k_max)


@query("eval_first_rank", f"{EVALUATED_SQL} SELECT mode, case_id, stress_type, rank FROM ranks")
def eval_first_rank(spark, sf_dir):
    return ranks(spark, sf_dir).select("mode", "case_id", "stress_type", "rank")


@query(
    "eval_metrics_rollup",
    f"""{EVALUATED_SQL}
SELECT mode, stress_type, count(*) AS case_count,
       {", ".join(f"round(avg(CASE WHEN rank <= {c} THEN 1.0 ELSE 0.0 END), 4) AS hit_rate_{c}" for c in evaluation.CUTOFFS)},
       round(avg(CASE WHEN rank <= 10 THEN CAST(1 AS DOUBLE) / rank ELSE 0.0 END), 4) AS mrr
FROM ranks GROUP BY GROUPING SETS ((mode), (mode, stress_type))""",
)
def eval_metrics_rollup(spark, sf_dir):
    return evaluation.metrics(ranks(spark, sf_dir), PARAMS.top_k_max)


@query(
    "containment",
    "SELECT d.doc_id, b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
def containment(spark, sf_dir):
    return relevance.containing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# --- Markdown -------------------------------------------------------------------------------------


@query("line_roles", f"WITH {COMPOSED_SQL} SELECT path, role, count(*) AS n, CAST(min(line) AS INTEGER) AS first_line FROM lines GROUP BY ALL")
def line_roles(spark, sf_dir):
    return markdown.line_roles(composed(spark, sf_dir)).groupBy("path", "role").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


@query(
    "heading_lines",
    f"""WITH {COMPOSED_SQL}
SELECT path, line, CAST(length(regexp_extract(text, '^ {{0,3}}(#{{1,6}})[ \\t]+', 1)) AS INTEGER) AS level,
       trim(regexp_extract(text, '^ {{0,3}}#{{1,6}}[ \\t]+(.+?)(?:[ \\t]+#+[ \\t]*)?$', 1)) AS title
FROM lines WHERE role = 'heading'""",
)
def heading_lines(spark, sf_dir):
    return markdown.headings(markdown.line_roles(composed(spark, sf_dir)))


_BLOCKS_SQL = f"""{COMPOSED_SQL},
marked AS (
  SELECT *, sum(CASE WHEN role <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS run,
         sum(CASE WHEN role = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS section
  FROM lines),
blocks AS (
  SELECT path, section, run, min(line) AS line_start, max(line) AS line_end, min_by(text, line) AS first, list(text ORDER BY line)[2] AS second
  FROM marked WHERE role = 'text' GROUP BY ALL)"""


@query(
    "block_kinds",
    f"""WITH {_BLOCKS_SQL}
SELECT path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end,
       CASE WHEN starts_with(ltrim(first), '>') THEN 'quote'
            WHEN regexp_matches(first, '^\\s*(?:[-+*]|[0-9]+[.)])\\s+') THEN 'list'
            WHEN second IS NOT NULL AND contains(first, '|') AND regexp_matches(second, '^\\s*\\|?\\s*:?-{{3,}}') THEN 'table'
            ELSE 'prose' END AS kind
FROM blocks""",
)
def block_kinds(spark, sf_dir):
    return markdown.blocks(composed(spark, sf_dir)).select("path", "line_start", "line_end", "kind")


@query("section_count", f"WITH {_BLOCKS_SQL} SELECT path, CAST(count(DISTINCT section) AS BIGINT) AS n_sections, count(*) AS n_blocks FROM blocks GROUP BY path")
def section_count(spark, sf_dir):
    return markdown.blocks(composed(spark, sf_dir)).groupBy("path").agg(F.count_distinct("section").alias("n_sections"), F.count(F.lit(1)).alias("n_blocks"))


#: A document with every kind of line; {0} and {1} are its number and language. Lines, roles and blocks below are read off it by hand.
SAMPLE = """preamble {0}

[TOC]

# Top {0} #
> quoted {1}
> more

### Deep
- one
* two
1) three

| a | b |
|---|:-:|
| 1 | {0} |

```sh
# no heading

still code
```
tail {1}
## Side
~~~
open {0}
"""
#: First and last line, kind, headings and text of the blocks of ``SAMPLE``.
SAMPLE_BLOCKS = (
    (1, 1, "prose", "", "preamble {0}"),
    (6, 7, "quote", "Top {0}", "> quoted {1}\n> more"),
    (10, 12, "list", "Top {0} > Deep", "- one\n* two\n1) three"),
    (14, 16, "table", "Top {0} > Deep", "| a | b |\n|---|:-:|\n| 1 | {0} |"),
    (18, 22, "code", "Top {0} > Deep", "```sh\n# no heading\n\nstill code\n```"),
    (23, 23, "prose", "Top {0} > Deep", "tail {1}"),
    (25, 26, "code", "Top {0} > Side", "~~~\nopen {0}"),
)
#: The same packed with 20 and 60 characters as limits: order, lines, code, headings and text.
SAMPLE_CHUNKS = (
    (0, 1, 1, False, "", "preamble {0}"),
    (1, 6, 7, False, "Top {0}", "> quoted {1}\n> more"),
    (2, 10, 12, False, "Top {0} > Deep", "- one\n* two\n1) three"),
    (3, 14, 16, False, "Top {0} > Deep", "| a | b |\n|---|:-:|\n| 1 | {0} |"),
    (4, 18, 22, True, "Top {0} > Deep", "```sh\n# no heading\n\nstill code\n```"),
    (5, 23, 23, False, "Top {0} > Deep", "tail {1}"),
    (6, 25, 26, True, "Top {0} > Side", "~~~\nopen {0}"),
)


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SAMPLE`` for each row of documents, with its number and language."""
    d = read(spark, sf_dir, "documents")
    text = F.replace(F.replace(F.lit(SAMPLE), F.lit("{0}"), F.col("doc_id").cast("string")), F.lit("{1}"), F.coalesce("lang", F.lit("")))
    return d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


def _filled_sql(column: str) -> str:
    return f"replace(replace({column}, '{{0}}', CAST(doc_id AS VARCHAR)), '{{1}}', coalesce(lang, ''))"


def _values(rows: tuple) -> str:
    told = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(told, r)) + ")" for r in rows)


def _titles(c: str = "heading_path"):
    return F.array_join(F.transform(c, lambda h: h["text"]), " > ")


@query(
    "markdown_blocks",
    f"""
SELECT doc_id || '.md' AS path, line_start, line_end, kind, {_filled_sql("titles")} AS titles, {_filled_sql("b.text")} AS text
FROM documents, (VALUES {_values(SAMPLE_BLOCKS)}) b(line_start, line_end, kind, titles, text)""",
)
def markdown_blocks(spark, sf_dir):
    return markdown.blocks(sampled(spark, sf_dir)).select("path", "line_start", "line_end", "kind", _titles().alias("titles"), "text")


@query(
    "markdown_chunks",
    f"""
SELECT doc_id || '.md' AS path, chunk_order, line_start, line_end, has_code, {_filled_sql("titles")} AS titles, {_filled_sql("b.text")} AS text,
       CAST(length({_filled_sql("CASE WHEN titles = '' THEN '' ELSE '标题路径：' || titles || chr(10) || chr(10) END || '正文：' || chr(10) || b.text")}) AS INTEGER) AS token_count
FROM documents, (VALUES {_values(SAMPLE_CHUNKS)}) b(chunk_order, line_start, line_end, has_code, titles, text)""",
)
def markdown_chunks(spark, sf_dir):
    found = markdown.chunks(sampled(spark, sf_dir), IndexContract(soft_limit_tokens=30, hard_limit_tokens=80))
    return found.select("path", "chunk_order", "line_start", "line_end", "has_code", _titles().alias("titles"), "text", "token_count")


@query("chunk_pack")
def chunk_pack(spark, sf_dir):
    return markdown.chunks(composed(spark, sf_dir), CONTRACT).select("path", *markdown.PUBLIC)


# --- identifiers and checks -----------------------------------------------------------------------


@query(
    "chunk_ids",
    """
WITH d AS (
  SELECT doc_id, sha256(concat_ws(chr(31), 'document', source || '/' || doc_id || '.md')) AS document_id, sha256(coalesce(text, '')) AS content_hash
  FROM documents),
s AS (SELECT *, sha256(concat_ws(chr(31), 'section', document_id, 'root')) AS section_id FROM d),
c AS (SELECT *, sha256(concat_ws(chr(31), 'chunk', document_id, section_id, '0', content_hash)) AS chunk_id FROM s),
u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('tessera:chunks:' || chunk_id)) AS h FROM c)
SELECT doc_id, document_id, section_id, content_hash, chunk_id,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1)
       || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM u""",
)
def chunk_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    none = F.array().cast(markdown.HEADINGS)
    pieces = d.select("doc_id", path.alias("path"), none.alias("heading_path"), F.lit(0).alias("section"), F.lit(0).alias("chunk_order"), F.coalesce("text", F.lit("")).alias("text"))
    return indexing.records(markdown.identified(pieces)).select("doc_id", "document_id", "section_id", "content_hash", "chunk_id", "point_id")


_TOLD = json.dumps(as_dict(CONTRACT), sort_keys=True, ensure_ascii=False).replace("'", "''")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = stand_ins(spark, sf_dir).withColumn("path", F.col("document_id")).withColumn("embedding_text", F.col("text"))
    return indexing.records(named)


@query(
    "index_version",
    f"""WITH {CHUNKS_SQL},
h AS (SELECT sha256(concat_ws(chr(31), document_id, chunk_id, sha256(text))) AS h FROM chunks),
l AS (SELECT count(*) AS n_records, {", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT)), 0) AS VARCHAR) AS lane{i}" for i in range(4))} FROM h)
SELECT sha256(concat_ws(chr(31), '{_TOLD}', CAST(n_records AS VARCHAR), lane0, lane1, lane2, lane3)) AS index_version, n_records FROM l""",
)
def index_version(spark, sf_dir):
    return indexing.index_version(records(spark, sf_dir), CONTRACT)


@query(
    "neighbors_document",
    f"""WITH {CHUNKS_SQL}
SELECT a.chunk_id, b.chunk_id AS before_id, c.chunk_id AS after_id
FROM chunks a LEFT JOIN chunks b ON b.document_id = a.document_id AND b.chunk_order = a.chunk_order - 1
     LEFT JOIN chunks c ON c.document_id = a.document_id AND c.chunk_order = a.chunk_order + 1""",
)
def neighbors_document(spark, sf_dir):
    near = context.neighbours(stand_ins(spark, sf_dir))
    return near.select("chunk_id", F.col("before.chunk_id").alias("before_id"), F.col("after.chunk_id").alias("after_id"))


@query(
    "neighbors_section",
    f"""WITH {CHUNKS_SQL}
SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id
FROM chunks WINDOW w AS (PARTITION BY document_id, section_id ORDER BY chunk_order)""",
)
def neighbors_section(spark, sf_dir):
    return markdown.linked(stand_ins(spark, sf_dir)).select("chunk_id", "previous_chunk_id", "next_chunk_id")


@query(
    "order_continuity",
    f"""WITH {CHUNKS_SQL},
more AS (SELECT * FROM chunks UNION ALL SELECT * FROM chunks WHERE section_id = 'fr' AND chunk_order = 7)
SELECT document_id, count(*) AS n, count(DISTINCT chunk_order) AS distinct_orders, min(chunk_order) AS first, max(chunk_order) AS last
FROM more GROUP BY document_id
HAVING count(*) <> count(DISTINCT chunk_order) OR min(chunk_order) <> 0 OR max(chunk_order) <> count(*) - 1""",
)
def order_continuity(spark, sf_dir):
    """All chunks, and some of them once more, which breaks the order of their documents."""
    chunks = stand_ins(spark, sf_dir)
    return indexing.order_violations(chunks.unionByName(chunks.filter("section_id = 'fr' AND chunk_order = 7")))


@query(
    "id_set_equality",
    """
SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id AS doc_id, 'right' AS side FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
)
def id_set_equality(spark, sf_dir):
    right = points(spark, sf_dir).select(F.col("id").alias("doc_id"))
    return indexing.set_difference(read(spark, sf_dir, "documents"), right, "doc_id")


@query(
    "payload_validation",
    f"""WITH {CHUNKS_SQL},
p AS (SELECT c.*, e.embedding AS vector FROM chunks c LEFT JOIN embeddings e ON c.chunk_id = CAST(e.vec_id AS VARCHAR))
SELECT * FROM (SELECT chunk_id, CASE WHEN text = '' THEN 'no text' WHEN vector IS NULL OR len(vector) <> 64 THEN 'wrong dimensions' END AS reason FROM p) WHERE reason IS NOT NULL""",
)
def payload_validation(spark, sf_dir):
    vectors = points(spark, sf_dir).select(F.col("id").cast("string").alias("chunk_id"), "vector")
    return indexing.payload_violations(stand_ins(spark, sf_dir).join(vectors, "chunk_id", "left"), CONTRACT.embedding_dimensions)


@query("duplicate_ids", "SELECT 'chunk_id' AS kind, text AS id, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    named = d.select(
        F.col("text").alias("chunk_id"), F.col("doc_id").cast("string").alias("point_id"), F.col("source").alias("source_path"),
        F.col("lang").alias("content_hash"), F.lit(0).alias("chunk_order"),
    )
    return indexing.duplicate_ids(named)


# --- context --------------------------------------------------------------------------------------

CORES = (3, 4, 11)


def cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hits in every document of the stand-ins, two of them next to each other."""
    c = stand_ins(spark, sf_dir).filter(F.col("chunk_order").isin(*CORES))
    rank = F.when(F.col("chunk_order") == CORES[0], 1).when(F.col("chunk_order") == CORES[1], 2).otherwise(3)
    return c.select(F.col("document_id").cast("long").alias("qid"), "chunk_id", rank.alias("core_rank"))


CANDIDATES_SQL = f"""{CHUNKS_SQL},
cores AS (
  SELECT CAST(document_id AS BIGINT) AS qid, CASE chunk_order WHEN {CORES[0]} THEN 1 WHEN {CORES[1]} THEN 2 ELSE 3 END AS core_rank, *
  FROM chunks WHERE chunk_order IN {CORES}),
candidates AS (
  SELECT k.qid, k.core_rank, k.chunk_id AS core_id, k.token_count AS core_tokens, CASE WHEN c.chunk_order < k.chunk_order THEN 0 ELSE 1 END AS side,
         c.chunk_id, c.chunk_order, c.token_count
  FROM cores k JOIN chunks c ON c.document_id = k.document_id AND abs(c.chunk_order - k.chunk_order) = 1
  WHERE k.token_count < 800 AND (c.section_id = k.section_id OR c.parent_section_id = k.parent_section_id) AND c.chunk_order NOT IN {CORES}),
fits1 AS (SELECT *, core_tokens + token_count <= 1200 AS fits, row_number() OVER (PARTITION BY core_id ORDER BY side) AS n FROM candidates),
chosen AS (
  SELECT a.* FROM fits1 a LEFT JOIN fits1 b ON b.core_id = a.core_id AND b.n = 1 AND a.n = 2
  WHERE a.core_tokens + a.token_count + CASE WHEN b.fits THEN b.token_count ELSE 0 END <= 1200)"""


@query("p1_candidates", f"WITH {CANDIDATES_SQL} SELECT qid, CAST(core_rank AS INTEGER) AS core_rank, core_id, core_tokens, CAST(side AS INTEGER) AS side, chunk_id, chunk_order, token_count FROM candidates")
def p1_candidates(spark, sf_dir):
    return context.candidates(cores(spark, sf_dir), stand_ins(spark, sf_dir), PARAMS.no_expand_tokens)


_GROUPS_SQL = """
groups AS (
  SELECT qid, CAST(core_rank AS INTEGER) AS core_rank, chunk_id AS core_id, chunk_id, TRUE AS is_core FROM cores
  UNION ALL SELECT qid, CAST(core_rank AS INTEGER), core_id, chunk_id, FALSE FROM chosen)"""


@query("p1_context", f"WITH {CANDIDATES_SQL}, {_GROUPS_SQL} SELECT * FROM groups")
def p1_context(spark, sf_dir):
    return context.select(cores(spark, sf_dir), stand_ins(spark, sf_dir), PARAMS.no_expand_tokens, PARAMS.context_tokens)


@query(
    "render_context",
    f"""WITH {CANDIDATES_SQL}, {_GROUPS_SQL}
SELECT g.qid, g.core_rank, g.core_id,
       sha256(string_agg('标题路径：' || c.parent_section_id || chr(10) || '来源行：3-9' || chr(10) || chr(10) || '正文：' || chr(10) || c.text,
                         chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY c.chunk_order)) AS context_sha256
FROM groups g JOIN chunks c USING (chunk_id) GROUP BY ALL""",
)
def render_context(spark, sf_dir):
    shown = search.contexts(cores(spark, sf_dir), stand_ins(spark, sf_dir), PARAMS)
    return shown.select("qid", "core_rank", "core_id", sha256(F.col("context")).alias("context_sha256"))


# --- history and accounts -------------------------------------------------------------------------


@query(
    "recent_history",
    f"""WITH {MESSAGES_SQL}
SELECT conversation_id, id, role, content, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS n FROM messages) WHERE n <= 4""",
)
def recent_history(spark, sf_dir):
    return history.recent(messages(spark, sf_dir), history.message_limit(2))


_HISTORY_SQL = f"""{MESSAGES_SQL},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS n FROM messages) WHERE n <= 6 AND role < 2),
trimmed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS t FROM last) WHERE t <= 3),
named AS (SELECT *, CASE role WHEN 0 THEN 'user' ELSE 'assistant' END AS name FROM trimmed)"""


def _spelled(c):
    return sha256(F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit("\n"), m["content"])), "\n"))


@query(
    "trim_history",
    f"""WITH {_HISTORY_SQL}
SELECT conversation_id, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(name || chr(10) || content, chr(10) ORDER BY id)) AS history_sha256
FROM named GROUP BY conversation_id""",
)
def trim_history(spark, sf_dir):
    h = history.histories(messages(spark, sf_dir), 6).withColumn("history", history.trimmed(F.col("history"), 3))
    return h.select("conversation_id", F.size("history").alias("n"), _spelled(F.col("history")).alias("history_sha256"))


@query(
    "prompt_messages",
    f"""WITH {_HISTORY_SQL},
h AS (SELECT conversation_id, count(*) AS n, string_agg(name || chr(10) || content, chr(10) ORDER BY id) AS told FROM named GROUP BY conversation_id)
SELECT conversation_id, CAST(n + 2 AS INTEGER) AS n_messages,
       sha256('system' || chr(10) || 'Be brief.' || chr(10) || chr(10) || '{history.SAFETY}' || chr(10) || told || chr(10) || 'user' || chr(10)
              || '【不可信参考资料】' || chr(10) || 'a' || chr(10) || '---' || chr(10) || 'b' || chr(10) || chr(10) || '【用户问题】' || chr(10) || 'why?') AS prompt_sha256
FROM h""",
)
def prompt_messages(spark, sf_dir):
    h = history.histories(messages(spark, sf_dir), 6).withColumn("history", history.trimmed(F.col("history"), 3))
    full = history.prompt(F.col("history"), F.lit("why?"), F.array(F.lit("a"), F.lit("b")), " Be brief. ")
    return h.select("conversation_id", F.size(full).alias("n_messages"), _spelled(full).alias("prompt_sha256"))


@query(
    "message_validation",
    """
SELECT doc_id, CASE WHEN text IS NULL OR regexp_matches(text, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]*$') THEN 'message is empty'
                    WHEN strlen(text) > 1000 THEN 'message too long'
                    WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'message contains unsupported control character' END AS error
FROM documents""",
)
def message_validation(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.message_error(F.col("text")).alias("error"))


@query("query_validation", "SELECT item_id, length(trim(text)) BETWEEN 1 AND 1000 AS valid FROM benchmark")
def query_validation(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", tx.valid_query(F.col("text")).alias("valid"))


@query("point_lookup", f"WITH {USERS_SQL} SELECT * FROM users WHERE id = 42 LIMIT 1")
def point_lookup(spark, sf_dir):
    return accounts.find(users(spark, sf_dir), id=42)


@query("user_profile", f"WITH {USERS_SQL} SELECT id, mobile, nickname, sex FROM users WHERE mobile = 'm7'")
def user_profile(spark, sf_dir):
    return accounts.profile(accounts.find(users(spark, sf_dir), mobile="m7"))


@query("conversation_lookup", f"WITH {MESSAGES_SQL} SELECT * FROM messages WHERE conversation_id = 3 AND id = 1")
def conversation_lookup(spark, sf_dir):
    return accounts.find(messages(spark, sf_dir), conversation_id=3, id=1)


@query(
    "conversation_resolve",
    """
WITH t AS (SELECT conv_id AS id, conv_id % 5 AS user_id, 's' || conv_id AS session_id FROM (SELECT DISTINCT conv_id FROM conversations)),
a AS (SELECT user_id, session_id FROM t UNION ALL SELECT 7, 's' || c_custkey FROM customer WHERE c_custkey <= 50)
SELECT a.user_id, a.session_id, t.id IS NOT NULL AS known, t.id AS known_id FROM a LEFT JOIN t USING (user_id, session_id)""",
)
def conversation_resolve(spark, sf_dir):
    """Every conversation by user and session, and sessions that are new: these get rows with ids of their own."""
    t = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    session = F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id")
    t = t.select(F.col("conv_id").alias("id"), F.pmod("conv_id", F.lit(5)).alias("user_id"), session)
    new = read(spark, sf_dir, "customer").filter("c_custkey <= 50").select(F.lit(7).cast("long").alias("user_id"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session_id"))
    _, found = accounts.resolve(t, t.select("user_id", "session_id").unionByName(new))
    known = F.col("user_id") < 5
    return found.select("user_id", "session_id", known.alias("known"), F.when(known, F.col("id")).alias("known_id"))


@query(
    "users_insert",
    f"""WITH {USERS_SQL}
SELECT * FROM users UNION ALL
SELECT id + 1000000, mobile || 'x', nickname, sex, balance FROM users WHERE id % 7 = 0""",
)
def users_insert(spark, sf_dir):
    u = users(spark, sf_dir)
    odd = F.col("id") % 7 == 0
    rows = u.filter(F.col("id") % 7 < 2).withColumn("mobile", F.when(odd, F.concat("mobile", F.lit("x"))).otherwise(F.col("mobile")))
    return accounts.insert(u, rows.withColumn("id", F.col("id") + 1000000), ["mobile"])[0]


@query("users_update", f"WITH {USERS_SQL} SELECT id, mobile, CASE WHEN balance < 0 THEN 'in debt' ELSE nickname END AS nickname, sex, balance FROM users")
def users_update(spark, sf_dir):
    u = users(spark, sf_dir)
    return accounts.update(u, u.filter("balance < 0").select("id", F.lit("in debt").alias("nickname")), "id")


@query("users_upsert", f"WITH {USERS_SQL} SELECT id, mobile, nickname, sex, CASE WHEN id % 10 = 0 THEN balance + 1 ELSE balance END AS balance FROM users")
def users_upsert(spark, sf_dir):
    u = users(spark, sf_dir).withColumn("version", F.lit(1))
    new = u.filter("id % 10 = 0").withColumn("balance", F.col("balance") + 1).withColumn("version", F.lit(2))
    return accounts.upsert(u, new, "id", F.col("version")).drop("version")


@query("users_delete", f"WITH {USERS_SQL} SELECT * FROM users WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def users_delete(spark, sf_dir):
    return accounts.delete(users(spark, sf_dir), read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").cast("long").alias("id")), "id")


@query("repeated_keys", f"WITH {MESSAGES_SQL} SELECT conversation_id, role, count(*) AS rows FROM messages GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return accounts.repeated(messages(spark, sf_dir), "conversation_id", "role")


@query(
    "messages_append",
    f"""WITH {MESSAGES_SQL},
n AS (SELECT conversation_id, max(id) + 1 AS first_id FROM messages GROUP BY conversation_id)
SELECT * FROM messages UNION ALL SELECT conversation_id, first_id, 0, 'q' || conversation_id FROM n UNION ALL SELECT conversation_id, first_id + 1, 1, 'a' FROM n""",
)
def messages_append(spark, sf_dir):
    m = messages(spark, sf_dir)
    ends = m.groupBy("conversation_id").agg((F.max("id") + 1).alias("next"))
    asked_ = ends.withColumn("question", F.concat(F.lit("q"), F.col("conversation_id").cast("string"))).withColumn("answer", F.lit("a"))
    return m.unionByName(history.exchange(asked_, F.col("next")))


# --- JSON -----------------------------------------------------------------------------------------


@query("json_roundtrip", "SELECT item_id, CAST(json_object('item_id', item_id, 'text', text) AS VARCHAR) AS value, TRUE AS same FROM benchmark")
def json_roundtrip(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").withColumn("value", sinks.sorted_json("text", "item_id"))
    back = F.from_json("value", "item_id long, text string")
    return b.select("item_id", "value", (back["text"].eqNullSafe(F.col("text")) & back["item_id"].eqNullSafe(F.col("item_id"))).alias("same"))


@query(
    "manifest_lines",
    f"""WITH {CHUNKS_SQL}
SELECT CAST(json_object('chunk_id', chunk_id, 'chunk_order', chunk_order, 'document_id', document_id, 'parent_section_id', parent_section_id,
                        'record_type', 'chunk', 'section_id', section_id, 'token_count', token_count) AS VARCHAR) AS value
FROM chunks""",
)
def manifest_lines(spark, sf_dir):
    columns = "chunk_id", "document_id", "section_id", "parent_section_id", "chunk_order", "token_count"
    return sinks.manifest_lines(stand_ins(spark, sf_dir).select(*columns))
