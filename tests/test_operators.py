from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import ConfigError, DataError, IndexContract, RetrievalParams, load_yaml
from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import accounts, bm25, context, dense, embedding, evaluation, fusion, history, indexing, mmr
from tessera.plans import relevance, search
from tessera.sources import readers, sinks


def test_tokens_hold_whole_and_parts(spark):
    (row,) = tx.tokenised(spark.createDataFrame([("runtime.Gosched goroutine_scheduler",)], "x string"), "x").collect()
    assert {"runtime.gosched", "runtime", "gosched", "goroutine_scheduler", "goroutine", "scheduler"} <= set(row.x)
    assert row.x.count("runtime") == 3


def test_tokens_of_compatibility_forms_and_chinese():
    assert tx.search_tokens(" ﬁle１ ") == ["file1"] * 4
    assert tx.search_tokens("你好世界 a中b") == ["你好", "好世", "世界", "a", "中", "b", "a", "a", "a", "b", "b", "b"]
    assert tx.search_tokens(None) == tx.search_tokens(" \t") == []


def test_nfkc(spark):
    assert tx.nfkc(spark.createDataFrame([(" ﬁ１ ",), (None,)], "t string"), "t").collect()[0].t == "fi1"


@pytest.mark.parametrize("shard", [1, 2, 100])
def test_bm25_against_a_plain_loop(spark, monkeypatch, shard):
    docs = ["red fox", "red red hen", "blue owl sleeps", "fox and hen", ""]
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
    index = bm25.build(spark.createDataFrame([(i, d.split()) for i, d in enumerate(docs)], "id long, tokens array<string>").coalesce(1))
    assert index.shards.count() == -(-len(docs) // shard)
    asked = spark.createDataFrame([(1, ["fox", "fox", "hen", "none"]), (2, ["none"]), (3, [])], "qid long, tokens array<string>")
    found = bm25.top_k(index, asked, 10)
    words = [d.split() for d in docs]
    n, avgdl = len(docs), sum(map(len, words)) / len(docs)
    df = {t: sum(t in w for w in words) for w in words for t in w}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    want = {}
    for i, w in enumerate(words):
        score = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in ("fox", "fox", "hen"))
        if score > 0:
            want[i] = score
    got = {r.id: r for r in found.collect()}
    assert {r.qid for r in got.values()} == {1} and set(got) == set(want)
    assert all(r.score == pytest.approx(want[i], abs=1e-8) for i, r in got.items())
    best = sorted(want, key=lambda i: (-round(want[i], 9), i))
    assert [r.id for r in bm25.top_k(index, asked, 2).orderBy("rank").collect()] == best[:2]


def test_bm25_ids_and_empty_index(spark):
    nothing = bm25.build(spark.createDataFrame([], "id long, tokens array<string>"))
    assert nothing.stats.first().n_docs == 0 and nothing.terms.isEmpty()
    assert bm25.top_k(nothing, spark.createDataFrame([(1, ["a"])], "qid long, tokens array<string>"), 3).isEmpty()
    for rows in ([("a",), ("a",)], [(" ",)], [(None,)]):
        with pytest.raises(DataError):
            bm25.ensure_ids(spark.createDataFrame(rows, "id string"), "id")
    with pytest.raises(DataError):
        bm25.resolve(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2,)], "id long"))


def test_dense_ties_zero_and_misfits(spark):
    points = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None)], "id long, vector array<double>")
    got = dense.top_k(points, spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "qid long, qvec array<double>"), 3).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [(9, 1, 1.0), (9, 3, 1.0), (9, 2, 0.0)]
    with pytest.raises(DataError):
        dense.top_k(points, spark.createDataFrame([(9, [1.0])], "qid long, qvec array<double>"), 3)
    with pytest.raises(DataError):
        dense.top_k(points, spark.createDataFrame([(9, [1.0, 0.0]), (8, [1.0])], "qid long, qvec array<double>"), 3)
    assert dense.top_k(points.limit(0), spark.createDataFrame([(9, [1.0, 0.0])], "qid long, qvec array<double>"), 3).isEmpty()


def test_dense_in_blocks_and_strips(spark, monkeypatch):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(50, 4)).tolist())], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(20, 4)).tolist())], "qid long, qvec array<double>")
    want = sorted(map(tuple, dense.top_k(points, asked, 3).collect()))
    monkeypatch.setattr(dense, "BLOCK", 7)
    monkeypatch.setattr(dense, "STRIP", 3)
    assert sorted(map(tuple, dense.top_k(points, asked, 3).collect())) == want and len(want) == 60


def test_cosine_of_zero_vector(spark):
    assert spark.sql("SELECT array(0D, 0D) a, array(1D, 2D) b").select(vx.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_rrf_order(spark):
    lists = "qid long, id string, rank int"
    near = spark.createDataFrame([(1, "a", 1), (1, "s", 2)], lists)
    found = spark.createDataFrame([(1, "s", 1), (1, "b", 2)], lists)
    fused = fusion.rrf(near, found, RetrievalParams(rank_constant=60, bm25_weight=1.0))
    assert [r.id for r in fused.orderBy("rrf_rank").collect()] == ["s", "a", "b"]
    same = fusion.normalised(fusion.rrf(near.filter("id = 'a'"), found.limit(0), RetrievalParams()))
    assert same.first().relevance == 1.0


def test_mmr_prefers_the_different_one(spark):
    got = mmr.picks(np.array([1.0, 0.5, 0.0]), np.array([[1, 0], [0.99, 0.01], [0, 1]], float), 2, 0.5)
    assert [i for i, _ in got] == [0, 2]
    assert [i for i, _ in mmr.picks(np.array([1.0, 0.5, 0.0]), np.eye(3), 3, 1.0)] == [0, 1, 2]
    with pytest.raises(ValueError):
        mmr.select(None, None, 1, 0.0)


def test_mmr_without_vectors_and_with_repeated_points(spark):
    c = spark.createDataFrame([(1, i, 0.5, i, r) for i, r in ((1, 1.0), (2, 0.9), (3, 0.1))], "qid long, id long, rrf_score double, rrf_rank int, relevance double")
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="no vector"):
        mmr.select(c, points, 2, 0.5).collect()
    assert [r.id for r in mmr.select(c, points, 2, 0.5, unlike=True).orderBy("mmr_rank").collect()] == [1, 3]
    with pytest.raises(Exception, match="repeated"):
        mmr.select(c, points.unionByName(points), 2, 0.5, unlike=True).collect()


CHUNK = "chunk_id string, document_id string, section_id string, parent_section_id string, chunk_order int, token_count int"


@pytest.mark.parametrize(
    ("chunks", "want"),
    [
        ([("p", "d", "s", "r", 9, 300), ("c", "d", "s", "r", 10, 400), ("n", "d", "t", "r", 11, 300)], {"p", "c", "n"}),
        ([("p", "d", "s", "r", 9, 300), ("c", "d", "s", "r", 10, 800), ("n", "d", "t", "r", 11, 300)], {"c"}),
        ([("p", "e", "s", "r", 9, 300), ("c", "d", "s", "r", 10, 400), ("n", "d", "t", "q", 11, 300)], {"c"}),
        ([("c", "d", "s", None, 10, 400), ("n", "d", "t", None, 11, 300)], {"c"}),
        ([("p", "d", "s", "r", 9, 900), ("c", "d", "s", "r", 10, 400), ("n", "d", "t", "r", 11, 300)], {"c", "n"}),
        ([("p", "d", "s", "r", 8, 300), ("c", "d", "s", "r", 10, 400)], {"c"}),
    ],
)
def test_context_budget_and_relation(spark, chunks, want):
    cores = spark.createDataFrame([(1, "c", 1)], "qid long, chunk_id string, core_rank int")
    assert {r.chunk_id for r in context.select(cores, spark.createDataFrame(chunks, CHUNK), 800, 1200).collect()} == want


def test_context_never_adds_a_core_or_a_chunk_twice(spark):
    chunks = spark.createDataFrame([(c, "d", "s", "r", i, 100) for i, c in enumerate("abcde")], CHUNK)
    cores = spark.createDataFrame([(1, "b", 1), (1, "d", 2), (1, "a", 3)], "qid long, chunk_id string, core_rank int")
    got = [(r.core_id, r.chunk_id) for r in context.select(cores, chunks, 800, 1200).collect()]
    assert sorted(got) == [("a", "a"), ("b", "b"), ("b", "c"), ("d", "d"), ("d", "e")]


def test_metrics(spark):
    ranks = spark.createDataFrame([("m", 1, "x", 1), ("m", 2, "x", 2), ("m", 3, "y", None)], "mode string, case_id long, stress_type string, rank int")
    whole = evaluation.metrics(ranks, 3).filter("stress_type IS NULL").first()
    assert (whole.case_count, whole.hit_rate_1, whole.hit_rate_3, whole.mrr) == (3, 0.3333, 0.6667, 0.5)
    assert "hit_rate_5" not in evaluation.metrics(ranks, 3).columns


def test_evaluation_files(spark, tmp_path):
    f = tmp_path / "cases.jsonl"
    f.write_text('{"case_id":"1","query":" q ","target_chunk_id":"a"}\n\n{"case_id":"2","query":"r","relevant_chunks":[{"chunk_id":"b"},{"chunk_id":"c"},{"chunk_id":"b"}],"stress_type":"t"}\n')
    got = {r.case_id: r for r in readers.evaluation_cases(spark, str(f)).collect()}
    assert got["1"].relevant == ["a"] and got["1"].stress_type == "unspecified" and got["1"].query == "q"
    assert sorted(got["2"].relevant) == ["b", "c"]
    f.write_text('{"case_id":"1","query":"q"}\n')
    with pytest.raises(DataError):
        readers.evaluation_cases(spark, str(f))


def test_config(tmp_path):
    good = "collection_prefix: {p}\nbm25: {{candidate_top_k: 15, tokenizer_version: v1}}\nrrf: {{rank_constant: 20, dense_weight: 1.0, bm25_weight: 0.005}}\nmmr: {{lambda: {m}}}\n"
    f = tmp_path / "c.yaml"
    f.write_text(good.format(p="tech_docs", m=0.7))
    contract, params = load_yaml(str(f))
    assert contract.collection("0" * 64) == "tech_docs_" + "0" * 64 and params.mmr_lambda == 0.7
    for p, m in (("tech_docs", 0), ("tech docs", 0.7), ("tech_docs", "x")):
        f.write_text(good.format(p=p, m=m))
        with pytest.raises(ConfigError):
            load_yaml(str(f))
    for wrong in ({"top_k": 11}, {"context_tokens": 700}, {"dense_weight": 0}, {"rank_constant": True}):
        with pytest.raises(ConfigError):
            RetrievalParams(**wrong)
    with pytest.raises(ConfigError):
        contract.collection("latest")
    assert params.asked(10).top_k == 10
    for wrong in (0, 11, True, 2.0):
        with pytest.raises(ConfigError):
            params.asked(wrong)


def test_message_checks(spark):
    texts = ["Explain `defer` in Go.\n", "  ", "a\x00b", "x" * 1001, None, "é" * 501]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.e for r in df.orderBy("i").select(tx.message_error(F.col("t")).alias("e")).collect()]
    assert [e is None for e in got] == [True, False, False, False, False, False]


def test_history(spark):
    rows = [(1, i, i % 3, f"m{i}") for i in range(1, 8)]
    m = spark.createDataFrame(rows, "conversation_id long, id long, role int, content string")
    (h,) = history.histories(m, 4).collect()
    assert [x.content for x in h.history] == ["m4", "m6", "m7"]
    assert history.recent(m, 0).isEmpty()
    assert [x.content for x in spark.createDataFrame([h]).select(history.trimmed(F.col("history"), 2).alias("t")).first().t] == ["m6", "m7"]
    shown = m.limit(1).select(history.user_content(F.lit("q"), F.array().cast("array<string>")).alias("x")).first().x
    assert shown == "【用户问题】\nq"


def test_accounts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    new, refused = accounts.insert(t, spark.createDataFrame([(3, "b"), (4, "c"), (5, "c")], "id long, name string"), ["name"])
    assert sorted(r.name for r in new.collect()) == ["a", "b", "c"] and refused.count() == 2
    changed = accounts.update(t, spark.createDataFrame([(2, None)], "id long, name string"), "id")
    assert {r.id: r.name for r in changed.collect()} == {1: "a", 2: None}
    assert accounts.delete(t, t.filter("id = 1"), "id").count() == 1
    assert accounts.find(t, id=None).isEmpty()
    dated = t.withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    now = F.lit("2026-01-01").cast("timestamp")
    years = {r.id: r.updated_at.year for r in accounts.update(dated, t.filter("id = 2"), "id", now).collect()}
    assert years == {1: 2020, 2: 2026}


def test_conversations_by_user_and_session(spark):
    known = spark.createDataFrame([(5, 1, "a"), (9, 2, "a")], "id long, user_id long, session_id string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (3, " ")], "user_id long, session_id string")
    table, found = accounts.resolve(known, asked)
    rows = found.collect()
    assert len(rows) == 5 and table.count() == 5 and accounts.repeated(table, "id").isEmpty() and accounts.repeated(table, "user_id", "session_id").isEmpty()
    assert [r.id for r in rows if r.user_id == 1] == [5] and len({r.id for r in rows if r.user_id == 2}) == 1 and len({r.session_id for r in rows if r.user_id == 3}) == 2
    assert accounts.find(table, user_id=2, session_id="a").first().id == 9


def test_containment_with_short_passages(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one"), (3, "on e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "ne"), (3, "ne two three four five si")], "item_id long, text string")
    assert sorted(map(tuple, relevance.containing(docs, items).collect())) == [(1, 1), (1, 2), (1, 3), (2, 2)]


def test_index_round_trip(spark, tmp_path):
    (tmp_path / "docs/sub dir").mkdir(parents=True)
    (tmp_path / "docs/a.md").write_text("# A\nalpha beta\n\n# B\ngamma\n")
    (tmp_path / "docs/sub dir/b+c.md").write_text("plain text")
    (tmp_path / "docs/skip.txt").write_text("no")
    docs = readers.markdown(spark, str(tmp_path / "docs"))
    assert sorted(r.path for r in docs.collect()) == ["a.md", "sub dir/b+c.md"]
    (tmp_path / "docs/sub dir/docs").mkdir()
    (tmp_path / "docs/sub dir/docs/a.md").write_text("x")
    assert sorted(r.path for r in readers.markdown(spark, str(tmp_path / "docs")).collect()) == ["a.md", "sub dir/b+c.md", "sub dir/docs/a.md"]
    (tmp_path / "docs/sub dir/docs/a.md").unlink()
    with pytest.raises(DataError):
        readers.markdown(spark, str(tmp_path / "nothing"))
    contract = IndexContract(embedding_dimensions=2)
    records, version = search.build(docs, contract)
    again, same = search.build(docs.repartition(3), contract)
    assert version == same
    out = str(tmp_path / "index")
    vectors = records.select("chunk_id", F.array(F.lit(1.0), F.col("chunk_order").cast("double")).alias("vector"))
    search.store(records, vectors, contract, version, out)
    points, entries = search.load(spark, out, contract, version)
    assert points.count() == entries.count() == 3
    assert sinks.ensure_collection(spark, f"{out}/points", 2)
    with pytest.raises(DataError):
        sinks.ensure_collection(spark, f"{out}/points", 3)
    with pytest.raises(DataError):
        readers.token_artifact(spark, f"{out}/bm25-{version}", {"tokenizer_version": "other"})
    with pytest.raises(DataError):
        search.store(records, vectors.limit(1), contract, version, out)
    head = json.loads(spark.read.text(f"{out}/manifest-{version}/metadata").first().value)
    assert head["chunk_count"] == 3 and head["index_version"] == version
    assert indexing.set_difference(points, entries.limit(2), "chunk_id").count() == 1
    ids = [r.chunk_id for r in points.select("chunk_id").collect()]
    wanted = spark.createDataFrame([(ids[2], 0), (ids[0], 1)], "chunk_id string, position int")
    assert [r.chunk_id for r in readers.by_ids(points, wanted).collect()] == [ids[2], ids[0]]
    for wrong in ([("none", 0)], [(ids[0], 0), (ids[0], 1)]):
        with pytest.raises(DataError):
            readers.by_ids(points, spark.createDataFrame(wrong, "chunk_id string, position int"))
    assert readers.typed(points, 2, version).schema["chunk_order"].dataType.simpleString() == "int"
    with pytest.raises(DataError):
        readers.typed(points, 3, version)
    moved = points.limit(1).withColumn("vector", F.array(F.lit(7.0), F.lit(7.0))).drop("index_version")
    sinks.upsert_points(spark.createDataFrame(moved.collect(), moved.schema), f"{out}/points", version)
    after = readers.points(spark, f"{out}/points", version)
    assert after.count() == 3 and after.filter("vector[0] = 7").count() == 1

    lexical = bm25.build(entries.withColumnRenamed("chunk_id", "id"))
    asked = spark.createDataFrame([(1, "alpha", [1.0, 0.0])], "qid long, query string, qvec array<double>")
    told = search.search(after, lexical, asked, RetrievalParams(bm25_weight=1.0), 2).first()
    assert told.qid == 1 and len(told.contexts) == 2 and any("alpha beta" in c for c in told.contexts)
    with pytest.raises(ConfigError):
        search.search(after, lexical, asked, RetrievalParams(), 11)
    with pytest.raises(DataError):
        search.search(after, lexical, asked.withColumn("query", F.lit(" ")), RetrievalParams(), 2)


def test_embedder_in_batches(spark):
    records = spark.createDataFrame([(f"c{i}", "x" * i) for i in range(7)], "chunk_id string, embedding_text string")
    backwards = lambda texts: [(i, [len(t), 1.0]) for i, t in reversed(list(enumerate(texts)))]
    got = {r.chunk_id: r.vector for r in embedding.embedded(records, backwards, 2, size=3).collect()}
    assert got == {f"c{i}": [float(i), 1.0] for i in range(7)}
    for wrong in ([(0, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (2, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(DataError):
            embedding.in_order(wrong, 2, 1)


def test_end_to_end_search(spark):
    docs = spark.createDataFrame([(i, f"word{i} shared") for i in range(6)], "doc_id long, text string")
    points = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(6)], "id long, vector array<double>")
    corpus = search.Corpus(points, bm25.build(docs, key="doc_id", text="text"))
    asked = spark.createDataFrame([(7, "t", [1.0, 0.0], ["word3"])], "qid long, stress_type string, qvec array<double>, tokens array<string>")
    got = search.hybrid(corpus, asked, RetrievalParams(top_k=2)).orderBy("mmr_rank").collect()
    assert len(got) == 2 and got[0].id == 0
    m = search.evaluate(corpus, asked, spark.createDataFrame([(7, 0)], "qid long, id long"), RetrievalParams())
    assert {(r.mode, r.mrr) for r in m.filter("stress_type IS NULL").collect()} == {("bm25", 0.0), ("dense", 1.0), ("hybrid", 1.0)}
