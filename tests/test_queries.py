from __future__ import annotations

import pytest
from oracle import compare, connect

from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    compare(QUERIES[name](spark, SF).toArrow(), db.sql(SQL[name]).to_arrow_table())


def test_chunk_pack_keeps_its_contract(spark):
    from tessera.operators import indexing

    chunks = QUERIES["chunk_pack"](spark, SF).cache()
    assert chunks.filter("token_count > 1200 OR token_count <> length(embedding_text)").isEmpty()
    assert indexing.order_violations(chunks).isEmpty()
    assert chunks.groupBy("chunk_id").count().filter("count > 1").isEmpty()
    # Within a section every chunk links to the next, and only there.
    ends = chunks.groupBy("section_id").agg({"previous_chunk_id": "count", "next_chunk_id": "count", "chunk_id": "count"})
    assert ends.filter("`count(previous_chunk_id)` <> `count(chunk_id)` - 1 OR `count(next_chunk_id)` <> `count(chunk_id)` - 1").isEmpty()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_training_part(monkeypatch):
    import importlib.util

    import __spark_entry__

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(SQL)
