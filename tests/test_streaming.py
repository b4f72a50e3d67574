from __future__ import annotations

import json
import time

import pytest

from tessera.streaming.history import catch_up, histories

MESSAGES = "session string, ts string, role string, content string"


def add(spark, folder, rows):
    spark.createDataFrame([(s, f"2026-01-01 00:00:0{i}", "user", c) for i, (s, c) in enumerate(rows)], MESSAGES).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, state, name, lifetime_ms, limit=3):
    stream = histories(spark.readStream.schema(MESSAGES).parquet(str(folder)), limit, lifetime_ms)
    catch_up(stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(state)), 120)
    return {r.session: [m["content"] for m in json.loads(r.history)] for r in spark.table(name).collect()}


def test_histories_keep_the_last_messages(spark, tmp_path):
    add(spark, tmp_path / "in", [("s", f"m{i}") for i in range(5)] + [("t", "x")])
    assert run(spark, tmp_path / "in", tmp_path / "state", "kept", 3_600_000) == {"s": ["m2", "m3", "m4"], "t": ["x"]}


@pytest.mark.parametrize(("lifetime_ms", "want"), [(3_600_000, ["a", "b"]), (1, ["b"])])
def test_histories_expire(spark, tmp_path, lifetime_ms, want):
    name = f"expiring_{lifetime_ms}"
    add(spark, tmp_path / "in", [("s", "a")])
    run(spark, tmp_path / "in", tmp_path / "state", name, lifetime_ms)
    time.sleep(0.1)
    add(spark, tmp_path / "in", [("s", "b")])
    stream = histories(spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in")), 3, lifetime_ms)
    found = []
    writer = stream.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    catch_up(writer, 120)
    assert [[m["content"] for m in json.loads(r.history)] for r in found] == [want]


def test_a_stream_that_does_not_end_is_stopped(spark, tmp_path):
    add(spark, tmp_path / "in", [("s", "a")])
    stream = histories(spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in")), 3)
    slow = stream.writeStream.foreachBatch(lambda df, _: time.sleep(20)).option("checkpointLocation", str(tmp_path / "state")).outputMode("update")
    with pytest.raises(TimeoutError):
        catch_up(slow, 1)
    assert not spark.streams.active
