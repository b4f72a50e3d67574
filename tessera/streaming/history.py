"""Streaming histories: the last messages of each session, forgotten an hour after the last one.

Input is a stream of session, ts, role, content; each batch emits the history of the
sessions that got messages. State holds at most ``limit`` messages a session and the
time of the last one. It goes when its timeout is due; a message that comes after the
lifetime but before that starts a new history all the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.runtime import ship

LIFETIME_MS = 3_600_000
OUTPUT = "session string, history string, n_messages int"
STATE = "messages string, seen_ms long"
#: Whether batches without data follow each other; with processing-time timeouts they would do so without end.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def histories(messages: DataFrame, limit: int, lifetime_ms: int = LIFETIME_MS) -> DataFrame:
    """session, history (JSON, oldest first), n_messages, updated at every batch."""
    ship(messages.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        text, seen = state.get if state.exists else ("[]", now)
        kept = json.loads(text) if now - seen < lifetime_ms else []
        for batch in batches:
            kept += [[str(t), r, c] for t, r, c in zip(batch["ts"], batch["role"], batch["content"], strict=True)]
            kept = sorted(kept, key=lambda m: m[0])[-limit:]
        state.update((json.dumps(kept), now))
        state.setTimeoutDuration(lifetime_ms)
        shown = json.dumps([{"role": r, "content": c} for _, r, c in kept], ensure_ascii=False)
        yield pd.DataFrame({"session": [key[0]], "history": [shown], "n_messages": [len(kept)]})

    grouped = messages.select("session", "ts", "role", "content").groupBy("session")
    return grouped.applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def catch_up(writer: DataStreamWriter, seconds: float) -> None:
    """Run a stream of histories over what its source holds now, then stop; an error after ``seconds``.

    Batches without data are off meanwhile: they would follow each other for ever, to look for timeouts.
    """
    spark = writer._spark
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        query = writer.trigger(availableNow=True).start()
        if not query.awaitTermination(seconds):
            query.stop()
            raise TimeoutError(f"the stream did not end within {seconds} s")
    finally:
        spark.conf.set(EMPTY_BATCHES, before)
