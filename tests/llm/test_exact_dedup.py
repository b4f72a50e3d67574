from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tessera.llm.shared import keep_rows, stripped


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    return {k: (len(v), None if min(v)[1] else min(v)[2]) for k, v in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.substring(exact_dedup.sha256(n), 1, 1), lambda n: F.unhex(F.lit("00"))])
def test_against_brute_force(spark, odd, odd_rows, digest):
    want = brute([(r[0], r[1]) for r in odd_rows])
    out = exact_dedup.exact_dedup(spark, odd, digest=digest).cache()
    assert out.count() == len(odd_rows) and out.filter("kept").count() == len(want)
    texts = defaultdict(set)
    for i, t, *_ in odd_rows:
        texts[i].add(norm(t))
    for r in out.collect():
        options = [want[t] for t in texts[r.doc_id]]
        assert (r.group_size, r.keep_id) in options
    sha = {hashlib.sha256(t.encode()).hexdigest() for t in want}
    if digest is exact_dedup.sha256:
        assert {r.digest.hex() for r in out.collect()} == sha


def test_kept_rows_hold_every_text_once(spark, odd, odd_rows):
    rest = keep_rows(spark, odd, exact_dedup.exact_dedup(spark, odd))
    assert rest.columns == odd.columns
    texts = [norm(r.text) for r in rest.select("text").collect()]
    assert sorted(texts) == sorted({norm(r[1]) for r in odd_rows})


def test_empty_table(spark, none):
    assert exact_dedup.exact_dedup(spark, none).isEmpty()
    assert keep_rows(spark, none, exact_dedup.exact_dedup(spark, none)).isEmpty()


def test_state_goes_on_with_the_next_files(spark, tmp_path):
    """The same state directory, more files: groups grow and the better row takes over."""
    schema = "run int, row long, doc_id long, n_points long, content long, digest binary"
    table, state = str(tmp_path / "digests"), str(tmp_path / "state")
    for part, rows in enumerate(([(0, 0, 5, 3, 0, b"a"), (0, 1, 6, 3, 0, b"b")], [(1, 0, 2, 9, 0, b"a")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(table)
        found = exact_dedup.run_stream(spark, table, spark.createDataFrame([], schema).schema, state)
        got = {bytes(r.digest): (r.n, -r.best.neg_id) for r in found.collect()}
    assert part == 1 and got == {b"a": (2, 2), b"b": (1, 6)}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.substring(exact_dedup.sha256(n), 1, 1), lambda n: F.unhex(F.lit("00"))])
def test_runs_on_one_state_see_all_rows_so_far(spark, tmp_path, digest):
    runs = [
        [(1, "a b"), (2, "c"), (3, "d"), (4, None)],
        [(5, "a  b"), (6, "c"), (1, "e"), (7, "")],
        [(8, "a b"), (9, "x"), (None, "e"), (2, "c"), (2, "c")],
    ]
    seen = []
    for rows in runs:
        seen += rows
        want = brute(seen)
        out = exact_dedup.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "state"), digest).collect()
        assert len(out) == len(rows)
        options = {}
        for i, t in rows:
            size, keep = want[norm(t)]
            best = max(n for _, n in [(x, len(y or "")) for x, y in seen if norm(y) == norm(t)])
            options.setdefault(i, set()).add((size, keep, i == keep and len(t or "") == best))
        for r in out:
            assert (r.group_size, r.keep_id) in {o[:2] for o in options[r.doc_id]}
            if r.kept:
                assert (r.group_size, r.keep_id, True) in options[r.doc_id]
        # Of rows that are equal in all, an earlier one is kept.
        before = seen[: -len(rows)]
        fresh = {norm(t) for i, t in rows if want[norm(t)][1] == i and (i, t) not in before}
        assert sum(r.kept for r in out) == len(fresh)


def test_rows_equal_in_id_and_text_keep_one_whatever_their_order(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "a", "z"), (2, "b", "x")]
    got = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        got.add(tuple(sorted(map(tuple, keep_rows(spark, docs, exact_dedup.exact_dedup(spark, docs)).collect()))))
    assert len(got) == 1 and len(got.pop()) == 2


def test_normalisation(spark):
    t = "a \t\n\x0b\x0c\r b\x1c\x85　"
    assert spark.createDataFrame([(t,), (None,)], "t string").select(stripped(F.col("t")).alias("x")).first().x == norm(t)
