from __future__ import annotations

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import markdown as md
from tessera.functions.ids import stable_id, uuid5
from tessera.operators import markdown

SOFT, HARD = 80, 120


def pieces(text):
    return list(md.pieces(text, len, SOFT, HARD))


def titles(piece):
    return " > ".join(h.text for h in piece.path)


def test_skipped_levels():
    got = pieces("# Root\none\n### Child\ntwo\n## Sibling\nthree\n")
    assert [titles(p) for p in got] == ["Root", "Root > Child", "Root > Sibling"]


def test_hash_inside_fence_is_text():
    (one,) = pieces("# Root\nBefore.\n```sh\n# comment\n```\n")
    assert one.has_code and "# comment" in one.text


def test_toc_marks_are_dropped():
    assert [p.text for p in pieces("[TOC]\n\n<!-- TOC -->\n\n# Root\n\nOK\n")] == ["OK"]


def test_sentences_end_pieces():
    got = pieces("# R\n" + "甲" * 64 + "。" + "乙" * 64 + "。")
    assert len(got) >= 2 and got[0].text.endswith("。") and all(p.tokens <= HARD for p in got)


def test_forced_split_loses_nothing():
    got = pieces("a" * 300)
    assert len(got) >= 2 and "".join(p.text for p in got) == "a" * 300 and all(p.tokens <= HARD for p in got)


def test_unclosed_fence_takes_the_rest():
    (one,) = pieces("# A\n```\n# B\n\nx\n")
    assert titles(one) == "A" and "# B" in one.text


def test_preamble_and_empty_section():
    got = pieces("intro\n# Empty\n## Full\nbody\n")
    assert [titles(p) for p in got] == ["", "Empty > Full"]


def test_nothing():
    assert pieces("") == [] and pieces("# Only\n\n") == []


def test_limits_are_checked():
    with pytest.raises(ValueError):
        list(md.pieces("x", len, 0, 5))
    with pytest.raises(ValueError):
        list(md.pieces("# " + "t" * 200 + "\nbody " * 40, len, SOFT, HARD))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #>|`-。!.\n ", max_size=400))
def test_pieces_stay_within_the_limit(text):
    got = list(md.pieces(text, len, 60, 400))
    assert all(0 < p.tokens <= 400 and p.text.strip() == p.text and p.first <= p.last for p in got)
    assert [p.first for p in got] == sorted(p.first for p in got)


def test_cut_goes_back_to_the_best_mark():
    """By the order of the marks, not by the nearest: the full stop wins over the later space."""
    packer = md.Packer((), len, 10, 14)
    block = md.Block("ab。cd ef gh ij kl mn", 3, 3, "prose")
    room = 14 - len(md.BODY_LABEL)
    got = packer.forced(block)
    assert got[0].text == "ab。" and "".join("".join(p.text.split()) for p in got) == "".join(block.text.split())
    assert all(len(p.text) <= room for p in got)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 。.\n", min_size=1, max_size=80), st.integers(1, 12))
def test_cuts_are_the_longest_that_fit(text, room):
    """Against one character at a time."""
    packer, rest, want = md.Packer((), len, 1, room + len(md.BODY_LABEL)), text, []
    while rest:
        if len(rest) <= room:
            want.append(rest)
            break
        head = rest[:room]
        marks = [m for m in md.CUT_AFTER if m in head]
        end = head.rindex(marks[0]) + len(marks[0]) if marks else room
        end = end if head[:end].strip() else room
        want.append(rest[:end].rstrip() or rest[:end])
        rest = rest[end:].lstrip()
    assert [p.text for p in packer.forced(md.Block(text, 1, 1 + text.count("\n"), "prose"))] == want


@pytest.mark.parametrize(
    ("first", "second", "kind"),
    [("> q", None, "quote"), ("- a", None, "list"), ("1) a", None, "list"), ("a|b", "---|---", "table"), ("a|b", "c", "prose"), ("```", None, "code")],
)
def test_kinds(first, second, kind):
    assert md.kind_of(first, second) == kind


def test_ids_match_the_standard_library(spark):
    import hashlib

    row = spark.range(1).select(stable_id("a", F.lit("b"), F.lit(None)).alias("s"), uuid5(F.lit("näme")).alias("u")).first()
    assert row.s == hashlib.sha256("a\x1fb\x1f".encode()).hexdigest()
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "näme"))


def test_heading_rename_changes_embedding_not_content(spark):
    docs = spark.createDataFrame([("a.md", "# One\nbody"), ("b.md", "# Two\nbody"), ("n.md", None)], "path string, text string")
    rows = {r.path: r for r in markdown.chunks(docs).collect()}
    assert set(rows) == {"a.md", "b.md"}
    assert rows["a.md"].content_hash == rows["b.md"].content_hash and rows["a.md"].embedding_text != rows["b.md"].embedding_text
    assert rows["a.md"].parent_section_id is not None and rows["a.md"].chunk_order == 0
