from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

from tessera.llm import licenses
from tessera.llm.queries import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    compare(QUERIES[name](spark, SF).toArrow(), connect(SF).sql(SQL[name]).to_arrow_table())


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    w = words(text)
    found = [(i, label) for label, phrase in licenses.BASE for i in range(len(w)) if w[i : i + len(p := phrase.split(" "))] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_of_odd_rows(spark, odd, odd_rows, none):
    got = licenses.scan(spark, odd).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *base(r[1])) for r in odd_rows), key=repr)
    assert licenses.scan(spark, none).isEmpty()


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("CC BY CC-BY, cc by", "cc-by"),
        ("Released under the MIT License.", "mit"),
        ("released under the new mit license", "mit"),
        ("Redistribution and use in source and binary form, with or without modification, are permitted", "bsd"),
        ("İcc by", ""),
        ("all rights reserveD all rights Reserved", "reserved"),
        ("permission is hereby", ""),
        ("ccK by cc byK", ""),
    ],
)
def test_labels(spark, text, labels):
    row = licenses.scan(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == labels and (row.score >= licenses.COVERAGE) == bool(labels)
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == base(text)


def told(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return [(r.labels, r.score) for r in licenses.scan(spark, docs).orderBy("doc_id").collect()]


def test_whole_texts_with_changes(spark):
    mit = licenses.TEXTS[0][1].split()
    changed = [w for i, w in enumerate(mit) for w in ([w] if i % 15 else ["so", w] if i % 2 else [])]
    half = mit[: len(mit) // 3]
    scattered = [x for a, b in zip(mit, mit[1:], strict=False) for x in (a, b, "zz")]
    backwards = [x for i in range(len(mit) - 4, -1, -4) for x in mit[i : i + 4]]
    got = told(spark, *(" ".join(x) for x in (mit, ["Copyright"] * 500 + changed, half, scattered, backwards)), "a " * 5000 + licenses.TEXTS[4][1])
    assert got[0] == ("mit", 1.0)
    assert "mit" in got[1][0]
    # The first third holds the whole phrase, which has a template of its own, but not enough of the text.
    assert got[2][0] == "mit"
    # Pairs alone, and all k-grams in the wrong order, are no license.
    assert got[3][0] == got[4][0] == "" and max(got[3][1], got[4][1]) < 0.5
    assert got[5][0] == "apache"


def test_spans_do_not_run_on_in_chains(spark):
    """One pair of a phrase after the other, each two words further on: the drift of a span ends it."""
    words = "redistribution and use in source and binary forms with or without modification are permitted".split(" ")
    chain = [x for a, b in zip(words[::2], words[1::2], strict=True) for x in (a, b, "zz", "zz")]
    assert told(spark, " ".join(chain))[0][0] == "" and told(spark, " ".join(words))[0] == ("bsd", 1.0)


def test_pipeline_against_its_stages_by_hand(spark, labels_dir, tmp_path):
    """Copies, near copies, secrets and toxic texts are planted in a small corpus; what should stay stays."""
    import corpus_pipeline
    from tessera.llm import secrets, simhash

    docs = spark.read.parquet(f"{labels_dir}/documents.parquet")
    sample = {r.doc_id: r for r in docs.collect()}
    clean = next(i for i in sorted(sample) if i % 5 and i > 10)
    planted = [
        (2001, sample[clean].text + "\n", "en", "s", 0),
        (2002, sample[clean].text, "en", "s", 0),
        (2003, "password = Zx81kd93kfWQ0 and words", "en", "s", 0),
        (2003, "password = Zx81kd93kfWQ0 and words", "en", "s", 0),
        (2004, None, None, None, None),
        (None, "", None, None, None),
    ]
    folder = tmp_path / "in"
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{labels_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    columns = kept.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept.cache()
        kept = stage(spark, kept, str(folder)).cache()
        if n < 4:
            assert kept.columns == columns, name
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        if name == "toxicity":
            assert sum(i is not None and i < 900 and i % 5 == 0 for i in ids) < 10 and sum(i is not None and i < 900 and i % 5 != 0 for i in ids) > 700
        if name == "exact_dedup":
            texts = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in before.collect()]
            assert len(ids) == len(set(texts)) and 2001 in ids and 2002 not in ids and clean not in ids
        if name == "simhash_near_dedup":
            groups = {r.component_id for r in simhash.near_duplicates(spark, before).collect()}
            assert len(ids) == len(groups)
        if name == "secret_scans":
            assert sorted(ids, key=repr) == sorted((r.doc_id for r in before.collect()), key=repr)
            ranks = secrets.dictionary(spark, before)
            assert not any(secrets.spans(r.text, ranks) for r in kept.collect())
    assert kept.select("doc_id").distinct().count() == len(set(ids)) and kept.filter("offset + length > 1024").isEmpty()
    whole = corpus_pipeline.run(spark, str(folder))
    assert whole.count() == kept.count() and whole.select("sequence_id").distinct().count() == kept.select("sequence_id").distinct().count()
