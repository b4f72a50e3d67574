from __future__ import annotations

import random
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, packing

PATH = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab 'stre\n\t .,1²　\xa0\x85é😀<|>"), st.characters(exclude_categories=("Cs",))), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_and_text_are_those_of_the_library(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_ids_and_text_are_those_of_the_library, "t") else test_ids_and_text_are_those_of_the_library.t
    test_ids_and_text_are_those_of_the_library.t = library
    ids = library.encode(text, add_special_tokens=False).ids
    c = bpe.codec(PATH)
    assert c.encode(text) == packed(ids) == packing.encoder(PATH).encode(text)
    d = bpe.Decoder(c.merges.spelling)
    assert "".join([*(d.feed([i]) for i in ids), d.finish()]) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "  a  b ", "\n\n", " ", "don't we'LL x", "a" * 5000, " " * 3000, "ab\r\n cd"])
def test_special_and_uneven_texts(library, text):
    assert bpe.codec(PATH).encode(text) == packed(library.encode(text, add_special_tokens=False).ids) == packing.encoder(PATH).encode(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "thein", "-=*", "abcdefghijklmnopqrstuvwxyz", "ÃÂ", "ж漢"])
@pytest.mark.parametrize("step", [1, 333, 5000])
def test_stream_equals_whole(library, alphabet, step):
    rng = random.Random(3)
    text = "".join(rng.choice(alphabet) for _ in range(9000 if step > 1 else 900))
    flow, data, out = bpe.Transducer(bpe.codec(PATH).merges), text.encode(), []
    for i in range(0, len(data), step):
        out += flow.feed(data[i : i + step])
        assert len(flow.held) <= flow.merges.lookahead + step + 256
    assert out + flow.finish() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ["ab c\n 'll 12", "ab,.'s1", "a", "1", " ", "\n", "'", ",", "a,", "é漢1"])
@pytest.mark.parametrize("reach", [0, 5, 4096])
def test_windows_do_not_show(library, monkeypatch, alphabet, reach):
    monkeypatch.setattr(bpe, "WINDOW", 7)
    monkeypatch.setattr(bpe, "REACH", reach)
    rng = random.Random(4)
    text = "".join(rng.choice(alphabet) for _ in range(700))
    assert bpe.codec(PATH).encode(text) == packed(library.encode(text, add_special_tokens=False).ids)


def test_every_pre_token_goes_through_the_transducer(library, monkeypatch):
    """Short and long ones, with and without white space near; what is held stays as small as a block and the lookahead."""
    fed, held = [], []

    class Seen(bpe.Transducer):
        def feed(self, data):
            fed.append(data)
            out = super().feed(data)
            held.append(len(self.held))
            return out

    monkeypatch.setattr(bpe, "Transducer", Seen)
    c = bpe.Codec(PATH)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdef") for _ in range(200_000))
    text = "one two one " + long + " three " + "," * 90_000
    pieces = list(c.packed(text))
    assert b"".join(pieces) == packed(library.encode(text, add_special_tokens=False).ids)
    assert {b"one", b" two", b" one", b" three"} <= set(fed) and b"".join(d for d in fed if len(d) > 100).count(b",") == 90_000
    assert max(map(len, pieces)) <= 4 * (bpe.WINDOW + bpe.REACH) and max(held) <= c.words.block + c.merges.lookahead + 256


def test_memo_stays_small():
    class Doubled(bpe.Memo):
        def compute(self, key):
            return key * 2

    m = Doubled(10)
    for i in range(1000):
        assert m[str(i % 37)] == str(i % 37) * 2
        assert len(m) + len(m.old) <= 20


def test_decoder_replaces_what_is_no_text():
    d = bpe.Decoder([b"\xe2\x82", b"\xac", b"\xff", b"a", b"\xf0\x9f"])
    assert "".join([d.feed([0]), d.feed([1]), d.feed([2, 3]), d.feed([4]), d.finish()]) == "€�a�"


def test_digests_of_odd_rows(odd, odd_rows, none, library):
    import hashlib

    want = []
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_digests(odd, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_digests(none, PATH).isEmpty()


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time: how many sequences."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap == capacity
        insort(gaps, gap - x)
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.integers(1, 7))
def test_sweeps_over_partitions_are_one_stack(items, parts):
    """True is a piece. Any cut into partitions gives the matching of a stack over the whole order."""
    stack, want = [], {}
    for i, piece in enumerate(items):
        if not piece:
            stack.append(i)
        elif stack:
            want[i] = stack.pop()
    got, counts, free, left = {}, {}, {}, {}
    size = -(-len(items) // parts) if items else 1
    for p, a in enumerate(range(0, len(items), size)):
        mate = packing.swept(np.array(items[a : a + size], bool))
        got |= {a + i: a + int(m) for i, m in enumerate(mate) if m >= 0}
        free[p] = [a + i for i, x in enumerate(items[a : a + size]) if not x and i not in set(mate.tolist())]
        left[p] = [a + i for i, x in enumerate(items[a : a + size]) if x and mate[i] < 0]
        counts[p] = (len(left[p]), len(free[p]))
    spans = packing.carried(counts)
    assert len(spans) <= 2 * parts
    for part, low, high, gap_part, gap in spans:
        got |= {left[part][k]: free[gap_part][gap - k + low] for k in range(low, high)}
    assert got == want


def distributions():
    rng = random.Random(1)
    yield "tiny", [rng.randint(1, 9) for _ in range(900)]
    yield "thirds", [22] * 500
    yield "uniform", [rng.randint(1, 64) for _ in range(700)]
    yield "middle", [rng.randint(16, 33) for _ in range(700)]
    yield "hot", [3] * 400 + [rng.randint(1, 63) for _ in range(400)]
    yield "one", [5]
    yield "full", [64] * 9


@pytest.mark.parametrize(("name", "lengths"), list(distributions()))
@pytest.mark.parametrize("rows", [90])
def test_rounds_are_as_good_as_best_fit(spark, monkeypatch, name, lengths, rows):
    monkeypatch.setattr(packing, "ROWS_A_PARTITION", rows)
    table = spark.createDataFrame([(i, i, 0, 0, x, 0) for i, x in enumerate(lengths)], "pid long, doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(spark, table, 64).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(lengths))
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    best = best_fit([x for x in lengths if x < 64], 64) + lengths.count(64)
    assert len(fill) <= best + 1


def test_packing_odd_rows(spark, odd, odd_rows, none, library):
    out = packing.pack_documents(spark, odd, PATH).collect()
    want = []
    for i, t, *_ in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k in range(-(-len(ids) // 1024)):
            size = (len(ids) - 1) % 1024 + 1 if k == 0 else 1024
            want.append((i, k, at, size, zlib.crc32(packed(ids[at : at + size]))))
            at += size
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    assert len(fill) == best_fit([r.length for r in out if r.length < 1024], 1024) + sum(r.length == 1024 for r in out)
    assert packing.pack_documents(spark, none, PATH).isEmpty()
