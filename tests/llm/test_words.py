from __future__ import annotations

import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import perplexity, words

TRUSTED = ["ab cd ab, cd.", "ab cd  É9\nab", "cd ab cd ef", "ab", None, ""]
ASKED = ["ab cd", "cd zz ab", "ZZ 77!", "É8 É9 ab cd ef", "", None, "ab cd", " \n", "x" * 60]


def tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[ \t\n\r\x0b\x0c]+|[^0-9A-Za-z\x80-\xff \t\n\r\x0b\x0c]", text.encode())


def real(text):
    return [t for t in tokens(text) if not t.isspace()]


def test_tokens_and_pairs_do_not_depend_on_pieces(monkeypatch):
    want = None
    for chunk in (1, 9, 1 << 20):
        monkeypatch.setattr(words, "CHUNK", chunk)
        got, seen = [], {}
        for piece, first in words.pieces(pa.array(["skip", *ASKED]).slice(1)):
            raw = [piece.data[a:b].tobytes() for a, b in zip(piece.start, piece.end, strict=True)]
            for t, i, k in zip(raw, piece.text, piece.words(), strict=True):
                assert seen.setdefault(t, k) == k
                got.append((first + int(i), t))
            assert len(piece.pairs()[0]) == piece.word.sum() + np.count_nonzero(piece.sizes)
        assert len(set(seen.values())) == len(seen)
        want = want or got
        assert got == want == [(i, t) for i, text in enumerate(ASKED) for t in tokens(text or "")]


def test_perplexity_against_a_plain_model(spark):
    """Interpolated Kneser-Ney over words by definition, with spelling below it."""
    text = lambda rows: spark.createDataFrame([(i, "en", t) for i, t in enumerate(rows)], "doc_id long, lang string, text string")
    counted = text(TRUSTED)
    got = {r.doc_id: r.perplexity for r in perplexity.scored(spark, text(ASKED), counted).collect()}
    log_p = perplexity.model(spark, counted, perplexity.token_counts).astype(float)

    def spelled(token):
        c, out = [0, 0, 0, *perplexity._CLASS[np.frombuffer(token, np.uint8)].tolist(), 0], 0.0
        for i in range(3, len(c)):
            code = ((c[i - 3] * 48 + c[i - 2]) * 48 + c[i - 1]) * 48 + c[i]
            out += log_p[code] - (np.log(np.sum(perplexity._CLASS == c[i])) if c[i] else 0)
        return out

    pairs = Counter()
    for t in filter(None, TRUSTED):
        w = ["<", *real(t), ">"]
        pairs.update(zip(w, w[1:], strict=False))
    single = Counter(y for _, y in pairs)

    def cut(table):
        n = [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            d = [0.5, 0.75, 0.9]
        else:
            y = n[0] / (n[0] + 2 * n[1])
            raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
            d = [min(max(x, 0.05), i - 0.05) for x, i in zip(raw, (1, 2, 3), strict=True)]
        return lambda v: d[min(v, 3) - 1] if v else 0

    one, two = cut(single), cut(pairs)

    def p1(y):
        n = sum(single.values())
        base = np.exp(log_p[0] if y == ">" else spelled(y))
        return (single[y] - one(single[y])) / n + sum(map(one, single.values())) / n * base

    def p2(x, y):
        after = [v for (a, _), v in pairs.items() if a == x]
        if not after:
            return p1(y)
        return (pairs[x, y] - two(pairs[x, y])) / sum(after) + sum(map(two, after)) / sum(after) * p1(y)

    for i, t in enumerate(ASKED):
        if not t:
            assert got[i] is None
            continue
        w = ["<", *real(t), ">"]
        total = sum(np.log(p2(x, y)) for x, y in zip(w, w[1:], strict=False)) + sum(spelled(k) for k in tokens(t) if k.isspace())
        assert got[i] == pytest.approx(np.exp(-total / (len(t.encode()) + len(tokens(t)) + 1)), rel=1e-6)


def test_words_of_the_same_classes_differ(spark):
    """Capitals and digits that were trusted are likelier than others of the same shape."""
    rows = [(1, "en", "NATO met in 1949"), (2, "en", "NATO met in 1949"), (3, "en", "QXZK met in 7302")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = {r.doc_id: r.perplexity for r in perplexity.scored(spark, docs, docs.filter("doc_id = 1")).collect()}
    assert out[1] == out[2] < out[3]


def test_weights_grow_with_the_words(spark):
    def rows(n):
        texts = spark.createDataFrame([(f"aaa{chr(97 + i % 26)}{chr(97 + i // 26)} bbb",) for i in range(n)], "text string")
        log_p = perplexity.model(spark, texts, perplexity.token_counts)
        return words.weights(spark, texts, perplexity.speller(spark, log_p), float(log_p[0]), perplexity.discounts)[0].count()

    assert rows(200) - rows(20) == 3 * 180  # each new word, its pair with the begin and its pair with the next word


def test_thresholds_part_the_labels(spark):
    """A trusted text that is repeated counts once, and the worst trusted text does not let the poor ones in."""
    good = [(1.0 + i / 100, i) for i in range(99)] + [(90.0, 99)] * 50
    poor = [(5.0 + i, 200 + i) for i in range(20)]
    rows = [("en", i, True, p) for p, i in good] + [("en", i, False, p) for p, i in poor] + [("de", 500, True, 3.0)]
    out = perplexity.limits(spark.createDataFrame(rows, "lang string, id long, good boolean, perplexity double")).collect()
    assert {(r.every, r.lang) for r in out} == {(False, "en"), (True, None)}
    assert all(1.98 < r.own < 5 for r in out)


def test_freed_arrays_go_back():
    """Also those that lie between others, after a large one was freed."""
    code = """
import numpy as np
from tessera.llm import words
words.lean()
held = lambda: int(open('/proc/self/statm').read().split()[1]) * 4096
np.ones(3 << 20)
arrays = [np.ones(1 << 18) for _ in range(60)]
full = held()
del arrays[::2]
assert full - held() > 50 << 20, (full, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=re.sub(r"/tests/.*", "", __file__))
