from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components, simhash
from tessera.llm.shared import keep_rows


def ref_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return simhash._signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


def groups(values):
    """Smallest index reachable over links of three bits or fewer, by union and find over all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(values, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3), strict=True):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(values))]


def near_values(rng, n, centres, flips, bits):
    out = []
    for _ in range(n):
        v = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            v ^= 1 << rng.randrange(bits)
        out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(8))
def test_forest_connects_what_all_pairs_connect(seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(rng.randint(1, 5))]
    values = near_values(rng, 1200, centres, rng.choice((3, 9, 20)), rng.choice((14, 24, 64)))
    u, v = simhash.forest(np.array(values, np.uint64), simhash.ALL)
    assert len(u) < len(values)
    assert simhash._roots(len(values), u, v).tolist() == groups(values)


@pytest.mark.parametrize("seed", range(3))
def test_links_over_partitions(spark, seed):
    rng = random.Random(seed)
    values = near_values(rng, 700, [rng.getrandbits(64) for _ in range(30)], 7, 64)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long").repartition(5)
    found = components.components(spark, simhash.links(nodes)).collect()
    roots = {r.node: r.root for r in found}
    got = [roots.get(simhash._signed(v), simhash._signed(v)) for v in values]
    want = groups(values)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cÄ\n\x85\x1c.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == ref_fingerprint(text)


def test_against_brute_force(spark, odd, odd_rows):
    out = simhash.near_duplicates(spark, odd).collect()
    fps = sorted({ref_fingerprint(r[1]) % (1 << 64) for r in odd_rows})
    of = dict(zip(fps, groups(fps), strict=True))
    ids = {}
    for i, t, *_ in odd_rows:
        ids.setdefault(of[ref_fingerprint(t) % (1 << 64)], []).append(i)
    want = sorted(((i, ref_fingerprint(t), min((x for x in ids[of[ref_fingerprint(t) % (1 << 64)]] if x is not None), default=None)) for i, t, *_ in odd_rows), key=repr)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in out), key=repr) == want
    rest = keep_rows(spark, odd, simhash.near_duplicates(spark, odd))
    assert rest.count() == len(ids) and rest.columns == odd.columns


def test_empty_table(spark, none):
    assert simhash.near_duplicates(spark, none).isEmpty()
