"""SimHash near-duplicates: pigeonhole blocks, exact verification, connected components.

A fingerprint has 64 bits in six blocks. Fingerprints that differ in at most three
bits agree in three blocks at least, so each one is listed under the twenty triples
of blocks, and all links appear within the lists. Equal fingerprints are one node
before that, whatever the number of copies.

A list is linked without its pairs leaving the task: what comes out is a spanning
forest, fewer links than members. A long list is split again, by triples of blocks
over the bits that its key leaves open, so that a group of near copies that holds a
third of all fingerprints is not compared pair by pair either.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle give one shingle of all of them. Repeated rows
share a component; a null ``doc_id`` stays null and never names a component unless
all its rows are null. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import KEY, documents, mapped, row_key, written

SHINGLE, SEED, BITS, NEAR = 3, 42, 64, 3
#: Blocks of a fingerprint, and how many of them a key joins; BLOCKS - NEAR always agree.
BLOCKS = 6
#: Shingles whose bits are spread out together.
STEP = 1 << 16
#: Members of a list up to which all pairs are compared in place.
DIRECT = 256


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the shingles' hashes, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    n = max(1, len(words) - SHINGLE + 1)
    last = [e - 1 for e in ends[SHINGLE - 1 :]] or [len(joined)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip([0, *ends], last, strict=False)])
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    ones = sum(np.unpackbits(rows[i : i + STEP], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, STEP))
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The key and fp per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=[*KEY, "fp"])

    return mapped(docs.select(*row_key(), "text"), run, "doc_id long, n_points long, content long, fp long")


def masks(open_bits: int) -> list[int]:
    """For each choice of BLOCKS - NEAR blocks of ``open_bits``, a mask of the bits in them."""
    at = [b for b in range(BITS) if open_bits >> b & 1]
    blocks = [sum(1 << b for b in part) for part in np.array_split(np.array(at, object), BLOCKS)]
    return [sum(c) for c in itertools.combinations(blocks, BLOCKS - NEAR)]


ALL = (1 << BITS) - 1
MASKS = masks(ALL)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of n nodes: labels go along the links and are shortened."""
    root = np.arange(n)
    while u.size:
        a, b = root[u], root[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up
    return root


def _close(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the few ``values[at]``, all pairs compared."""
    x = values[at]
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= NEAR, 1))
    return at[i], at[j]


def forest(values: np.ndarray, open_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links u, v (indices) that connect what the links of distinct ``values`` connect, fewer than members.

    ``values`` agree outside ``open_bits``. Every level leaves half of the open bits open, so it ends.
    """
    n = len(values)
    if n <= DIRECT:
        u, v = _close(values, np.arange(n))
    elif open_bits.bit_count() <= 16:
        u, v = _neighbours(values, open_bits)
    else:
        us, vs = [], []
        for mask in masks(open_bits):
            key = values & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
            for a, b in zip(edges, [*edges[1:], n], strict=True):
                if b - a > 1:
                    own = order[a:b]
                    p, q = forest(values[own], open_bits & ~mask)
                    us.append(own[p])
                    vs.append(own[q])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    root = _roots(n, u, v)
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def _neighbours(values: np.ndarray, open_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links where at most 16 bits are open: look up each way of changing up to three of them."""
    at = [b for b in range(BITS) if open_bits >> b & 1]
    order = np.argsort(values)
    kept = values[order]
    us, vs = [], []
    for k in range(1, NEAR + 1):
        for flip in itertools.combinations(at, k):
            other = values ^ np.uint64(sum(1 << b for b in flip))
            place = np.minimum(np.searchsorted(kept, other), len(kept) - 1)
            found = np.flatnonzero((kept[place] == other) & (other > values))
            us.append(found)
            vs.append(order[place[found]])
    return np.concatenate(us), np.concatenate(vs)


def links(nodes: DataFrame) -> DataFrame:
    """u, v: links that connect all fingerprints (distinct, ``fp``) within NEAR bits of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # parts of a list that may go on
        key = None

        def linked(part: list[np.ndarray], which: int) -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate(part)
            u, v = forest(values, ALL & ~MASKS[which])
            return values[u].view(np.int64), values[v].view(np.int64)

        def out(found: list) -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            which, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            if not len(fp):
                continue
            starts = np.flatnonzero((np.diff(which, prepend=which[0] - 1) != 0) | (np.diff(part, prepend=part[0]) != 0))
            ends = np.append(starts[1:], len(fp))
            found = []
            if key is not None and key == (which[0], part[0]):
                held.append(fp[: ends[0]])
            else:
                if held and sum(map(len, held)) > 1:
                    found.append(linked(held, key[0]))
                held = [fp[: ends[0]]]
            if len(starts) > 1:
                if sum(map(len, held)) > 1:
                    found.append(linked(held, which[0]))
                many = np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1
                found += [linked([fp[starts[i] : ends[i]]], which[starts[i]]) for i in many]
                held = [fp[starts[-1] :]]
            key = (which[-1], part[-1])
            if found:
                yield out(found)
        if held and sum(map(len, held)) > 1:
            yield out([linked(held, key[0])])

    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(MASKS)])
    listed = nodes.select("fp", F.explode(keys).alias("key")).select("key.which", "key.part", "fp")
    dealt = listed.repartition("which", "part").sortWithinPartitions("which", "part")
    return mapped(dealt, run, "u long, v long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Key, fp, component_id and kept per row of ``docs`` (doc_id, text); the row with the smallest id
    of a component stays, among rows of the same id the shorter text."""
    found = written(spark, fingerprints(docs), "simhash-fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY)
    nodes = written(spark, found.groupBy("fp").agg(F.min(first).alias("first")), "simhash-nodes")
    linked = components(spark, written(spark, links(nodes.select("fp")), "simhash-links"))
    named = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("keeper"))
    out = found.join(named.join(least, "root").select("fp", "keeper"), "fp")
    kept = F.col("keeper").eqNullSafe(first)
    return out.select(*KEY, "fp", F.col("keeper.doc_id").alias("component_id"), kept.alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
