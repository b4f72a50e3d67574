"""Word n-grams of the perplexity model: tokens and keys of texts, interpolated modified Kneser-Ney over words, and the join of both.

A token is a run of letters, digits and bytes outside ASCII, or any other single byte; runs of white space are spelled but
are no words of an n-gram. A word that was never counted is spelled: the model below the word counts gives any token a
probability by its bytes. Words and pairs of words have 64-bit keys.

A text's logarithm is a sum over its own words and pairs, since each level divides by what the level below gives:

    log p(y | x) = log p0(y) + log a + [y counted] u(y) + log b(x) + [xy counted] v(xy)

so a text's counts meet one table of (key, weight), in shards by key: what was not counted weighs nothing and needs no row.
The vocabulary, the pairs and the weights grow with the trusted text and are never collected or broadcast; what is broadcast is
a bitmap of bounded size that leaves out rows which would meet no weight. Both joins run in ``ROUNDS``, over pairs and over
rows of the documents, whose shuffles go before the next round begins: their place on disk is bounded, whatever the size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import mapped, release, written
from tessera.runtime import discard

#: Bytes and texts that are looked at together, and bytes whose counts are put together before they are sent; a longer text is
#: one piece. Bytes whose words get their keys together.
CHUNK, CHUNK_TEXTS, SENT = 1 << 20, 60_000, 2 << 20
KEYED = 1 << 18
#: Rounds of the joins of pairs with their words, and of documents with the weights.
ROUNDS = 3
#: Weights of a shard that more shards are made for, and of a task that are packed together.
SHARD_ROWS, PACK_ROWS = 1 << 21, 1 << 20
#: Bits of the map of counted keys, at most, as a power of two: 32 MB.
MAP_BITS = 28
#: Keys of what stands before a text and after it.
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_P = 0x5851F42D4C957F2D
_INVERSE = pow(_P, -1, 1 << 64)

#: Bytes from which an array has memory of its own that goes back when it is freed, and glibc's name for that.
OWN_BYTES, _MMAP_THRESHOLD = 1 << 20, -3

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 part of a word, 2 a token by itself
_KIND[list(b" \t\n\r\x0b\x0c")] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def lean() -> None:
    """Keep no freed arrays: else glibc raises its bound to the largest one freed, and holes between arrays stay with the worker."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(_MMAP_THRESHOLD, OWN_BYTES)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_kept = lru_cache(2)(lambda base: _powers(base, KEYED))


def _up_to(base: int, n: int) -> np.ndarray:
    return _kept(base)[:n] if n <= KEYED else _powers(base, n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _mixed(x * np.uint64(_P) + _mixed(y + BEGIN))


class Piece:
    """The tokens of some texts: ``data`` bytes; ``start``, ``end``, ``text`` of each token; ``word`` False for white space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.texts = data, len(offsets) - 1
        kind = _KIND[data]
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inner = offsets[:-1]
        begins[inner[inner < len(data)]] = True
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start, len(data))[1:]
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.word = kind[self.start] > 0
        self.sizes = np.diff(offsets)

    def words(self) -> np.ndarray:
        """Key of each token."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + KEYED, "right")))
            a, b = self.start[at], self.end[to - 1]
            begin, end = self.start[at:to] - a, self.end[at:to] - a
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((self.data[a:b].astype(np.uint64) + np.uint64(1)) * _up_to(_P, b - a), out=sums[1:])
            out[at:to] = (sums[end] - sums[begin]) * _up_to(_INVERSE, b - a)[begin]
            at = to
        return _mixed(out + (self.end - self.start).astype(np.uint64) * BEGIN)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, y and text of each pair of neighbours, from BEGIN to END."""
        key, at = self.words()[self.word], self.text[self.word]
        have = np.flatnonzero(self.sizes)
        y = np.insert(key, np.searchsorted(at, have, "right"), END)
        x = np.insert(key, np.searchsorted(at, have), BEGIN)
        return x, y, np.sort(np.concatenate([at, have]), kind="stable")


def pieces(texts: pa.Array, chunk: int | None = None) -> Iterator[tuple[Piece, int]]:
    """The texts, some at a time, and the number of the first."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    a, chunk = 0, chunk or CHUNK
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, "right")) - 1)
        b = min(b, a + CHUNK_TEXTS, len(texts))
        yield Piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a
        a = b


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def counted(texts: DataFrame) -> DataFrame:
    """x, y, c over all texts (column ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for piece, _ in pieces(batch.column(0)):
                x, y, _ = piece.pairs()
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)])
                c = np.diff(np.append(first, len(x)))
                yield pa.RecordBatch.from_arrays([_signed(x[first]), _signed(y[first]), pa.array(c, pa.int64())], names=["x", "y", "c"])

    return mapped(texts.select("text"), run, "x long, y long, c long").groupBy("x", "y").agg(F.sum("c").alias("c"))


def spelled(texts: DataFrame, spell) -> DataFrame:
    """y, p0 for each word of the texts: the logarithm of its probability by its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for piece, _ in pieces(batch.column(0)):
                key, at = np.unique(piece.words()[piece.word], return_index=True)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(spell(piece)[piece.word][at])], names=["y", "p0"])

    return mapped(texts.select("text"), run, "y long, p0 double").groupBy("y").agg(F.max("p0").alias("p0"))


def weights(spark: SparkSession, texts: DataFrame, spell, end: float, discounts) -> tuple[DataFrame, float, float]:
    """key, weight of all words and pairs, written; the logarithms that every token (a) and every text (b of BEGIN) has besides.

    ``spell`` and ``end``: the logarithms that a piece's tokens and the end of a text have below the counts.
    """
    pairs = written(spark, counted(texts), "word-pairs")
    below = pairs.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    below = written(spark, below, "word-counts")

    def cut(d: list[float]):
        return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])

    one, two = cut(discounts(below)), cut(discounts(pairs))
    total, mass = below.agg(F.sum("c"), F.sum(one)).first()
    if not total:
        return spark.createDataFrame([], "key long, weight float"), 0.0, 0.0
    a = mass / total
    contexts = written(spark, pairs.groupBy("x").agg(F.sum("c").alias("total"), (F.sum(two) / F.sum("c")).alias("b")), "word-contexts")
    bare = spelled(texts, spell).unionByName(spark.createDataFrame([(int(END.view(np.int64)), end)], "y long, p0 double"))
    p1 = (F.col("c") - one) / total + F.lit(a) * F.exp("p0")
    words = below.join(bare, "y").select("y", F.log(p1).alias("p1"), (F.log(p1) - F.lit(float(np.log(a))) - F.col("p0")).alias("u"))
    words = written(spark, words.join(contexts.withColumnRenamed("x", "y"), "y", "left"), "words")
    begin = contexts.filter(F.col("x") == int(BEGIN.view(np.int64))).first().b
    more = (F.col("c") - two) / F.col("total") / F.col("b")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (t.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([_signed(pair_key(x, y)), t.column(2)], names=["key", "weight"])

    single = words.select(F.col("y").alias("key"), (F.col("u") + F.coalesce(F.log("b"), F.lit(0.0))).cast("float").alias("weight"))
    done = written(spark, single, "word-weights")
    for number in range(ROUNDS):
        some = pairs.filter(F.pmod(F.xxhash64("x", "y"), F.lit(ROUNDS)) == number)
        seen = some.join(contexts, "x").join(words.select("y", "p1"), "y").select("x", "y", F.log1p(more * F.exp(-F.col("p1"))).cast("float").alias("weight"))
        done = done.unionByName(written(spark, mapped(seen, keyed, "key long, weight float"), "word-weights"))
    for part in (pairs, below, contexts, words):  # their place on disk is needed for the counts of the documents
        discard(part)
    return done, float(np.log(a)), float(np.log(begin))


def shards_of(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // SHARD_ROWS)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, the second bytes, ...: those that are mostly zero are small in a shuffle."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _whole(raw: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, len(raw) // wide).T).reshape(-1).view(kind)


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys by their distances."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_whole(raw, np.uint64), dtype=np.uint64)


_PACKED = "shard int, piece long, ids binary, n int, keys binary, runs binary, at binary, c binary"
_TABLE = "shard int, n int, keys binary, weights binary"
_GOT = "piece long, shard int, ids binary, at binary, sums binary"


def sharded(table: DataFrame, shards: int) -> DataFrame:
    """The weights of ``table`` (key, weight) packed by shard of the key: a row for each shard and ``PACK_ROWS`` of a task."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        key = np.concatenate([t.column(0).to_numpy().view(np.uint64) for t in held])
        weight = np.concatenate([t.column(1).to_numpy() for t in held])
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        bounds = np.append(np.searchsorted(key, _floors(shards)), len(key))
        rows = [(s, hi - lo, _deltas(key[lo:hi]), weight[lo:hi].tobytes()) for s, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if lo < hi]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "n", "keys", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, n = [], 0
        for t in batches:
            if t.num_rows:
                held.append(t)
                n += t.num_rows
            if n >= PACK_ROWS:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    return mapped(table, run, _TABLE)


def bitmap(spark: SparkSession, table: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each range of keys that has a weight (``table`` as of ``sharded``), at most 2 ** MAP_BITS; and how far a
    key is shifted to its bit.

    It only saves rows that would meet nothing; where it is full, all rows are sent.
    """
    rows = table.agg(F.sum("n")).first()[0] or 0
    size = min(max(16 * rows, 8).bit_length(), MAP_BITS)
    shift = 64 - size

    def run(rows: pa.Table) -> pa.Table:
        at = np.concatenate([_keys(raw.as_py()) for raw in rows["keys"]]) >> np.uint64(shift)
        low = int(at.min()) // 8 * 8
        own = np.zeros(int(at.max()) - low + 1, np.uint8)
        own[(at - np.uint64(low)).astype(np.int64)] = 1
        return pa.table({"low": [low // 8], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (size - 3), np.uint8)
    parts = written(spark, table.select("shard", "keys").groupBy("shard").applyInArrow(run, "low long, bits binary"), "word-bits")
    for r in parts.toLocalIterator():
        out[r.low : r.low + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    discard(parts)
    return out, shift


def packed(texts: DataFrame, shards: int, sent, shift: np.uint64) -> DataFrame:
    """Counts of the texts' words and pairs (columns id, text): a row for each piece and shard of keys. ``sent``: the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for piece, first in pieces(batch.column(1), SENT):
                x, y, at = piece.pairs()
                key, at = np.concatenate([y, pair_key(x, y)]), np.concatenate([at, at]).astype(np.uint16)
                spot = key >> shift
                have = (sent.value[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                key, at = key[have], at[have]
                order = np.argsort(key, kind="stable")  # a key's texts are in order already
                key, at = key[order], at[order]
                new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))[: len(key)]
                first_of = np.flatnonzero(new)
                c = np.diff(np.append(first_of, len(key))).astype(np.uint32)
                key, at = key[first_of], at[first_of]
                bounds = np.append(np.searchsorted(key, _floors(shards)), len(key))
                rows = []
                for s, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    part = key[lo:hi]
                    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: hi - lo])
                    runs = np.diff(np.append(begins, hi - lo)).astype(np.uint32)
                    named = ids[first : first + piece.texts].tobytes() if s == 0 else None
                    rows.append((s, number, named, piece.texts, _deltas(part[begins]), _planes(runs), _planes(at[lo:hi]), _planes(c[lo:hi])))
                number += 1
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
                names = [n.split()[0] for n in _PACKED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return mapped(texts.select("id", "text"), run, _PACKED)


def _floors(shards: int) -> np.ndarray:
    return np.array([s * (1 << 64) // shards for s in range(shards)], np.uint64)


def _joined(counts: pa.Table, table: pa.Table) -> pa.Table:
    lean()
    release()  # what the groups before left
    known = np.concatenate([np.zeros(0, np.uint64), *(_keys(raw.as_py()) for raw in table["keys"])])
    order = np.argsort(known, kind="stable")
    w = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(raw.as_py(), np.float32) for raw in table["weights"])])[order]
    known = known[order]
    out = []
    for i in range(counts.num_rows):
        r = {c: counts[c][i].as_py() for c in counts.column_names}
        keys = _keys(r["keys"])
        spot = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        got = np.where(known[spot] == keys, w[spot], 0.0) if len(known) else np.zeros(len(keys))
        each = np.repeat(got, _whole(r["runs"], np.uint32)) * _whole(r["c"], np.uint32)
        sums = np.bincount(_whole(r["at"], np.uint16), each, r["n"])
        at = np.flatnonzero(sums).astype(np.uint16)
        out.append((r["piece"], r["shard"], r["ids"], _planes(at), sums[at].tobytes()))
    columns = list(zip(*out, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["piece", "shard", "ids", "at", "sums"])


def _summed(parts: pa.Table) -> pa.Table:
    rows = sorted(parts.to_pylist(), key=lambda r: r["shard"])
    ids = np.frombuffer(rows[0]["ids"], np.int64)
    total = np.zeros(len(ids))
    for r in rows:
        total[_whole(r["at"], np.uint16)] += np.frombuffer(r["sums"], np.float64)
    return pa.table({"id": ids, "gain": total})


def gains(spark: SparkSession, texts: DataFrame, table: DataFrame) -> DataFrame:
    """id, gain: what the weights of a text's words and pairs add up to; one row for each id. ``table`` is deleted."""
    shards = shards_of(spark, table.count())
    packs = written(spark, sharded(table, shards), "word-shards")
    discard(table)
    bits, shift = bitmap(spark, packs)
    sent = spark.sparkContext.broadcast(bits)  # once: each has its file on every executor
    number = F.pmod(F.xxhash64(*[c for c in texts.columns if c != "text"]), F.lit(ROUNDS))
    done = []
    for i in range(ROUNDS):
        both = packed(texts.filter(number == i), shards, sent, np.uint64(shift)).groupBy("shard").cogroup(packs.groupBy("shard"))
        parts = both.applyInArrow(_joined, _GOT)
        done.append(written(spark, parts.groupBy("piece").applyInArrow(_summed, "id long, gain double"), "word-gains"))
    discard(packs)
    sent.destroy()
    return reduce(DataFrame.unionByName, done).groupBy("id").agg(F.max("gain").alias("gain"))
