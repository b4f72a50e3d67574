"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces and the gaps of open sequences are tables in shared storage. Pieces are taken by classes of length, longest first. A
round range-sorts the pieces of a class and the gaps that may hold them by size, a gap before a piece of its size, and sweeps
over that order: a piece gets the smallest gap before it that is still free, which is its successor, so where several pieces
want one gap the longest has it and the others get the next. Each partition is swept by itself; gaps and pieces that it leaves
over are matched with those of the partitions before it by rank, from numbers of leftovers alone, which are two for each
partition. A gap that holds several pieces of the class stands in the order as often as that. Then the gaps shrink by what they
got, and the next round follows. Where pieces are left and no gap is, new sequences open: for a class of pieces of which up
to ``HALVES`` fit into a sequence, as many as they fill side by side; for shorter ones as many as their tokens fill.

Pieces of the whole capacity and those over half of it open sequences of their own without a round. Results were those of
best-fit decreasing or within 0.3 % of them on all distributions tried; tests hold them against it.

Defined results: a null or empty text is the end token alone; repeated rows are
packed once each; a null ``doc_id`` stays null; an empty table gives no rows.
Texts longer than a sequence are cut into full pieces behind a shorter first one.
"""

from __future__ import annotations

import base64
import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import UNEVEN, Memo, default_tokenizer
from tessera.llm.shared import documents, mapped, written

CAPACITY = 1024
#: The id behind every document.
END = 2
#: Rows of the sorted order that one partition of it holds, about.
ROWS_A_PARTITION = 500_000
#: Pieces of a sequence up to which the classes are those of 2, 3, ... pieces a sequence; below, each class reaches down to this part of its longest.
HALVES, REACH = 4, 8
#: Shorter pieces: a round that places less than this share of them opens sequences, and what is less than ``TAIL`` of all pieces
#: with a round gets as many as it fills side by side, which ends it.
SHARE, TAIL = 0.02, 0.002
#: What the numbers of sequences that open empty start from; pieces have smaller ones.
FIRST_EMPTY = 1 << 62
#: Words whose ids a worker remembers, twice as many at most: some 30 MB.
WORDS_KEPT = 75_000


class Pieces(Memo):
    """Space and word to packed ids."""

    def __init__(self, encode):
        super().__init__(WORDS_KEPT)
        self.encode = encode

    def compute(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """The ids of a tokenizer file, looked up word by word.

    ``tokenizer`` is the library's file; the ``.tiktoken`` file beside it has the same vocabulary as ranks
    and is read by a faster encoder. ``tests/llm`` hold both against each other.
    """

    def __init__(self, tokenizer: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(tokenizer, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(tokenizer.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.ordinary = encoding.encode_ordinary
        self.all = functools.partial(encoding.encode, allowed_special="all")
        self.pieces = Pieces(self.ordinary)

    def encode(self, text: str) -> bytes:
        if not text or any(map(text.__contains__, UNEVEN)) or text[-1] in " \n" or any(map(text.__contains__, self.special)):
            ids = self.all(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        ids = self.ordinary(first)
        return struct.pack(f"<{len(ids)}I", *ids) + b"".join(map(self.pieces.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def cut(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """pid, doc_id, piece, start, length, ids_crc32 for each piece of each document, its end token included; ``pid`` numbers
    the pieces with gaps, so that the number holds only for a table that was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        end = struct.pack("<I", END)
        pid = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = e.encode(text.as_py() or "") + end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    out.append((pid, i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    pid += 1
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pid", *PIECE])

    return mapped(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, "pid long, doc_id long, piece int, start long, length long, ids_crc32 long")


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def swept(is_piece: np.ndarray) -> np.ndarray:
    """For items in order, the place of the gap that each piece gets, else -1: the last one before it that is free.

    That is the matching of brackets, a gap opening and a piece closing: both stand at the same depth, next to each other
    among all that stand there.
    """
    step = np.where(is_piece, -1, 1)
    level = np.cumsum(step) + is_piece
    order = np.argsort(level, kind="stable")
    piece, depth = is_piece[order], level[order]
    met = np.flatnonzero(~piece[:-1] & piece[1:] & (depth[:-1] == depth[1:]))
    out = np.full(len(is_piece), -1)
    out[order[met + 1]] = order[met]
    return out


_ITEM = "size long, is_piece boolean, id long, room long"
_SWEPT = "part int, is_piece boolean, id long, size long, room long, seq long, spare long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of the order: pieces with seq and room of their gap, and numbers (``spare``) of gaps and pieces left over."""
    own = list(batches)
    if not own:
        return
    held = pa.Table.from_batches(own)
    is_piece = held["is_piece"].to_numpy(zero_copy_only=False).astype(bool)
    ids, room = held["id"].to_numpy(), held["room"].to_numpy(zero_copy_only=False)
    mate = swept(is_piece)
    got = mate >= 0
    free = ~is_piece
    free[mate[got]] = False
    left = is_piece & ~got
    spare = np.where(free, np.cumsum(free) - 1, np.cumsum(left) - 1)
    rows = np.flatnonzero(got | free | left)
    hit = got[rows]
    null = lambda x, empty: pa.array(x[rows], pa.int64(), mask=empty)
    columns = [
        pa.array(np.full(len(rows), TaskContext.get().partitionId()), pa.int32()), pa.array(is_piece[rows]), pa.array(ids[rows]),
        pa.array(held["size"].to_numpy()[rows]), null(np.where(got, room[mate], room), left[rows]), null(np.where(got, ids[mate], -1), ~hit), null(spare, hit),
    ]
    yield from pa.table(columns, names=[c.split()[0] for c in _SWEPT.split(", ")]).to_batches()


def carried(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which leftovers of different partitions belong together, by numbers of spare pieces and gaps of each partition.

    (part, from, to, part of the gaps, gap of the first): spare pieces of a partition get the last spare gaps before it,
    last first. The rows are at most twice the partitions.
    """
    open_: list[list[int]] = []  # part, spare gaps that are left of it
    out = []
    for part in sorted(counts):
        pieces, gaps = counts[part]
        at = 0
        while at < pieces and open_:
            n = min(pieces - at, open_[-1][1])
            out.append((part, at, at + n, open_[-1][0], open_[-1][1] - 1))
            at, open_[-1][1] = at + n, open_[-1][1] - n
            if not open_[-1][1]:
                open_.pop()
        if gaps:
            open_.append([part, gaps])
    return out


def wanted(sizes: dict[int, int], n: int, top: int, low: int) -> tuple[int, int]:
    """The largest gap that ``n`` pieces from ``low`` to ``top`` may get, and how often gaps up to it stand in the order.

    ``sizes``: gaps by size. Pieces get the smallest gaps that hold them, so once as many places as pieces hold the longest
    one, larger gaps stay untouched.
    """
    places, most, roomy = 0, 0, 0
    for size in sorted(x for x in sizes if x >= low and sizes[x]):
        here = sizes[size] * max(size // top, 1)
        places, most = places + here, size
        roomy += here if size >= top else 0
        if roomy >= n:
            break
    return most, places


def swept_round(spark: SparkSession, pieces: DataFrame, gaps: DataFrame, partitions: int, top: int, low: int, most: int, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame, dict, dict]:
    """One round: placed (pid, seq, offset), pieces left (pid, length), gaps (seq, size), numbers of both by size.

    ``pieces``: pid, length, from ``low`` to ``top``; gaps over ``most`` stay as they are.
    """
    times = F.greatest(F.floor(F.col("size") / top), F.lit(1)).cast("int")
    slots = gaps.filter(F.col("size").between(low, most)).withColumn("slot", F.explode(F.sequence(F.lit(1), times)))
    items = slots.select(F.least("size", F.lit(top)).alias("size"), F.lit(False).alias("is_piece"), F.col("seq").alias("id"), F.col("size").alias("room"))
    items = items.unionByName(pieces.select(F.col("length").alias("size"), F.lit(True).alias("is_piece"), F.col("pid").alias("id"), F.lit(None).cast("long").alias("room")))
    by = [F.desc("size"), F.asc("is_piece"), F.desc("room"), F.asc("salt")]
    order = items.withColumn("salt", F.xxhash64("id")).repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    found = written(spark, mapped(order.drop("salt"), _sweep, _SWEPT), "packing-swept")

    spare = found.filter("spare IS NOT NULL").groupBy("part").agg(F.count_if("is_piece").alias("p"), F.count_if(~F.col("is_piece")).alias("g"))
    counts = {r.part: (r.p, r.g) for r in spare.collect()}  # a row for each partition
    assigned = found.filter("seq IS NOT NULL").select("seq", F.col("id").alias("pid"), F.col("size").alias("length"))
    spare_pieces = found.filter("is_piece AND seq IS NULL")
    if spans := carried(counts):
        span = F.broadcast(spark.createDataFrame(spans, "part int, low long, high long, gap_part int, gap long"))  # two rows a partition at most
        inside = (F.col("spare") >= F.col("low")) & (F.col("spare") < F.col("high"))
        asked = spare_pieces.join(span, "part").filter(inside).select(
            F.col("id").alias("pid"), F.col("size").alias("length"), "gap_part", (F.col("gap") - F.col("spare") + F.col("low")).alias("gap_spare")
        )
        free = found.filter("NOT is_piece").select(F.col("part").alias("gap_part"), F.col("spare").alias("gap_spare"), F.col("id").alias("seq"))
        assigned = assigned.unionByName(asked.join(free, ["gap_part", "gap_spare"]).select("seq", "pid", "length"))

    # A sequence's own rows: its gap, and what it got, at most a capacity of them.
    none = F.lit(None).cast("long")
    rows = gaps.select("seq", none.alias("pid"), F.lit(0).cast("long").alias("length"), "size").unionByName(assigned.select("seq", "pid", "length", none.alias("size")))
    own = Window.partitionBy("seq")
    upto = own.orderBy(F.asc_nulls_first("pid")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(upto), F.lit(0))
    room, taken = F.max("size").over(own), F.sum("length").over(own)
    after = written(spark, rows.select("seq", "pid", "length", (F.lit(capacity) - room + before).alias("offset"), (room - taken).alias("size")), "packing-round")
    placed = after.filter("pid IS NOT NULL")
    left = spare_pieces.select(F.col("id").alias("pid"), F.col("size").alias("length"))
    left = left.join(placed.select("pid"), "pid", "left_anti") if spans else left
    # At most two rows for each length.
    many = after.groupBy(F.col("pid").isNull().alias("gap"), F.when(F.col("pid").isNull(), F.col("size")).otherwise(F.col("length")).alias("size")).count().collect()
    got, sizes = ({r.size: r["count"] for r in many if r.gap == gap and r.size} for gap in (False, True))
    return placed.select("pid", "seq", "offset"), left, after.filter("pid IS NULL AND size > 0").select("seq", "size"), got, sizes


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with ``pid`` and ``length`` from 1 to ``capacity``) and their sequence_id and offset."""
    many = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length
    alone = F.col("length") > capacity // 2
    gaps = pieces.filter(alone & (F.col("length") < capacity)).select(F.col("pid").alias("seq"), (F.lit(capacity) - F.col("length")).alias("size"))
    sizes = {capacity - x: n for x, n in many.items() if capacity // 2 < x < capacity}
    lengths = sorted(x for x in many if x <= capacity // 2)
    placed, opened, all_ = [], 0, sum(many[x] for x in lengths)
    while lengths:
        top = lengths[-1]
        each = capacity // top
        below = capacity // (each + 1) if each <= HALVES else top // REACH
        own = {x: many[x] for x in lengths if x > below}
        lengths = lengths[: len(lengths) - len(own)]
        left = pieces.filter((F.col("length") > below) & (F.col("length") <= top)).select("pid", "length")
        while n := sum(own.values()):
            most, places = wanted(sizes, n, top, min(own))
            got: dict[int, int] = {}
            if places:
                done, left, gaps, got, sizes = swept_round(spark, left, gaps, (n + places) // ROWS_A_PARTITION + 1, top, min(own), most, capacity)
                placed.append(done)
                own = {x: c - got.get(x, 0) for x, c in own.items() if c > got.get(x, 0)}
            if (rest := sum(own.values())) and (each <= HALVES or n - rest <= SHARE * n):
                aside = each <= HALVES or rest <= TAIL * all_
                new = -(-rest // each) if aside else -(-sum(x * c for x, c in own.items()) // capacity)
                empty = spark.range(FIRST_EMPTY + opened, FIRST_EMPTY + opened + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("size"))
                gaps, opened, sizes = gaps.unionByName(empty), opened + new, sizes | {capacity: new + sizes.get(capacity, 0)}
    own_ = pieces.filter(alone).select(*PIECE, F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not placed:
        return own_
    where = functools.reduce(DataFrame.unionByName, placed)
    return own_.unionByName(pieces.filter(~alone).join(where, "pid").select(*PIECE, F.col("seq").alias("sequence_id"), "offset"))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(spark, written(spark, cut(docs, tokenizer, capacity), "packing-pieces"), capacity)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir), default_tokenizer())
