"""Exact deduplication as a stateful stream.

The key of the state is a digest of the text without white space; the state of a
digest is the number of rows, and length, id and content locator of the row that
stays. It lives in RocksDB on the executors' disks and in the checkpoint in shared
storage, and never expires. Hits are then checked over the full bytes: for all rows of
a repeated digest the smallest and largest normalised text have to be the same; a
digest for which they differ is regrouped by the text itself.

With a ``state_dir`` the state is kept. Each run adds its digests to the one source of the
stream, and its normalised texts beside it, so that a later run can check its hits against
older rows; a locator is the number of the run and the row in it. ``group_size``, ``keep_id``
and ``kept`` then speak of all rows so far: a row of this run is kept if none so far is better,
and it may be better than one that an earlier run kept. Runs on one state follow each other;
they are not run at once. Without a ``state_dir`` texts are read from ``docs`` again, which has
to give the same rows then, as a table does.

Only digests pass through the shuffle of the stream. Texts are shuffled for
repeated digests alone (a broadcast bitmap, with ``BITS_EACH`` bits for each of them but
at most ``MOST_BITS``, keeps most others out; where it is too small more texts pass, with
the same results), and are combined before that shuffle, so that a group that holds a third
of all rows costs one row a task.

Defined results: a null text counts as empty; all texts without a visible
character form one group. Repeated ``doc_id``s are different rows, and exactly one
row of a group has ``kept``; a null ``doc_id`` loses against any other. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import KEY, documents, exists, fresh_path, row_key, stripped, written

#: Bits of the broadcast bitmap for each repeated digest, and at least and at most: 32 KB to 32 MB, as rows of 32,768 bits.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 28
ROW_BITS = 32_768

#: State on disk, with a bounded share of memory for all partitions of an executor together.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else megabytes are set aside for each partition
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def digests(docs: DataFrame, digest: Callable[[Column], Column], run: int = 0) -> DataFrame:
    """One row per row of ``docs`` with its normalised text; ``run`` and ``row`` tell repeated ids apart and locate the content."""
    norm = docs.select(F.lit(run).alias("run"), F.monotonically_increasing_id().alias("row"), *row_key(), stripped(F.col("text")).alias("norm"))
    return norm.withColumn("digest", digest(F.col("norm")))


NARROW = ["run", "row", *KEY, "digest"]
#: What locates a row.
PLACE = ["run", "row"]


def best() -> Column:
    """The largest is the row that stays: most code points, then smallest id, then first row."""
    return F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), (-F.col("run")).alias("neg_run"), (-F.col("row")).alias("neg_row"))


def run_stream(spark: SparkSession, table: str, schema: T.StructType, state_dir: str) -> DataFrame:
    """Feed all new files of ``table`` to the keyed state at ``state_dir``; return the state: digest, n, best."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(64 << 30)).parquet(table)
        state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(best()).alias("best"))
        query = (
            state.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", state_dir).start()
        )
        query.awaitTermination()
        rows = spark.read.format("statestore").load(state_dir)
        n, top = (F.col("value").getField(f.name) for f in rows.schema["value"].dataType.fields)
        return written(spark, rows.select(F.col("key").getField("digest").alias("digest"), n.alias("n"), top.alias("best")), "dedup-state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def repeated_texts(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """digest, norm of every row of ``texts`` whose digest is in ``repeated``, and few others; the rest stop before the shuffle."""
    bits = min(max(BITS_EACH * repeated.count(), LEAST_BITS), MOST_BITS)
    bit = F.pmod(F.xxhash64("digest"), F.lit(bits))
    bitmap = repeated.groupBy(F.floor(bit / ROW_BITS).alias("word")).agg(F.bitmap_construct_agg((bit % ROW_BITS).cast("int")).alias("bits"))
    at = (F.col("bit") % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = (
        texts.select("digest", "norm")
        .withColumn("bit", bit)
        .withColumn("word", F.floor(F.col("bit") / ROW_BITS))
        .join(F.broadcast(bitmap), "word")
        .filter(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at % 8)) != 0)
    )
    return near.select("digest", "norm")


def exact_dedup(
    spark: SparkSession, docs: DataFrame, state_dir: str | None = None, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """row, doc_id, n_points, content, keep_id, group_size, kept, digest per row of ``docs`` (doc_id, text).

    ``digest`` maps the normalised text to the key of the state; a weak one costs time, not correctness.
    """
    folder = state_dir or fresh_path(spark, "dedup")
    table, run = f"{folder}/digests", 0
    schema = digests(docs, digest).select(*NARROW).schema
    if state_dir and exists(spark, table):
        run = spark.read.schema(schema).parquet(table).agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
    texts = own = digests(docs, digest, run)
    if state_dir:
        own.write.mode("append").parquet(f"{folder}/texts")
        texts = spark.read.schema(own.schema).parquet(f"{folder}/texts")
        own = texts.filter(F.col("run") == run)
    own.select(*NARROW).write.mode("append").parquet(table)
    rows = spark.read.schema(schema).parquet(table).filter(F.col("run") == run)
    state = run_stream(spark, table, schema, f"{folder}/checkpoint")

    repeated = state.filter("n > 1").select("digest")
    if run:  # hits of this run; those among older rows were checked then
        repeated = written(spark, repeated.join(rows, "digest", "left_semi"), "dedup-repeated")
    ends = repeated_texts(texts, repeated).groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    collided = written(spark, ends.filter("low <> high").select("digest").join(repeated, "digest", "left_semi"), "dedup-collided")

    out = rows.join(state.select("digest", "n", "best"), "digest")
    if collided.isEmpty():
        return _result(out)
    # The rows of digests that different texts share, grouped by the text itself.
    wide = texts.join(collided, "digest", "left_semi")
    groups = wide.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.max(best()).alias("best"))
    regrouped = wide.filter(F.col("run") == run).join(groups, "norm")
    return _result(out.join(collided, "digest", "left_anti")).unionByName(_result(regrouped))


def _result(out: DataFrame) -> DataFrame:
    same = [(-F.col(p)).eqNullSafe(F.col(f"best.neg_{p}")) for p in PLACE]
    return out.select(
        "row",
        *KEY,
        (-F.col("best.neg_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (same[0] & same[1]).alias("kept"),
        "digest",
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY n DESC, doc_id) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
