"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over words and pairs of words (``words``); its vocabulary grows with the trusted text, and its counts and
weights stay in shards, where the counts of the documents meet them. Below the words lies a spelling model over classes of
UTF-8 bytes, ``ORDER`` at a time, which gives every token that was never counted a probability, in any language; white space
is spelled only. It has at most ``CLASSES ** ORDER`` n-grams whatever the corpus and is a table of 21 MB. A byte is as likely
as any other of its class. Counts of both come from the trusted texts but two fifths: each task sums its own, Spark adds
them up in shards, and joins the shards with the totals of their contexts and with the next lower order, which counts
distinct left neighbours. The discounts follow from the counts of counts of each order.

Perplexity is taken over bytes, ends of tokens and the end of the text. The threshold of a language is where labelled texts
of the fifth ``fold`` = 1, which is never counted, part best into trusted and poor ones, each text once; beyond it a document
is dropped. The held-out fifth (``fold`` = 0) is used for neither.

Defined results: a null or empty text has no perplexity and is not kept; a language
with fewer than ``LABELS`` texts of either label there (null included) uses the threshold over all languages;
with fewer of these, a quantile of the trusted ones; without any, all texts but empty ones are kept; where nothing is counted every class is as likely as any other
and perplexity is ``CLASSES``. Repeated rows give repeated results; a null doc_id is never trusted; an
empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.shared import documents, fold, mapped, written

CLASSES, ORDER = 48, 4
#: Class of the boundary before a text.
START = 0
#: Labelled texts of each kind, kept out of the counts, that a threshold needs; steps of a perplexity to a natural logarithm.
LABELS, STEPS = 10, 1000
#: With fewer labels: quantile of the trusted perplexities up to which documents are kept, and the sketch's accuracy.
QUANTILE, ACCURACY = 0.998, 20_000
#: Trusted ids up to which they are broadcast (8 bytes each); beyond, the texts are joined by id in a shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes that are looked at together.
SLICE = 1 << 20


def _classes() -> np.ndarray:
    """Class of each byte: 26 letters, upper case, digits, white space, marks, and eight for what lies outside ASCII."""
    out = np.full(256, 39, np.int32)  # any other control or symbol
    out[list(b" \t\n\r\x0b\x0c")] = 1
    out[97:123] = np.arange(2, 28)
    out[65:91] = 28
    out[48:58] = 29
    for i, c in enumerate(b".,;:!?'-"):
        out[c] = 30 + i
    out[list(b"\"()[]{}")] = 38
    out[128:] = 40 + np.arange(128) % 8
    return out


_CLASS = _classes()
#: Logarithm of the probability of a byte within its class.
_WITHIN = -np.log(np.maximum(np.bincount(_CLASS, minlength=CLASSES), 1))


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of all n-grams of the texts, a slice at a time; texts in the slice; where each begins in it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    for a in range(int(offsets[0]), int(offsets[-1]), SLICE):
        b = min(a + SLICE, int(offsets[-1]))
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b)
        begins = offsets[first:last]  # of texts, the first perhaps before the slice
        back = max(int(begins[0]), a - ORDER + 1)
        at = np.arange(first, last)[np.diff(np.append(begins, offsets[last])) > 0]
        own = np.maximum(offsets[at], a)
        c = _CLASS[data[back:b]]
        codes = c[a - back :].copy()
        for k in range(1, ORDER):
            before = np.full(b - a, START, np.int32)
            have = min(a - back, k)
            before[k - have :] = c[a - back - have : len(c) - k]
            for j in range(k):  # the first k places of a text have fewer than k bytes before them
                place = offsets[at] + j - a
                before[place[(place >= 0) & (place < np.minimum(offsets[at + 1], b) - a)]] = START
            codes += before * CLASSES**k
        yield codes, at, own - a


def counts(texts: DataFrame) -> DataFrame:
    """code, c over all texts (column ``text``): summed in each task, then by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            for codes, _, _ in slices(batch.column(0)):
                found, c = np.unique(codes, return_counts=True)
                total[found] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["code", "c"])

    return mapped(texts.select("text"), run, "code long, c long").groupBy("code").agg(F.sum("c").cast("long").alias("c"))


def discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = table.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def model(spark: SparkSession, texts: DataFrame, count: Callable[[DataFrame], DataFrame] = counts) -> np.ndarray:
    """Natural logarithm of the probability of each n-gram's last class after the others."""
    orders = {ORDER: written(spark, count(texts), "ngram-counts")}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct classes that stand to the left
        lower = orders[k + 1].groupBy((F.col("code") % CLASSES**k).alias("code")).agg(F.count(F.lit(1)).alias("c"))
        orders[k] = written(spark, lower, "ngram-counts")
    dense = np.full(1, 1 / CLASSES)
    below = None
    for k in range(1, ORDER + 1):
        d = discounts(orders[k])
        table = orders[k].withColumn("context", F.floor(F.col("code") / CLASSES))
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = table.groupBy("context").agg(F.sum("c").alias("total"), F.sum(cut).alias("mass"))
        suffix = (F.col("code") % CLASSES ** (k - 1)).alias("suffix")
        joined = table.join(contexts, "context").select("code", suffix, ((F.col("c") - cut) / F.col("total")).alias("own"), (F.col("mass") / F.col("total")).alias("left"))
        if below is None:
            joined = joined.select("code", (F.col("own") + F.col("left") / CLASSES).alias("p"))
        else:
            joined = joined.join(below, "suffix").select("code", (F.col("own") + F.col("left") * F.col("q")).alias("p"))
        seen = written(spark, joined, "ngram-probabilities")
        below = seen.select(F.col("code").alias("suffix"), F.col("p").alias("q"))
        # At most CLASSES ** k rows reach the driver; what was not seen backs off to the lower order.
        weight = np.ones(CLASSES ** (k - 1))
        got = contexts.select("context", (F.col("mass") / F.col("total")).alias("left")).toArrow()
        weight[got["context"].to_numpy()] = got["left"].to_numpy()
        dense = (weight[:, None] * np.resize(dense, (CLASSES ** (k - 1), CLASSES))).ravel()
        got = seen.toArrow()
        dense[got["code"].to_numpy()] = got["p"].to_numpy()
    return np.log(dense).astype(np.float32)


def token_codes(piece: words.Piece) -> np.ndarray:
    """Codes of the bytes of each token and of its end, which is START; nothing before a token counts."""
    c = np.insert(_CLASS[piece.data], piece.end, START)
    codes, before = c.copy(), np.ones(len(c), bool)
    for k in range(1, ORDER):
        back = np.zeros(len(c), np.int32)
        back[k:] = c[:-k]
        before &= back != START
        codes += np.where(before, back, START) * CLASSES**k
    return codes


def token_counts(texts: DataFrame) -> DataFrame:
    """code, c over the tokens of all texts (column ``text``); the end of a text is an empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.lean()
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            for piece, _ in words.pieces(batch.column(0)):
                found, c = np.unique(token_codes(piece), return_counts=True)
                total[found] += c
                total[0] += np.count_nonzero(piece.sizes)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["code", "c"])

    return mapped(texts.select("text"), run, "code long, c long").groupBy("code").agg(F.sum("c").cast("long").alias("c"))


def speller(spark: SparkSession, log_p: np.ndarray) -> Callable[[words.Piece], np.ndarray]:
    """What gives the logarithm of the probability of each token of a piece by its bytes."""
    sent = spark.sparkContext.broadcast(log_p)  # 4 * CLASSES ** ORDER bytes
    within = _WITHIN if np.ptp(log_p) else np.zeros(CLASSES)

    def spell(piece: words.Piece) -> np.ndarray:
        if not len(piece.start):
            return np.zeros(0)
        codes = token_codes(piece)
        each = sent.value[codes] + within[codes % CLASSES]
        return np.add.reduceat(each, piece.start + np.arange(len(piece.start)))

    return spell


def scored(spark: SparkSession, docs: DataFrame, counted: DataFrame) -> DataFrame:
    """doc_id, lang, id, n_bytes, perplexity (null for empty texts) per row of ``docs``, by the model of ``counted``."""
    log_p = model(spark, counted, token_counts)
    spell, end = speller(spark, log_p), float(log_p[0])
    table, every, begin = words.weights(spark, counted, spell, end, discounts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.lean()
        for batch in batches:
            total, size, events = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for piece, first in words.pieces(batch.column(3)):
                own = slice(first, first + piece.texts)
                by = lambda x, p=piece: np.bincount(p.text, x, p.texts)
                total[own] = by(spell(piece)) + end + begin + every * (by(piece.word) + 1)
                size[own] = piece.sizes
                events[own] = piece.sizes + by(None) + 1
            arrays = [*batch.columns[:3], pa.array(size), pa.array(events), pa.array(total)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "id", "n_bytes", "events", "total"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("id"), "text")
    bare = mapped(plain, run, "doc_id long, lang string, id long, n_bytes long, events long, total double")
    both = bare.join(words.gains(spark, plain.filter("text <> ''"), table), "id", "left")
    perplexity = F.when(F.col("n_bytes") > 0, F.exp(-(F.col("total") + F.coalesce("gain", F.lit(0.0))) / F.col("events")))
    return both.select("doc_id", "lang", "id", "n_bytes", perplexity.alias("perplexity"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL AND coalesce(toxic, 0) = 0")
    return good.select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()


def poor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter("quality = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("poor_id")).distinct()


def limits(rows: DataFrame) -> DataFrame:
    """lang, own: the threshold of each language (all languages under null ``every``) from rows of lang, id, good, perplexity.

    A text counts once for each label. The threshold is halfway, in logarithms, between two neighbouring perplexities, where
    the share of good texts kept plus the share of poor ones dropped is greatest. Both labels are counted in steps of
    ``STEPS`` to a natural logarithm, so no task holds a language's texts.
    """
    once = rows.groupBy("lang", "id", "good").agg(F.min("perplexity").alias("perplexity"))
    step = F.floor(F.log("perplexity") * STEPS).alias("step")
    by_lang = once.select(F.lit(False).alias("every"), "lang", "good", step)
    total = once.groupBy("id", "good").agg(F.min("perplexity").alias("perplexity"))
    both = by_lang.unionByName(total.select(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang"), "good", step))
    bins = both.groupBy("every", "lang", "step").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("p"))
    part = Window.partitionBy("every", "lang")
    upto = part.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select(
        "every", "lang", "step", F.sum("g").over(part).alias("n_good"), F.sum("p").over(part).alias("n_poor"),
        F.sum("g").over(upto).alias("kept_good"), F.sum("p").over(upto).alias("kept_poor"), F.lead("step").over(part.orderBy("step")).alias("next"),
    ).filter(f"n_good >= {LABELS} AND n_poor >= {LABELS}")
    gain = F.col("kept_good") / F.col("n_good") - F.col("kept_poor") / F.col("n_poor")
    place = F.exp((F.col("step") + F.coalesce("next", F.col("step")) + 1) / (2 * STEPS))
    return bins.groupBy("every", "lang").agg(F.max_by(place, F.struct(gain, F.col("step"))).alias("own"))


def judged(spark: SparkSession, docs: DataFrame, ids: DataFrame, poor: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept per row of ``docs``; ``ids`` name the trusted ones, ``poor`` the poor."""
    docs = docs.select("doc_id", "lang", "text")
    ids = written(spark, ids, "trusted-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    trusted = docs.join(side, F.col("doc_id").cast("long") == F.col("trusted_id"), "left_semi")
    found = written(spark, scored(spark, docs, trusted.filter(fold(F.col("doc_id")) > 1)), "perplexities")
    apart = found.filter(F.col("perplexity").isNotNull() & (fold(F.col("doc_id")) == 1))
    known = apart.join(ids, apart.doc_id == ids.trusted_id, "left_semi").withColumn("good", F.lit(True))
    if poor is not None:
        known = known.unionByName(apart.join(poor, apart.doc_id == poor.poor_id, "left_semi").withColumn("good", F.lit(False)))
    found_limits = written(spark, limits(known), "thresholds")
    by_lang = found_limits.filter("NOT every").select("lang", "own")
    overall = found_limits.filter("every").agg(F.first("own")).first()[0]
    if overall is None:  # too few labels of either kind
        overall = known.filter("good").groupBy("id").agg(F.min("perplexity").alias("perplexity")).agg(F.percentile_approx("perplexity", QUANTILE, ACCURACY)).first()[0]
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    kept = F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))))
    return found.join(F.broadcast(by_lang), "lang", "left").select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, documents(spark, sf_dir), trusted_ids(spark, sf_dir), poor_ids(spark, sf_dir))
