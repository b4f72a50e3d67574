"""Toxicity: a convolutional classifier over hashed word embeddings, in numpy.

Words (runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered) are hashed
into two tables of embeddings, once as a whole and once by their first ``STEM``
bytes, and stand for the sum of the two rows: an inflected form that no label has
shown yet still has its stem, and words that share one row differ in the other; filters over one, two and three words are
max-pooled over the whole text, and a logistic layer gives the score. As the input
of a filter is always a row of a table, filter tap times embedding is tabulated
once, and convolving is looking up and adding.

All labelled rows outside the held-out fold take part, equal texts once: four fifths of
them are learned from, the fifth that the hash of the text names sets a threshold for each
language, between the two ``LIMITS``, which the filter of the pipeline uses;
``predicted`` uses 0.5. All parameters start at random and learn from the labels alone, in
``ROUNDS``: the texts are dealt to shards, whose number grows with them, a task goes through a
shard in steps of ``BATCH`` texts, and the parameters of all shards are averaged. A shard's
steps are ``STEPS`` over all rounds at least, and each text is seen in each round. Nothing but
the text enters a score, and no labelled text reaches the driver.

Defined results: a null, empty or wordless text has all features 0 and so the score
of the bias alone; repeated rows give repeated results; null ids and languages stay
null, and a language without a threshold uses 0.5. Without labels of both kinds all
scores are 0 and nothing is rejected. An empty table gives no rows. Texts of any
length are scored whole, in slices of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.sampling import labelled
from tessera.llm.shared import documents, held_out, mapped, written
from tessera.runtime import discard, ship

BUCKET_BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
BUCKETS = 1 << BUCKET_BITS
#: Row of the padding that stands behind each text, as far as the widest filter reaches. The rows of
#: the second table follow those of the first, and then another row of padding.
PAD, SECOND, ROWS, REACH = BUCKETS, BUCKETS + 1, 2 * BUCKETS + 2, max(WIDTHS) - 1
STEPS, BATCH, RATE, WORD_RATE, DECAY = 360, 64, 0.01, 0.02, 1e-4
#: Rounds of learning; texts and bytes of bucket numbers that a shard has on average, at most.
ROUNDS, SHARD_ROWS, SHARD_BYTES = 3, 8192, 16 << 20
#: Rows of the embeddings that are averaged together, and steps of a score for the thresholds.
BLOCK, SCORE_STEPS = 1 << 12, 10_000
#: Range of the thresholds: few labels can put the best one next to 0 or 1, where new texts would fall on the wrong side.
LIMITS = (0.2, 0.8)
STEM = 4
#: Bytes that are hashed together, and words that are convolved together.
SLICE, WORDS = 1 << 20, 1 << 16
#: Rows of a batch that are hashed before they are scored.
ROWS_AT_ONCE = 512
#: Labelled rows of either kind that a language needs for a threshold of its own.
LEAST = 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_IN_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_power: dict[str, np.ndarray] = {}


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two buckets of each word, one above the other: a polynomial over its bytes, from differences of
    prefix sums modulo 2**64."""
    if len(_power.get("up", ())) < len(data) + 1:
        n = max(len(data) + 1, SLICE + 4096)
        _power["up"] = _powers(int(_BASE), n)
        _power["down"] = _powers(pow(int(_BASE), -1, 1 << 64), n)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * _power["up"][: len(data)], out=sums[1:])
    down = _power["down"][starts]
    whole, stem = ((sums[to] - sums[starts]) * down for to in (ends, np.minimum(ends, starts + STEM)))
    return (_mixed(whole) << np.uint64(BUCKET_BITS) | _mixed(stem)).astype(np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(64 - BUCKET_BITS)


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of all texts, and where each text's words begin and end among them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    found, places = [], []
    a, stop = int(offsets[0]), int(offsets[-1])
    while a < stop:
        b = min(a + SLICE, stop)
        while b < stop and _IN_WORD[data[b]] and _IN_WORD[data[b - 1]]:  # a slice ends outside a word
            more = np.flatnonzero(~_IN_WORD[data[b : min(b + 4096, stop)]])
            b = b + int(more[0]) if len(more) else min(b + 4096, stop)
        part = data[a:b]
        inside = _IN_WORD[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b)] - a  # texts that begin in the slice
        cuts = cuts[(cuts > 0) & (cuts < b - a)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        found.append(_hashes(part, starts, ends))
        places.append(starts + a)
        a = b
    if not found:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


@dataclass
class Model:
    """Embeddings (rows of zeros for padding), filters by width, their biases, and the logistic layer."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float

    def taps(self) -> list[list[np.ndarray]]:
        return [[(self.embedding @ f[k]).astype(np.float32) for k in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]


def rows_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two tables."""
    return (words >> BUCKET_BITS).astype(np.int32), (words & (BUCKETS - 1)).astype(np.int32) + SECOND


def padded(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both rows of all words with padding behind each text, one more at the end; starts and ends of the
    texts, alternating."""
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes + REACH) - REACH
    starts = ends - sizes
    first = np.full(int(ends[-1]) + REACH + 1, PAD, np.int32)
    second = np.full(len(first), ROWS - 1, np.int32)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(words)) * REACH, sizes)
    first[at], second[at] = rows_of(np.concatenate(words))
    return first, second, np.stack([starts, ends], 1).ravel()


def features(words: list[np.ndarray], taps: list[list[np.ndarray]], bias: list[np.ndarray], own: list[int] | None = None) -> np.ndarray:
    """Largest response of each filter in each text, at least 0, over windows that begin at its ``own`` first words."""
    one, two, edges = padded(words)
    if own is not None:
        edges[1::2] = edges[::2] + own
    out, n = [], len(one) - REACH
    for w, tap, b in zip(WIDTHS, taps, bias, strict=True):
        response = tap[0][one[:n]]
        response += tap[0][two[:n]]
        for k in range(1, w):
            response += tap[k][one[k : n + k]]
            response += tap[k][two[k : n + k]]
        # Without a word an edge pair is empty; reduceat then returns the element there, which is taken out below.
        top = np.maximum.reduceat(response, edges, axis=0)[::2]
        out.append(np.maximum(top + b, 0))
    result = np.concatenate(out, axis=1)
    result[edges[::2] == edges[1::2]] = 0
    return result


def score_words(ids: np.ndarray, bounds: np.ndarray, model: Model, taps: list[list[np.ndarray]]) -> np.ndarray:
    """Score of each text; texts are packed into slices, and a long one is spread over several that overlap."""
    owner, parts, own = [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for c in range(a, max(b, a + 1), WORDS):
            owner.append(i)
            parts.append(ids[c : min(b, c + WORDS + REACH)])
            own.append(min(b, c + WORDS) - c)
    pooled = np.zeros((len(bounds) - 1, FILTERS * len(WIDTHS)))
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= WORDS):
            size += len(parts[to])
            to += 1
        np.maximum.at(pooled, owner[at:to], features(parts[at:to], taps, model.bias, own[at:to]))
        at = to
    # Summed row by row: a product of matrices rounds a text's sum by its place among the others.
    return 1 / (1 + np.exp(-((pooled * model.weight).sum(1) + model.offset)))


def _start(rng: np.random.Generator) -> Model:
    """Random numbers: nothing is known of any word."""
    embedding = rng.normal(0, 0.1, (ROWS, DIM))
    embedding[[PAD, -1]] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
    return Model(embedding, filters, [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0)


def _params(m: Model) -> list[np.ndarray]:
    return [m.embedding, *m.filters, *m.bias, m.weight, np.array([m.offset])]


def _model(params: list[np.ndarray]) -> Model:
    n = len(WIDTHS)
    return Model(params[0], list(params[1 : 1 + n]), list(params[1 + n : 1 + 2 * n]), params[-2], float(params[-1][0]))


def _shares(n: int, positive: int) -> np.ndarray:
    """Weights with which both labels count alike."""
    return np.array([0.5 / max(1, n - positive), 0.5 / max(1, positive)]) * n


def fit(words: list[np.ndarray], y: np.ndarray, seed: int = 0, steps: int = STEPS) -> Model:
    """A model of these texts, from a random start."""
    rng = np.random.default_rng(seed)
    return learned(_start(rng), words, y, _shares(len(y), int(y.sum())), rng, steps)


def _windows(words: list[np.ndarray], m: Model) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each width: the largest response of each filter in each text, and the two rows of each word of its window. A long
    text is looked at ``WORDS`` at a time."""
    owner = [i for i, w in enumerate(words) for _ in range(0, max(len(w), 1), WORDS)]
    parts = [w[c : c + WORDS + REACH] for w in words for c in range(0, max(len(w), 1), WORDS)]
    own = np.array([min(len(w) - c, WORDS) for w in words for c in range(0, max(len(w), 1), WORDS)])
    out = [(np.full((len(words), FILTERS), -np.inf), *(np.full((len(words), FILTERS, w), pad, np.int32) for pad in (PAD, ROWS - 1))) for w in WIDTHS]
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= WORDS):
            size += len(parts[to])
            to += 1
        one, two, edges = padded(parts[at:to])
        seen = m.embedding[one] + m.embedding[two]
        n = len(one) - REACH
        for w, f, (best, first, second) in zip(WIDTHS, m.filters, out, strict=True):
            response = sum(seen[k : n + k] @ f[k] for k in range(w))
            for i, a, size in zip(owner[at:to], edges[::2], own[at:to], strict=True):
                if not size:
                    continue
                top = a + response[a : a + size].argmax(0)
                value = response[top, np.arange(FILTERS)]
                more = value > best[i]
                best[i][more] = value[more]
                where = top[more, None] + np.arange(w)
                first[i][more], second[i][more] = one[where], two[where]
        at = to
    return out


def learned(m: Model, words: list[np.ndarray], y: np.ndarray, share: np.ndarray, rng: np.random.Generator, steps: int, slower: float = 1.0) -> Model:
    """``m`` after some steps of Adam on the logistic loss, labels weighted by ``share``; through max pooling only the largest
    windows learn."""
    params = _params(m)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, order = 0, rng.permutation(len(words))
    while step < steps:
        for at in range(0, len(order), BATCH)[: steps - step]:
            rows = order[at : at + BATCH]
            grads = [np.zeros_like(p) for p in params]
            windows = _windows([words[r] for r in rows], m)
            x = np.concatenate([np.maximum(best + b, 0) for (best, _, _), b in zip(windows, m.bias, strict=True)], 1)
            p = 1 / (1 + np.exp(-(x @ m.weight + params[-1][0])))
            miss = (p - y[rows]) * share[y[rows].astype(int)] / len(rows)
            grads[-1][0] = miss.sum()
            grads[-2] += x.T @ miss
            back = miss[:, None] * m.weight * (x > 0)
            for i, (w, (_, one, two)) in enumerate(zip(WIDTHS, windows, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + len(WIDTHS) + i] += g.sum(0)
                for k in range(w):
                    pull = (g[:, :, None] * m.filters[i][k].T[None]).reshape(-1, DIM)
                    for table in (one[:, :, k], two[:, :, k]):
                        grads[1 + i][k] += np.einsum("rfd,rf->df", m.embedding[table], g)
                        np.add.at(grads[0], table.ravel(), pull)
            step += 1
            for j, (param, grad) in enumerate(zip(params, grads, strict=True)):
                grad += DECAY * param
                first[j] += 0.1 * (grad - first[j])
                second[j] += 0.01 * (grad**2 - second[j])
                param -= slower * (RATE if j else WORD_RATE) * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
            m.embedding[[PAD, -1]] = 0
        order = rng.permutation(len(words))
    m.offset = float(params[-1][0])
    return m


def thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str | None], counts: np.ndarray | None = None) -> dict[str | None, float]:
    """By language, the middle of the gap that separates the labels best (F1); 0.5 where rows are few. ``counts``: of rows alike."""
    out = {}
    counts = np.ones(len(y), np.int64) if counts is None else counts
    for lang in set(langs):
        own = np.array([x == lang for x in langs])
        s, at = np.unique(-scores[own], return_inverse=True)
        every = np.bincount(at, counts[own])
        toxic = np.bincount(at, counts[own] * (y[own] == 1))
        if min(toxic.sum(), (every - toxic).sum()) < LEAST:
            continue
        f1 = 2 * np.cumsum(toxic) / (np.cumsum(every) + toxic.sum())
        k = int(f1.argmax())
        below = -s[k + 1] if k + 1 < len(s) else 0.0
        out[lang] = float(np.clip((below - s[k]) / 2, *LIMITS))
    return out


def evidence(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """key, words, lang, target, fitted of the labelled texts, written; equal ones once, by the largest id: copies would count as
    evidence. ``fitted`` is False for the fifth that the thresholds come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                ids, bounds = buckets(part.column(0))
                words = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *part.columns[1:]], names=["words", "lang", "target", "doc_id"])

    rows = labelled(spark, docs.select("doc_id", "text", "lang"), sf_dir, "toxic").selectExpr("text", "lang", "target", "cast(doc_id AS long) AS doc_id")
    found = mapped(rows, run, "words binary, lang string, target int, doc_id long").withColumn("key", F.sha2("words", 256))
    once = found.groupBy("key").agg(F.any_value("words").alias("words"), F.max(F.struct("doc_id", "target", "lang")).alias("row"))
    fitted = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(5)) != 0
    return written(spark, once.select("key", "words", "row.lang", "row.target", fitted.alias("fitted")), "toxic-labels")


def _averaged(spark: SparkSession, rows: DataFrame, params: list[np.ndarray], share: np.ndarray, shards: int, number: int) -> list[np.ndarray]:
    """The parameters after a round of learning from ``params`` in each shard, averaged by block of numbers."""
    ship(spark)
    sent = spark.sparkContext.broadcast([p.astype(np.float32) for p in params])  # 4 MB whatever the corpus
    shapes = [p.shape for p in params]

    def learn(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("key")  # the order of arrival is no part of the result
        words = [np.frombuffer(w.as_py(), np.uint32) for w in group["words"]]
        y = group["target"].to_numpy().astype(np.int64)
        del group
        rng = np.random.default_rng([number, key[0].as_py()])
        steps = max(-(-len(words) // BATCH), -(-STEPS // ROUNDS))
        m = learned(_model([p.astype(float) for p in sent.value]), words, y, share, rng, steps, 0.5**number)
        table, rest = m.embedding.astype(np.float32), np.concatenate([p.ravel() for p in _params(m)[1:]]).astype(np.float32)
        blocks = [table[a : a + BLOCK].tobytes() for a in range(0, ROWS, BLOCK)] + [rest.tobytes()]
        return pa.table({"block": pa.array(range(len(blocks)), pa.int32()), "numbers": pa.array(blocks, pa.binary()), "n": pa.array([len(words)] * len(blocks), pa.int64()), "shard": pa.array([key[0].as_py()] * len(blocks), pa.int32())})

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for block, raw, n in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                sums = total.setdefault(block, [0.0, 0])
                sums[0] = sums[0] + np.frombuffer(raw, np.float32).astype(float) * n
                sums[1] += n
        out = [(s / n).astype(np.float32).tobytes() for s, n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], names=["block", "numbers"])

    dealt = F.pmod(F.xxhash64("key", F.lit(number + 2)), F.lit(shards)).cast("int")
    done = rows.select("key", "words", "target", dealt.alias("shard")).groupBy("shard").applyInArrow(learn, "block int, numbers binary, n long, shard int")
    met = mapped(done.repartition("block").sortWithinPartitions("block", "shard"), mean, "block int, numbers binary")
    blocks = {r.block: np.frombuffer(r.numbers, np.float32).astype(float) for r in written(spark, met, "toxic-model").toLocalIterator()}
    sent.destroy()
    flat = np.concatenate([blocks[i] for i in range(len(blocks))])
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])
    return [p.reshape(s).copy() for p, s in zip(np.split(flat, cuts[:-1]), shapes, strict=True)]


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[Model | None, dict[str | None, float]]:
    """Model and thresholds from all labelled rows of ``sf_dir``; None without labels of both kinds."""
    rows = evidence(spark, docs, sf_dir)
    fitted = rows.filter("fitted")
    n, positive, size = fitted.agg(F.count(F.lit(1)), F.sum("target"), F.sum(F.length("words"))).first()
    if not positive or positive == n:
        discard(rows)
        return None, {}
    shards = max(-(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    params = _params(_start(np.random.default_rng(0)))
    for number in range(ROUNDS):
        params = _averaged(spark, fitted, params, _shares(n, positive), shards, number)
    model = _model(params)
    sent = spark.sparkContext.broadcast((model, model.taps()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w.as_py(), np.uint32) for w in batch.column(0)]
            bounds = np.cumsum([0, *map(len, words)])
            scores = score_words(np.concatenate([np.zeros(0, np.uint32), *words]), bounds, *sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.round(scores * SCORE_STEPS) / SCORE_STEPS)], names=["lang", "target", "score"])

    judged = mapped(rows.filter("NOT fitted").select("words", "lang", "target"), run, "lang string, target int, score double")
    bins = judged.groupBy("lang", "target", "score").count().toArrow()  # at most 2 * SCORE_STEPS rows a language
    limits = thresholds(bins["score"].to_numpy(), bins["target"].to_numpy(), bins["lang"].to_pylist(), bins["count"].to_numpy())
    sent.destroy()
    discard(rows)
    return model, limits


def scored(spark: SparkSession, docs: DataFrame, model: Model | None, limits: dict[str | None, float]) -> DataFrame:
    """``docs`` and toxic_score, toxic_threshold of the language, and toxic_rejected, whether the score
    reaches it; columns of these names are replaced."""
    sent = spark.sparkContext.broadcast((model, model.taps()) if model else None)  # 12 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is None:
                scores = np.zeros(batch.num_rows)
            else:
                texts = batch.column(at_text)
                parts = [score_words(*buckets(texts.slice(a, ROWS_AT_ONCE)), *sent.value) for a in range(0, len(texts), ROWS_AT_ONCE)]
                scores = np.concatenate([np.zeros(0), *parts])
            limit = np.array([limits.get(x, 0.5) for x in batch.column(at_lang).to_pylist()], float)
            columns = [*batch.columns, pa.array(scores), pa.array(limit), pa.array(scores >= limit)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    added = {"toxic_score": T.DoubleType(), "toxic_threshold": T.DoubleType(), "toxic_rejected": T.BooleanType()}
    docs = docs.drop(*added)
    at_text, at_lang = docs.columns.index("text"), docs.columns.index("lang")
    names = [*docs.columns, *added]
    return mapped(docs, run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added.items())]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model, limits = trained(spark, docs, sf_dir)
    out = scored(spark, docs, model, limits)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxic_threshold").alias("lang_threshold"),
        F.col("toxic_rejected").alias("rejected"),
    )
