"""Quality rules: statistics of whole texts, and gradient-boosted trees over them.

The trees are fitted in numpy on a bounded sample of labelled rows (``PER_CLASS`` of
each label, never the held-out fold) and flattened into node arrays, which score
all rows of a batch and all trees in ``DEPTH`` vectorised steps. For the features
in ``FALLING`` the score never rises with the feature: splits that would break this
are rejected, and bounds are handed down the tree.

Defined results: a null, empty or wordless text has all statistics 0 and fails the
base rules, as any text of fewer than ``LEAST_WORDS`` words does. Repeated rows give
repeated results; a null doc_id stays null; an empty table gives no rows. Without
labels of both kinds only the base rules decide. Windows and lines are compared by
content over the whole text, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.sampling import labelled
from tessera.llm.shared import SPACES, documents, mapped

WINDOW, SYMBOLS, LEAST_WORDS, MOST_REPEATED = 8, "#*$%&|<>", 20, 30
PER_CLASS = 3000
TREES, DEPTH, BINS, RATE, LAMBDA = 40, 4, 32, 0.2, 2.0
#: Share of the good rows of the sample that may fall below the threshold.
GOOD_LOST = 0.002

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeated", "distinct", "top_word", "upper", "digits", "marks", "lines", "longest",
)
#: Features with which the score never rises.
FALLING = ("symbols", "dup_lines", "repeated", "top_word")

_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?;:\"'()[]{}=+~^_\\/@"


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of WINDOW word ids that occurs twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    # A hash finds windows that may repeat; equal windows have equal hashes, so none is missed.
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    rows = ids[at[:, None] + np.arange(WINDOW)]
    _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    found = at[count[which.ravel()] > 1]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + WINDOW, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The values of STATS and of FEATURES for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(STATS), (0.0,) * len(FEATURES)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(ids)
    size = len(raw)
    share = lambda drop: (size - len(raw.translate(None, drop))) / size
    return (n, chars, symbols, dup, repeat), (
        np.log(n), chars / n, symbols / n, dup / len(lines), repeat / n, len(number) / n**0.8, np.bincount(ids).max() / n,
        share(_UPPER), share(_DIGITS), share(_MARKS), len(lines) / n, float(max(map(len, words))),
    )


@dataclass
class Trees:
    """Nodes of all trees in one array each; a leaf is its own child. Row t of ``root`` starts tree t."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over histograms, with both labels weighted alike."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)  # bin b: x <= cuts[b]
    falling = [f in FALLING for f in FEATURES]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    nodes: list[list] = []
    roots = []
    raw = np.zeros(len(y))

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        found = (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = (np.clip(-a / (b + LAMBDA), low, high) for a, b in ((gl, hl), (gr, hr)))
            gain = -(gl * vl + 0.5 * (hl + LAMBDA) * vl**2) - (gr * vr + 0.5 * (hr + LAMBDA) * vr**2)
            gain[(hl < 1) | (hr < 1) | (falling[f] & (vr > vl))] = -np.inf
            b = int(gain.argmax())
            if gain[b] - max(0.0, 0.5 * total_g**2 / (total_h + LAMBDA)) > found[0]:
                found = (gain[b] - 0.5 * total_g**2 / (total_h + LAMBDA), (f, b, vl[b], vr[b]))
        return found[1]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + LAMBDA), low, high)) * RATE
        nodes.append([0, np.inf, me, me, value])
        split = best(rows, g, h, low, high) if depth < DEPTH and len(rows) > 1 else None
        if split is None:
            raw[rows] += value
            return me
        f, b, vl, vr = split
        goes = binned[rows, f] <= b
        middle = (vl + vr) / 2
        bounds = ((middle, high), (low, middle)) if falling[f] else ((low, high), (low, high))
        nodes[me][:2] = [f, cuts[f][b]]
        nodes[me][2] = grow(rows[goes], g, h, depth + 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes], g, h, depth + 1, *bounds[1])
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), (p - y) * weight, p * (1 - p) * weight, 0, -np.inf, np.inf))
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    trees = Trees(columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4], np.array(roots), 0.0)
    good = trees.score(x)[y == 1]
    trees.threshold = float(min(0.5, np.quantile(good, GOOD_LOST)))
    return trees


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Trees | None:
    """Trees from labelled rows; None without labels of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t.as_py()) for t in batch.column(0)]
            kept = pa.array([list(f) for s, f in values], pa.list_(pa.float64()))
            failed = pa.array([base_failed(s) for s, _ in values], pa.bool_())
            yield pa.RecordBatch.from_arrays([kept, failed, *batch.columns[1:]], names=["x", "failed", "target", "doc_id"])

    sample = labelled(spark, docs.select("doc_id", "text"), sf_dir, "quality", PER_CLASS).selectExpr("text", "target", "cast(doc_id AS long) AS doc_id")
    found = mapped(sample, run, "x array<double>, failed boolean, target int, doc_id long")
    rows = sorted((r for r in found.collect() if not r.failed), key=lambda r: (r.doc_id, r.x))
    y = np.array([r.target for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    return fit(np.array([r.x for r in rows]), y)


def base_failed(stats: tuple[int, ...]) -> bool:
    return stats[0] < LEAST_WORDS or 100 * stats[4] > MOST_REPEATED * stats[0]


def judged(spark: SparkSession, docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and quality_score per row of ``docs``."""
    sent = spark.sparkContext.broadcast(trees)  # TREES * 2 ** (DEPTH + 1) nodes at most
    schema = ", ".join(["doc_id long", *(f"{s} long" for s in STATS), "base_failed boolean", "kept boolean", "quality_score double"])
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t.as_py()) for t in batch.column(1)]
            x = np.array([f for _, f in values], float).reshape(len(values), len(FEATURES))
            failed = np.array([base_failed(s) for s, _ in values], bool)
            score = sent.value.score(x) if sent.value else np.ones(len(values))
            kept = ~failed & (score >= (sent.value.threshold if sent.value else 0))
            stats = [pa.array(c, pa.int64()) for c in zip(*(s for s, _ in values), strict=True)] if values else [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *stats, pa.array(failed), pa.array(kept), pa.array(score)], names=names)

    return mapped(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judged(spark, docs, trained(spark, docs, sf_dir))
