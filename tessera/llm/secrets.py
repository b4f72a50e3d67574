"""Secret scans: fixed patterns, and guess cost of the values in credential contexts.

The patterns find assignments, access keys and hexadecimal runs. Beyond them, a
value that stands behind a credential word is a secret if it is hard to guess: a
dynamic program splits it into words, dates, repeats, keyboard walks and
brute-force spans so that the guesses needed are fewest, and ``GUESS_BITS`` binary
digits of guesses or more make a secret. Placeholders and prose cost few guesses and stay.

The words are those of the corpus itself, counted over all of its texts but the values in
question, and a word costs its rank. The guesser knows the ``DICTIONARY`` most frequent
ones, a parameter of the guess model, and a short fixed list of parts of passwords before
them. So two passes are made over the texts, one that counts words and one that looks for
spans; what is broadcast between them is bounded by that parameter (12 bytes a word).

A text runs through the patterns only if it contains what all their matches
contain; those tests are exact, and every text is tested as a whole.

Defined results: a null or empty text has no spans. Repeated rows give repeated
results; a null doc_id stays null; an empty table gives no rows. Values, repeats and walks have
any length; the program stops where no split can stay below ``GUESS_BITS`` any more, which a value
without long repeats reaches soon, whatever its length. Other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import documents, mapped, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched as a whole, so shorter ones never hide a longer one
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Credential words of any spelling, a separator, and a value up to white space, a quote, a comma or the like.
CONTEXT = re.compile(
    r"""((?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|private|access|signing)[_-]?key))"""
    r"""["']?\x20*(?:[:=]>?|\bis\b)\x20*["']?([^\s"'<>,;]{6,})""",
    re.ASCII,
)
#: What a match of CONTEXT or ASSIGN contains in lower case.
CREDENTIAL = tuple(w.encode() for w in ("pass", "pwd", "secret", "token", "credential", "auth", "key"))
SEPARATED = re.compile(rb"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|key)[\"']?\x20*(?:[:=]|is\b)")

GUESS_BITS = 36.0
#: Words of the corpus that a guesser knows, most frequent first, and how many bytes they have.
DICTIONARY, SHORTEST, LONGEST = 1 << 19, 3, 24
#: Different words that a task counts before it sends them on.
COUNTED = 100_000

#: Frequent parts of passwords and placeholders, most frequent first.
WORDS = (
    "password pass test admin example secret token changeme your user default none null true false undefined required string value"
    " key api the here login welcome letmein qwerty dragon master monkey shadow sunshine princess football baseball iloveyou hello"
    " root guest demo sample dummy placeholder redacted hidden removed unknown name my is and for new old love star summer winter"
    " spring autumn january february march april may june july august september october november december monday friday"
).split()
OWN = {w: i + 1 for i, w in enumerate(WORDS)}
#: Rows of keys, and runs that are typed like them.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LEET = str.maketrans("013457@$!", "oieastasi")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Letters of words, in bytes: those of ASCII in lower case, and what lies outside ASCII; all else is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@functools.cache
def _steps() -> frozenset[tuple[str, str]]:
    """Pairs of keys that follow each other in a row, either way, or touch across two rows."""
    pairs = {(r[i], r[i + 1]) for r in ROWS for i in range(len(r) - 1)}
    for upper, lower in zip(ROWS[:3], ROWS[1:4], strict=True):
        start = 1 if upper is ROWS[0] else 0
        pairs |= {(upper[i + start], lower[i]) for i in range(min(len(lower), len(upper) - start))}
    return frozenset(pairs | {(b, a) for a, b in pairs})


def _kind(c: str) -> int:
    """1 lower case, 2 upper case, 4 digit (each of ASCII), 0 anything else."""
    return 0 if not c.isascii() else 1 if c.islower() else 2 if c.isupper() else 4 if c.isdigit() else 0


#: Binary digits of a letter or digit in a span that mixes the kinds of a mask.
MIXED = [math.log2(max(26 * (m & 1) + 26 * (m >> 1 & 1) + 10 * (m >> 2), 1)) for m in range(8)]


def _spread(c: str) -> float:
    """Binary digits that brute force spends on one character at most, in a span that mixes all kinds."""
    return MIXED[7] if _kind(c) else math.log2(33 if c.isascii() else 1000)


def _brute(part: str) -> float:
    """Binary digits of brute force over the kinds that ``part`` mixes."""
    kinds = [_kind(c) for c in part]
    mask = functools.reduce(int.__or__, kinds, 0)
    return sum(MIXED[mask] if k else _spread(c) for k, c in zip(kinds, part, strict=True))


class Ranks:
    """Ranks of words: the fixed ones first, then those of the corpus. A word is known by a hash of 64 bits."""

    def __init__(self, hashes: bytes = b"", ranks: bytes = b""):
        self.hashes, self.ranks = array("Q", hashes), array("I", ranks)

    @classmethod
    def of(cls, words: dict[str, int]) -> Ranks:
        """Of a dictionary by counts: the most frequent word comes first; equally frequent ones share the last of their ranks."""
        return cls.of_counts(np.array([_name(w.encode()) for w in words], np.uint64), np.array(list(words.values()), np.int64))

    @classmethod
    def of_counts(cls, names: np.ndarray, counts: np.ndarray) -> Ranks:
        order = np.argsort(names)
        ranks = len(counts) - np.searchsorted(np.sort(counts), counts[order])
        return cls(names[order].tobytes(), ranks.astype(np.uint32).tobytes())

    def of_word(self, word: str) -> int | None:
        if word in OWN:
            return OWN[word]
        if not SHORTEST <= len(word) or not len(self.hashes):
            return None
        at = bisect.bisect_left(self.hashes, h := _name(word.encode()))
        return len(OWN) + self.ranks[at] if at < len(self.hashes) and self.hashes[at] == h else None


def _name(raw: bytes) -> int:
    """A hash of 64 bits: two checksums of 32, the second over the bytes from the back."""
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], len(raw) * 0x9E3779B1 & 0xFFFFFFFF)


NO_RANKS = Ranks()


def _word(part: str, ranks: Ranks = NO_RANKS) -> float | None:
    """Rank of a word, with ASCII in lower case, or of what it stands for in look-alikes; capitals cost, inside it most."""
    plain = part.translate(LOWER)
    rank, extra = ranks.of_word(plain), 0.0
    if rank is None and (spelt := plain.translate(LEET)) != plain:
        rank, extra = ranks.of_word(spelt), 2.0
    if rank is None:
        return None
    case = 0.0 if part == plain else 1.0 if part in (plain.capitalize(), plain.upper()) else float(len(part))
    return math.log2(rank + 1) + extra + case


_DATE = re.compile(r"(?:(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2})|((?:19|20)\d\d))$")


def _date(part: str) -> float | None:
    m = _DATE.match(part) if 4 <= len(part) <= 10 and part[0].isdigit() and part.isascii() else None
    if not m:
        return None
    if m[9]:
        return math.log2(120)
    a, b = (int(m[3]), int(m[4])) if m[1] else (int(m[5]), int(m[7]))
    if not (1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31) or m[1] and not 1900 <= int(m[1]) <= 2100:
        return None
    return math.log2(365 * 120) + (2.0 if m[2] or m[6] else 0.0)


def _once(part: str, ranks: Ranks) -> float:
    """Least cost of a part that is repeated: by brute force, or whole as a word, date or walk."""
    whole = [_brute(part), _date(part)]
    if len(part) >= SHORTEST:
        whole += [_word(part, ranks), next((c for j, c in _walks(_keys(part), 0) if j == len(part)), None)]
    return min(c for c in whole if c is not None)


def _keys(value: str) -> str:
    """The keys that are pressed, without shift."""
    return value.lower().translate(SHIFTED) if len(value.lower()) == len(value) else value


#: Binary digits of a step of a walk in the direction of the last one, and in another.
AHEAD, TURN = 0.3, 1.6


def _walks(keys: str, i: int) -> Iterator[tuple[int, float]]:
    """Ends and costs of walks from ``i``: keys that follow each other or touch; each turn of direction costs."""
    step, cost, way = _steps(), math.log2(47) + 1, None
    for j in range(i + 1, len(keys)):
        if (keys[j - 1], keys[j]) not in step:
            return
        now = ord(keys[j]) - ord(keys[j - 1])
        cost, way = cost + (AHEAD if now == way else TURN), now
        if j - i >= 2:
            yield j + 1, cost


def _longest_period(limit: float) -> int:
    """Characters that a repeated part can have below ``limit``: a walk straight on costs least for each."""
    return max(LONGEST, int(limit / AHEAD) + 1)


def guess_bits(value: str, ranks: Ranks = NO_RANKS, limit: float = math.inf) -> float:
    """Least binary digits of guesses over all ways to split ``value``, or ``inf`` where that is ``limit`` or more.

    Two brute-force spans never touch. A segment costs a binary digit besides, but for brute force.
    """
    n = len(value)
    if not n:
        return 0.0
    keys = _keys(value)
    best = np.full(n + 1, math.inf)  # up to here, with a word, date, repeat or walk at the end
    best[0] = 0.0
    period = np.zeros(n + 1, np.int64)  # of the repeat that is the best way here, else 0
    brute = [math.inf] * 8  # the same with a brute-force span at the end, by the kinds that it may mix
    longest = n // 2 if limit == math.inf else min(n // 2, _longest_period(limit))
    known: dict[str, float] = {}  # least cost of a part as a word or date
    stops: dict[int, int] = {}  # where the stretch with a period ends that was looked at last
    farthest = 0

    def named(part: str) -> float:
        if part not in known:
            known[part] = min((c for c in (_word(part, ranks) if len(part) >= SHORTEST else None, _date(part)) if c is not None), default=math.inf)
        return known[part]

    for i in range(n):
        closed = float(best[i])
        here = min(closed, *brute)
        if here >= limit:
            if i >= farthest:
                return math.inf  # nothing reaches further
            brute = [math.inf] * 8
            continue
        kind, alone = _kind(value[i]), _spread(value[i])
        brute = [min(closed, brute[m]) + (MIXED[m] if kind else alone) if m & kind == kind else math.inf for m in range(8)]
        farthest = max(farthest, i + 1)
        found = []
        for j, cost in _walks(keys, i):
            if here + cost >= limit:
                break
            found.append((j, cost))
        found += [(j, cost + 1) for j in range(i + SHORTEST, min(n, i + LONGEST) + 1) if (cost := named(value[i:j])) < limit]
        for j, cost in found:
            if here + cost < best[j]:
                best[j], period[j] = here + cost, 0
                farthest = max(farthest, j)
        # A repeat costs its period once, and how often. A part that repeats a shorter one itself is worth it only as a word or
        # date. Where the best way here ends with the same part repeated, the longer repeat from further back is never dearer.
        shorter = whole = 0
        for size in range(1, min(longest, (n - i) // 2) + 1):
            if value[i] != value[i + size]:
                continue
            again = shorter and size % shorter == 0 and 2 * size <= whole
            if again and size > LONGEST:
                continue
            if not again and i + 2 * size > stops.get(size, 0):
                if not value.startswith(value[i : i + size], i + size):
                    continue
                stops[size] = _stop(value, i, size)
            part = value[i : i + size]
            times = (whole if again else stops[size] - i) // size
            if not shorter:
                shorter, whole = size, times * size
            if size == 1 and times < 3 or period[i] == size and closed <= here and value[i - size : i] == part:
                continue
            once = here + (named(part) if again else _once(part, ranks)) + 1
            if once >= limit:
                continue
            first = 3 if size == 1 else 2
            ends = slice(i + first * size, i + times * size + 1, size)
            cost = once + np.log2(np.arange(first, times + 1))
            better = cost < best[ends]
            best[ends][better], period[ends][better] = cost[better], size
            farthest = max(farthest, i + times * size)
    out = min(float(best[n]), *brute)
    return out if out < limit else math.inf


def _stop(value: str, i: int, size: int) -> int:
    """Where the stretch from ``i`` ends in which each character equals that ``size`` places on, with these."""
    a, step = i, 1 << 10
    while value[a : a + step] == value[a + size : a + size + step] and a + size < len(value):
        a, step = a + step, min(step * 2, 1 << 20)
    a = min(a, len(value) - size)
    while a + size < len(value) and step:
        if a + size + step <= len(value) and value[a : a + step] == value[a + size : a + size + step]:
            a += step
        else:
            step >>= 1
    return a + size


_HEX_TABLE = bytes(ord("x") if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = b"x" * LEAST_HEX


def _credential(low: bytes) -> bool:
    """Whether a text in lower case may hold a match of CONTEXT or ASSIGN."""
    return any(w in low for w in CREDENTIAL) and SEPARATED.search(low) is not None


def _words_in(text: str) -> list[bytes]:
    """Words of a text without the values that stand behind credential words."""
    raw = text.encode()
    if _credential(raw.lower()):
        raw = ASSIGN.sub(" ", CONTEXT.sub(" ", text)).encode()
    return raw.translate(_LETTERS).split()


def dictionary(spark: SparkSession, docs: DataFrame, size: int = DICTIONARY) -> Ranks:
    """The ``size`` most frequent words of all texts at most: all that have at least a count that so few words have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            own = [(_name(w), n) for w, n in held.items() if SHORTEST <= len(w) <= LONGEST]
            names = np.array([w for w, _ in own], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(_words_in(text.as_py() or ""))
                if len(held) >= COUNTED:
                    yield out()
                    held.clear()
        yield out()

    counts = mapped(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(spark, counts, "words")
    # Words by steps of their counts: some hundreds of rows whatever the corpus.
    step = F.floor(F.log2("n") * 16).alias("step")
    known, least = 0, 0
    for r in counts.groupBy(step).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        known += r.words
        if known > size:
            break
        least = r.least
    else:
        least = 1
    if not least:
        return NO_RANKS
    found = counts.filter(F.col("n") >= least).toArrow()  # at most ``size`` rows
    return Ranks.of_counts(found["word"].to_numpy().view(np.uint64), found["n"].to_numpy())


def spans(text: str | None, ranks: Ranks = NO_RANKS) -> list[tuple[int, int, int]]:
    """start, kind (a place in KINDS), end of all spans, in code points, by start and then kind."""
    if not text:
        return []
    raw = text.encode()
    found = []
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if _HEX_RUN in raw.translate(_HEX_TABLE):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if _credential(raw.lower()):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        found += [(m.start(2), 3, m.end(2)) for m in CONTEXT.finditer(text) if guess_bits(m[2], ranks, GUESS_BITS) >= GUESS_BITS]
    return sorted(found)


def _listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts by kind, digest of the pattern spans, and all spans, per row of ``docs`` (doc_id, text)."""
    sent = spark.sparkContext.broadcast(dictionary(spark, docs))  # 12 bytes a word, DICTIONARY words at most
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [spans(t.as_py(), sent.value) for t in batch.column(1)]
            base = [[s for s in found if s[1] < 3] for found in all_]
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)]
            sha = pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, sha, pa.array(map(_listed, all_), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return mapped(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, schema)


def redact_text(text: str | None, mark: str = "[SECRET]", ranks: Ranks = NO_RANKS) -> str | None:
    """``text`` with each stretch that spans cover replaced by ``mark``; unchanged without spans."""
    if not (found := spans(text, ranks)):
        return text
    out, at, start, end = [], 0, found[0][0], found[0][2]
    for a, _, b in [*found[1:], (len(text) + 1, 0, 0)]:
        if a <= end:
            end = max(end, b)
            continue
        out += [text[at:start], mark]
        at, start, end = end, a, b
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame, size_column: str | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, and the code points of changed texts in
    ``size_column``; other columns and all rows stay."""
    sent = spark.sparkContext.broadcast(dictionary(spark, docs))
    at = docs.columns.index("text")
    at_size = docs.columns.index(size_column) if size_column else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redact_text(t, ranks=sent.value) for t in old]
            out = batch.set_column(at, "text", pa.array(new, pa.string()))
            if at_size is not None:
                sizes = [n if a is b else len(b) for a, b, n in zip(old, new, batch.column(at_size).to_pylist(), strict=True)]
                out = out.set_column(at_size, size_column, pa.array(sizes, batch.schema.field(at_size).type))
            yield out

    return mapped(docs, run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, documents(spark, sf_dir))
