"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

``Merges`` reads a tokenizer file and computes the lookahead that its merge list
needs. Rules apply in the order of the list; bytes that arrive later can only
change a token through a chain of rules that starts at the end of the buffer and
moves left by the left part of each rule. ``Merges._lookahead`` is the longest such
chain. So a token whose start is further from the end than that is final, and
``Transducer`` emits it and forgets its bytes: memory is one block plus the
lookahead, however long the input.

Every pre-token goes through a ``Transducer``; what ends it makes all of its tokens
final. The text comes in windows that end before white space, where a pre-token always
ends; where no white space is near, pre-tokens are found one after the other by their
places, and a long one is fed block by block, so no window grows with the text. Short
pre-tokens repeat a lot; ``Words`` remembers what the transducer emitted for them, up to a
fixed number of entries.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import documents, mapped

#: Characters of a text that are looked at together, and how far behind them white space is looked for.
WINDOW, REACH = 1 << 16, 1 << 12
#: Characters that are fed to a transducer at a time, at least; twice the lookahead if that is more.
BLOCK = 1024
#: Entries that ``Words`` keeps, and the longest pre-token among them, in characters.
WORDS, WORD_CHARS = 250_000, 48
NO_RULE = 1 << 30

#: The code points that Unicode calls white space.
WHITE = "\t-\r \x85\xa0  -     　"
#: White space that ``Codec`` leaves to the pattern: any but single spaces and line feeds inside a text.
UNEVEN = ["  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c not in " \n" and re.match(f"[{WHITE}]", c))]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for
    themselves, the others follow from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _class(major: str) -> str:
    """The inside of a character class with all code points of a general category (L or N)."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == major]
    runs = []
    for _, run in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        ends = [c for _, c in run]
        runs.append(f"{re.escape(chr(ends[0]))}-{re.escape(chr(ends[-1]))}")
    return "".join(runs)


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """What a pre-token is, and where a window may end."""
    letter, number = _class("L"), _class("N")
    token = (
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )
    return re.compile(token), re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


class Merges:
    """Vocabulary and merge list of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        spell = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spelling: list[bytes] = [b""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.spelling[i] = spell(token)
        for token, i in self.special.items():
            self.spelling[i] = token.encode()
        self.byte_id = [0] * 256
        for letter, b in alphabet.items():
            self.byte_id[b] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {a << 20 | b: n for n, (a, b, _) in reversed(list(enumerate(self.rules)))}
        self.product = [c for _, _, c in self.rules]
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Greatest distance from the end of the buffer at which a token can still change.

        ``reach[t]``: how far left a changed occurrence of token t can start, by the rules so far.
        """
        size = [len(s) for s in self.spelling]
        reach: dict[int, int] = {}
        most = 1
        for a, b, ab in self.rules:
            far = max(size[a] + size[b], reach.get(a, 0), size[a] + reach.get(b, 0))
            for token, d in ((a, far), (b, far - size[a]), (ab, far)):
                reach[token] = max(reach.get(token, 0), d)
            most = max(most, far)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Ids of ``data`` as a whole: always the earliest rule of the list, at its leftmost place."""
        ids = [self.byte_id[b] for b in data]
        return self._merge_short(ids) if len(ids) <= 96 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank, product = self.rank.get, self.product
        keys = [rank(a << 20 | b, NO_RULE) for a, b in zip(ids, ids[1:], strict=False)]
        while keys and (n := min(keys)) != NO_RULE:
            i = keys.index(n)
            ids[i : i + 2] = [new] = (product[n],)
            del keys[i]
            if i:
                keys[i - 1] = rank(ids[i - 1] << 20 | new, NO_RULE)
            if i < len(keys):
                keys[i] = rank(new << 20 | ids[i + 1], NO_RULE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for a block."""
        rank, end = self.rank.get, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(n, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (n := rank(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            n, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else end
            if j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = self.product[n], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (n := rank(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (n, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (n := rank(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (n, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]


class Transducer:
    """Bytes of one pre-token in, ids out as soon as no later byte can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        stable = len(self.held) - self.merges.lookahead
        if stable <= 0:
            return []
        out, at = [], 0
        for t in self.merges.merge(self.held):
            if (to := at + len(self.merges.spelling[t])) > stable:
                break
            out.append(t)
            at = to
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class Memo(dict):
    """A bounded memo: when it is full, what was used since the last time stays for another round."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.old = entries, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.compute(key)
            if len(key) > WORD_CHARS:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(Memo):
    """Pre-token to its packed ids, as the transducer emits them."""

    def __init__(self, merges: Merges):
        super().__init__(WORDS)
        self.merges, self.block = merges, max(BLOCK, 2 * merges.lookahead)

    def flow(self, text: str, a: int, b: int) -> Iterator[bytes]:
        """Packed ids of the pre-token ``text[a:b]``, block after block."""
        transducer = Transducer(self.merges)
        for i in range(a, b, self.block):
            if ids := transducer.feed(text[i : min(i + self.block, b)].encode()):
                yield packed_ids(ids)
        yield packed_ids(transducer.finish())

    def compute(self, word: str) -> bytes:
        return b"".join(self.flow(word, 0, len(word)))


class Pieces(Memo):
    """What stands between two single spaces to the packed ids of the first space and it."""

    def __init__(self, token: re.Pattern, words: Words):
        super().__init__(WORDS)
        self.token, self.words = token, words

    def compute(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.token.findall(" " + piece)))


class Codec:
    """Encoding and decoding with one tokenizer file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.token, self.cut = _patterns()
        self.words = Words(self.merges)
        self.pieces = Pieces(self.token, self.words)
        specials = sorted(self.merges.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def packed(self, text: str) -> Iterator[bytes]:
        """Little-endian 32-bit ids of ``text``, window after window."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.merges.special:
                yield packed_ids([self.merges.special[part]])
                continue
            at = 0
            while at < len(part):
                end = at + WINDOW
                if end >= len(part):
                    yield self._window(part[at:])
                    break
                if m := self.cut.search(part, end, min(end + REACH, len(part))):
                    yield self._window(part[at : m.start()])
                    at = m.start()
                    continue
                for m in self.token.finditer(part, at):  # no white space near: one pre-token after the other
                    yield from self.words.flow(part, *m.span()) if m.end() - m.start() > WORD_CHARS else [self.words[m[0]]]
                    if (at := m.end()) >= end:
                        break

    def _window(self, text: str) -> bytes:
        """Where white space is single spaces and line feeds between words, pre-tokens begin at
        each space, and the pieces between can be looked up whole."""
        if any(map(text.__contains__, UNEVEN)) or text[-1] in " \n":
            return b"".join(map(self.words.__getitem__, self.token.findall(text)))
        # At most WINDOW and REACH characters are split here.
        first, *pieces = text.split(" ")
        return b"".join(map(self.words.__getitem__, self.token.findall(first))) + b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.packed(text or ""))


class Decoder:
    """Ids in, text out; holds the up to three bytes of an unfinished character."""

    def __init__(self, spelling: list[bytes]):
        self.spelling, self.held = spelling, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.spelling.__getitem__, ids))
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a lead byte: is its character whole?
                keep = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
                break
            if b < 0x80:
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode(errors="replace")

    def finish(self) -> str:
        out, self.held = self.held.decode(errors="replace"), b""
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``, in constant memory a row.

    A null or empty text has no tokens and the digests of nothing; repeated rows give repeated
    results; a null doc_id stays null; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                n, a, b, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(c.merges.spelling)
                for ids in c.packed(text.as_py() or ""):
                    n += len(ids) // 4
                    a.update(ids)
                    b.update(back.feed(np.frombuffer(ids, "<u4").tolist()).encode())
                b.update(back.finish().encode())
                counts.append(n)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return mapped(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), default_tokenizer())
