r"""Chat formatting at token level.

A turn becomes TURN role BODY text END, where the capitals are reserved ids beyond
the tokenizer's own and role and text are encoded on their own, so no merge crosses
a boundary and no text can yield a reserved id. A control string inside a text gets
a backslash behind its first character (one that already has some gets one more),
which reads back exactly. Where a turn lies in its conversation, and which tokens
count for the loss, are prefix sums over the lengths of the segments.

Turns are encoded where they are read. Those of a conversation are then sorted and
pass one task as a stream with constant state, so a conversation of any length is
never held in memory; one digest over a conversation cannot be taken in parallel.

Defined results: a null text or role is empty. Turns are ordered by turn, nulls
first, and rows with the same turn by role and text; repeated rows count each. A
null conv_id is a conversation of its own. No rows give no conversations. A text
of any length is one segment. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import Decoder, codec, default_tokenizer
from tessera.llm.shared import mapped

#: Control strings of the template, in the order of their reserved ids.
TURN, BODY, END = CONTROLS = ("<|turn|>", "<|body|>", "<|end|>")
#: Strings that other templates or tokenizers treat as control.
FOREIGN = ("<s>", "</s>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]")
#: First character, backslashes so far, and rest of a control string.
INSIDE = r"([<\[])(\\*)(/?s>|\|(?:turn|body|end|endoftext|im_start|im_end)\|>|/?INST\])"
_INSIDE, _ESCAPED = re.compile(INSIDE), re.compile(INSIDE.replace(r"(\\*)", r"\\(\\*)"))
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _INSIDE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def encode_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, text, and the packed ids of the segments between the reserved ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            role, text = (pa.array([c.encode(escape(x.as_py())) for x in batch.column(i)], pa.binary()) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, role, text], names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    plain = turns.selectExpr("cast(conv_id AS long) AS conv_id", "cast(turn AS long) AS turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    return mapped(plain, run, "conv_id long, turn long, role string, text string, role_ids binary, text_ids binary")


def assemble(role_ids: list[bytes], text_ids: list[bytes], is_loss: list[bool], reserved: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of consecutive turns, loss mask, and the start of each turn."""
    spliced = [np.array([reserved + i], "<u4") for i in range(3)]
    segments, counted = [], []
    for role, text, loss in zip(role_ids, text_ids, is_loss, strict=True):
        segments += [spliced[0], np.frombuffer(role, "<u4"), spliced[1], np.frombuffer(text, "<u4"), spliced[2]]
        counted += [False, False, False, loss, False]
    ends = np.cumsum([len(s) for s in segments])
    starts = ends - [len(s) for s in segments]
    change = np.zeros(int(ends[-1]) + 1, np.int64)
    on = np.flatnonzero(counted)
    np.add.at(change, starts[on], 1)
    np.add.at(change, ends[on], -1)
    return np.concatenate(segments), np.cumsum(change)[:-1].astype(bool), starts[::5]


def formatted(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, start, ids, loss: each turn's tokens and mask, and where it starts in its conversation."""
    return _streamed(turns, tokenizer, read_back=False)


def digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """What reads back from the formatted tokens, a row a conversation."""
    return _streamed(turns, tokenizer, read_back=True)


class _Conversation:
    """What has been read back of one conversation so far."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, ids: np.ndarray, mask: np.ndarray, reserved: int, spelling: list[bytes]) -> None:
        """Parse whole turns out of ``ids``; the loss text is what ``mask`` covers."""
        marks = np.flatnonzero(ids >= reserved)
        for t, b, e in marks.reshape(-1, 3):
            role, text = (self._text(ids[a:z], spelling) for a, z in ((t + 1, b), (b + 1, e)))
            self.turns += 1
            self.chars += sum(map(len, (*CONTROLS, role, text)))
            self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            if (under := mask[t : e + 1]).any():
                said = unescape(self._text(ids[t : e + 1][under], spelling))
                self.loss_chars += len(said)
                self.loss.update(said.encode())

    @staticmethod
    def _text(ids: np.ndarray, spelling: list[bytes]) -> str:
        d = Decoder(spelling)
        return d.feed(ids.tolist()) + d.finish()

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TOKENS = "conv_id long, turn long, start long, ids array<int>, loss array<boolean>"


def _streamed(turns: DataFrame, tokenizer: str, read_back: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = codec(tokenizer).merges
        reserved = len(merges.spelling)
        none = object()
        key, state, offset = none, _Conversation(), 0
        for batch in batches:
            convs, numbers, roles, role_ids, text_ids = (batch.column(i).to_pylist() for i in range(5))
            out, a = [], 0
            while a < len(convs):
                b = next((i for i in range(a, len(convs)) if convs[i] != convs[a]), len(convs))
                if key is none or convs[a] != key:
                    if read_back and key is not none:
                        out.append(state.row(key))
                    key, state, offset = convs[a], _Conversation(), 0
                ids, mask, starts = assemble(role_ids[a:b], text_ids[a:b], [r == LOSS_ROLE for r in roles[a:b]], reserved)
                if read_back:
                    state.read(ids, mask, reserved, merges.spelling)
                else:
                    ends = [*starts[1:].tolist(), len(ids)]
                    for n, s, e in zip(numbers[a:b], starts.tolist(), ends, strict=True):
                        out.append((key, n, offset + s, ids[s:e].tolist(), mask[s:e].tolist()))
                offset += len(ids)
                a = b
            if out:
                yield _batch(out, read_back)
        if read_back and key is not none:
            yield _batch([state.row(key)], read_back)

    encoded = encode_turns(turns, tokenizer)
    dealt = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(dealt.select("conv_id", "turn", "role", "role_ids", "text_ids"), run, READ if read_back else TOKENS)


def _batch(rows: list[tuple], read_back: bool) -> pa.RecordBatch:
    long, string = pa.int64(), pa.string()
    kinds = [long, long, string, long, string, long] if read_back else [long, long, long, pa.list_(pa.int32()), pa.list_(pa.bool_())]
    names = [x.split(" ")[0] for x in (READ if read_back else TOKENS).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


#: A conversation whose texts are control strings of another template.
TRICKY = "SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(turns.unionByName(spark.sql(TRICKY)), default_tokenizer())


_ESCAPED_SQL = f"length(regexp_replace({{}}, '{INSIDE}', '\\1\\\\\\2\\3', 'g'))"

OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_ESCAPED_SQL.format("role")} + {_ESCAPED_SQL.format("text")} + {sum(map(len, CONTROLS))}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
