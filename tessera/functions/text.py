"""Column expressions on text: trimming, tokens, identifiers, message checks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import ship

#: What an identifier is, and where one is split. Between the humps of camel case: lower or digit then upper, or before the last upper of a run.
IDENTIFIER = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: Runs of Unicode letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: Chinese characters, which are not separated by spaces.
HAN = "\u3005\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
MAX_MESSAGE_BYTES, MAX_QUERY_CHARS = 1000, 1000


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def words(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), 0), F.lower)


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IDENTIFIER), 0)


def identifier_parts(c: Column) -> Column:
    """Segments between the separators of one identifier."""
    return filled(F.split(c, r"[._/-]+"))


def camel_parts(c: Column) -> Column:
    return filled(F.split(c, CAMEL))


_RUN = re.compile(f"[{HAN}]+|(?:(?![{HAN}])[^\\W_])+")
_IDENTIFIER, _HUMP, _SEPARATORS = re.compile(IDENTIFIER), re.compile(CAMEL), re.compile("[._/-]+")


def normalised(text: str | None) -> str:
    """Form NFKC without white space at the ends; null counts as empty."""
    text = text or ""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).strip()


def words_of(text: str) -> Iterator[str]:
    """Runs of letters and digits; of a run of Chinese characters each two neighbours, a single one by itself."""
    for run in _RUN.findall(text):
        if len(run) > 1 and not run.isascii() and re.match(f"[{HAN}]", run):
            yield from (run[i : i + 2] for i in range(len(run) - 1))
        else:
            yield run


def spelled_out(identifier: str) -> list[str]:
    """An identifier whole, then each of its segments with the humps of that segment, in lower case."""
    out = [identifier]
    for segment in filter(None, _SEPARATORS.split(identifier)):
        out += [segment, *filter(None, _HUMP.split(segment))]
    return [x.lower() for x in out]


def search_tokens(text: str | None) -> list[str]:
    """Lower-case words of the text in form NFKC, then its identifiers spelled out. Repetition counts:
    a plain ASCII word appears four times, in documents and queries alike."""
    plain = normalised(text)
    return [*(w.lower() for w in words_of(plain)), *(x for i in _IDENTIFIER.findall(plain) for x in spelled_out(i))]


def tokenised(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by the array of its search tokens, as batches: Spark has neither NFKC nor bigrams."""
    return _per_text(df, column, T.ArrayType(T.StringType()), lambda texts: pa.array([search_tokens(t) for t in texts], pa.list_(pa.string())))


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` in Unicode form NFKC and trimmed; null stays null."""
    return _per_text(df, column, T.StringType(), lambda texts: pa.array([None if t is None else normalised(t) for t in texts], pa.string()))


def _per_text(df: DataFrame, column: str, kind: T.DataType, made) -> DataFrame:
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, column, made(batch.column(at).to_pylist()))

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, kind) if i == at else f for i, f in enumerate(df.schema.fields)]))


def message_error(c: Column) -> Column:
    """Why a chat message is refused, or null: blank, over 1000 bytes, or control characters but \\t \\n \\r."""
    return (
        F.when(c.isNull() | (strip(c) == ""), "message is empty")
        .when(F.octet_length(c) > MAX_MESSAGE_BYTES, "message too long")
        .when(~F.is_valid_utf8(c), "message must be valid UTF-8")
        .when(c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "message contains unsupported control character")
    )


def valid_query(c: Column) -> Column:
    """A search query holds 1 to 1000 characters after trimming."""
    return F.length(strip(c)).between(1, MAX_QUERY_CHARS)
