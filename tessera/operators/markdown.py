"""Markdown documents (path, text) to lines, blocks and chunks.

Parsing and packing are sequential within a document and run as batches over whole
documents; identifiers, orders, links and checks are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.config import IndexContract
from tessera.functions import markdown as md
from tessera.functions.ids import sha256, stable_id
from tessera.runtime import ship

HEADINGS = "array<struct<level:int,text:string,line:int>>"
LINE_SCHEMA = "path string, line int, text string, role string"
BLOCK_SCHEMA = f"path string, section int, heading_path {HEADINGS}, block int, kind string, text string, line_start int, line_end int"
PIECE_SCHEMA = (
    f"path string, section int, chunk_order int, heading_path {HEADINGS}, text string, line_start int, line_end int, has_code boolean, token_count int"
)


def _per_document(docs: DataFrame, schema: str, rows: Callable[[str, str], Iterator[dict]]) -> DataFrame:
    """Rows made from each document; a null text holds nothing."""
    ship(docs.sparkSession)
    empty = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(p, t or "")]
            if out:
                yield from pa.Table.from_pylist(out, schema=empty).to_batches()

    return docs.select("path", "text").mapInArrow(run, schema)


def _path(path: tuple[md.Heading, ...]) -> list[dict]:
    return [{"level": h.level, "text": h.text, "line": h.line} for h in path]


def line_roles(docs: DataFrame) -> DataFrame:
    """Every line with its 1-based number and role; headings and blanks inside a fence are ``fenced``."""
    return _per_document(docs, LINE_SCHEMA, lambda p, t: ({"path": p, "line": n, "text": x, "role": r} for n, x, r in md.lines(t)))


def headings(lines: DataFrame) -> DataFrame:
    """path, line, level, title of the heading lines."""
    part = lambda i: F.regexp_extract("text", f"^{md.HEADING.pattern}", i)
    return lines.filter("role = 'heading'").select("path", "line", F.length(part(1)).alias("level"), F.trim(part(2)).alias("title"))


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks with their section and kind; table-of-contents marks are left out."""

    def rows(path: str, text: str) -> Iterator[dict]:
        for s, section in enumerate(md.sections(text)):
            for b, x in enumerate(section.blocks):
                yield {"path": path, "section": s, "heading_path": _path(section.path), "block": b, "kind": x.kind, "text": x.text, "line_start": x.first, "line_end": x.last}

    return _per_document(docs, BLOCK_SCHEMA, rows)


def section_id(document_id: Column, path: Column) -> Column:
    """Of a heading path; a path without headings is the root. A heading's line is part of it."""
    spelled = F.array_join(F.transform(path, lambda h: F.concat_ws(":", h["level"].cast("string"), h["line"].cast("string"), h["text"])), "/")
    return stable_id("section", document_id, F.when(F.size(path) == 0, "root").otherwise(spelled))


def embedding_text(path: Column, body: Column) -> Column:
    titles = F.array_join(F.transform(path, lambda h: h["text"]), " > ")
    with_path = F.concat(F.lit(md.PATH_LABEL), titles, F.lit("\n\n" + md.BODY_LABEL), body)
    return F.when(F.size(path) == 0, F.concat(F.lit(md.BODY_LABEL), body)).otherwise(with_path)


def chunks(docs: DataFrame, contract: IndexContract | None = None, count: Callable[[str], int] = len) -> DataFrame:
    """All chunks with identifiers, order and links. ``count`` measures text in tokens (characters by default)."""
    c = contract or IndexContract()
    soft, hard = c.soft_limit_tokens, c.hard_limit_tokens

    def rows(path: str, text: str) -> Iterator[dict]:
        section = {}
        for i, x in enumerate(md.pieces(text, count, soft, hard)):
            n = section.setdefault(x.path, len(section))
            yield {
                "path": path, "section": n, "chunk_order": i, "heading_path": _path(x.path), "text": x.text,
                "line_start": x.first, "line_end": x.last, "has_code": x.has_code, "token_count": x.tokens,
            }

    return identified(_per_document(docs, PIECE_SCHEMA, rows))


def identified(pieces: DataFrame) -> DataFrame:
    """Identifiers, embedding text and links within the section for packed pieces."""
    path, parents = F.col("heading_path"), F.slice("heading_path", 1, F.greatest(F.size("heading_path") - 1, F.lit(0)))
    out = (
        pieces.withColumn("document_id", stable_id("document", F.col("path")))
        .withColumn("section_id", section_id(F.col("document_id"), path))
        .withColumn("parent_section_id", F.when(F.size(path) > 0, section_id(F.col("document_id"), parents)))
        .withColumn("content_hash", sha256(F.col("text")))
        .withColumn("chunk_id", stable_id("chunk", F.col("document_id"), F.col("section_id"), F.col("chunk_order"), F.col("content_hash")))
        .withColumn("embedding_text", embedding_text(path, F.col("text")))
    )
    return linked(out).drop("section")


def linked(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the ids of the chunks before and after in the same section."""
    near = Window.partitionBy("document_id", "section_id").orderBy("chunk_order")
    return chunks.withColumn("previous_chunk_id", F.lag("chunk_id").over(near)).withColumn("next_chunk_id", F.lead("chunk_id").over(near))


PUBLIC = (
    "document_id section_id parent_section_id chunk_id chunk_order heading_path text embedding_text line_start line_end content_hash"
    " previous_chunk_id next_chunk_id has_code token_count"
).split()
