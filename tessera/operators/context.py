"""Neighbouring chunks as context of a hit, within a budget of tokens, and rendering.

A chunk table has chunk_id, document_id, section_id, parent_section_id, chunk_order,
token_count, and for rendering heading_path, text, line_start and line_end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.markdown import BODY_LABEL, LINES_LABEL, PATH_LABEL, UNTITLED
from tessera.runtime import ship

BETWEEN = "\n\n---\n\n"
PLACE = ("chunk_id", "section_id", "parent_section_id", "chunk_order", "token_count")


def neighbours(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``before`` and ``after``: the chunks next in the document, across sections, at orders
    one lower and one higher only."""
    near = Window.partitionBy("document_id").orderBy("chunk_order", "chunk_id")
    place = F.struct(*PLACE)
    at = lambda c, step: F.when(c["chunk_order"] == F.col("chunk_order") + step, c)
    both = chunks.withColumn("before", F.lag(place).over(near)).withColumn("after", F.lead(place).over(near))
    return both.withColumn("before", at(F.col("before"), -1)).withColumn("after", at(F.col("after"), 1))


def related(core_section: Column, core_parent: Column, other: Column) -> Column:
    """Same section, or same parent that is not null."""
    return F.coalesce((other["section_id"] == core_section) | (other["parent_section_id"] == core_parent), F.lit(False))


def candidates(cores: DataFrame, chunks: DataFrame, no_expand: int) -> DataFrame:
    """qid, core_rank, core_id, core_tokens and candidate rows (side 0 before, 1 after) of cores that expand.

    ``cores``: qid, chunk_id, core_rank. A candidate that is a core of the query itself is left out.
    """
    placed = cores.join(neighbours(chunks), "chunk_id").filter(F.col("token_count") < no_expand)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("chunk")) for i, c in enumerate(("before", "after"))])
    near = placed.select(
        "qid", "core_rank", F.col("chunk_id").alias("core_id"), F.col("token_count").alias("core_tokens"),
        F.col("section_id").alias("core_section"), F.col("parent_section_id").alias("core_parent"), F.explode(sides).alias("near"),
    )
    other = F.col("near.chunk")
    fitting = near.filter(other.isNotNull() & related(F.col("core_section"), F.col("core_parent"), other)).select(
        "qid", "core_rank", "core_id", "core_tokens", "near.side", other["chunk_id"].alias("chunk_id"),
        other["chunk_order"].alias("chunk_order"), other["token_count"].alias("token_count"),
    )
    return fitting.join(cores.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")


def select(cores: DataFrame, chunks: DataFrame, no_expand: int, budget: int) -> DataFrame:
    """qid, core_rank, core_id, chunk_id, is_core: cores and their extensions.

    Cores take extensions in their order, each chunk once in a query; one that would break the budget is
    passed over and a later one may still fit. A query has a few cores with two neighbours each.
    """
    ship(cores.sparkSession)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        used, spent, rows = set(), {}, []
        for r in group.sort_values(["core_rank", "side", "chunk_order", "chunk_id"]).itertuples():
            total = spent.get(r.core_id, r.core_tokens) + r.token_count
            if r.chunk_id not in used and total <= budget:
                used.add(r.chunk_id)
                spent[r.core_id] = total
                rows.append((r.qid, r.core_rank, r.core_id, r.chunk_id, False))
        return pd.DataFrame(rows, columns=["qid", "core_rank", "core_id", "chunk_id", "is_core"])

    schema = "qid long, core_rank int, core_id string, chunk_id string, is_core boolean"
    plain = candidates(cores, chunks, no_expand).withColumn("core_rank", F.col("core_rank").cast("int")).withColumn("qid", F.col("qid").cast("long"))
    extended = plain.groupBy("qid").applyInPandas(one, schema)
    own = cores.select(F.col("qid").cast("long"), F.col("core_rank").cast("int"), F.col("chunk_id").alias("core_id"), "chunk_id", F.lit(True).alias("is_core"))
    return own.unionByName(extended)


def render_chunk() -> Column:
    titles = F.filter(F.transform("heading_path", lambda h: F.trim(h["text"])), lambda t: t != "")
    path = F.when(F.size(titles) > 0, F.array_join(titles, " > ")).otherwise(UNTITLED)
    span = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    return F.concat(F.lit(PATH_LABEL), path, F.lit(f"\n{LINES_LABEL}"), span, F.lit("\n\n" + BODY_LABEL), F.col("text"))


def render(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, core_rank, core_id, context: the chunks of a group in document order, with a rule between."""
    shown = groups.join(chunks.select("chunk_id", "chunk_order", render_chunk().alias("shown")), "chunk_id")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_id", "shown")))
    return shown.groupBy("qid", "core_rank", "core_id").agg(F.array_join(F.transform(ordered, lambda c: c["shown"]), BETWEEN).alias("context"))
