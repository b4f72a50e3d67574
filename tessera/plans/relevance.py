"""Which documents contain a passage word for word, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import spread

#: Words of a passage that find its documents; passages up to which those are broadcast, and short ones looked up together.
ANCHOR, BROADCAST_PASSAGES = 4, 100_000


def _gram(words: Column | str, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(ANCHOR)])


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id where the document's text contains the passage's.

    The inner words of a passage stand between spaces in every document that contains it, so its
    second to fifth word meet the document's rolling hashes in an equi-join; the text decides.
    Passages with too few words for that are looked up in every document.
    """
    items = passages.select("item_id", F.col("text").alias("passage"), F.split("text", " ").alias("words"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_PASSAGES else df
    anchored = items.filter(F.size("words") >= ANCHOR + 2).select("item_id", "passage", _gram("words", F.lit(1)).alias("gram"))
    words = F.split("text", " ")
    grams = F.when(F.size("words") >= ANCHOR, F.transform(F.sequence(F.lit(0), F.size("words") - ANCHOR), lambda i: _gram("words", i)))
    docs = spread(docs)
    rolled = docs.select("doc_id", words.alias("words")).select("doc_id", F.explode(F.array_distinct(grams)).alias("gram"))
    pairs = rolled.join(small(anchored), "gram").select("doc_id", "item_id", "passage").distinct()
    found = pairs.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "passage")).select("doc_id", "item_id")
    short = items.filter(F.size("words") < ANCHOR + 2).select("item_id", "passage")
    # A stated set: each block of it is broadcast, and the documents are read once a block.
    blocks = -(-short.count() // BROADCAST_PASSAGES)
    for n in range(blocks):
        block = F.broadcast(short.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n))
        found = found.unionByName(docs.select("doc_id", "text").join(block, F.contains("text", "passage")).select("doc_id", "item_id"))
    return found
