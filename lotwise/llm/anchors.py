"""Native words, shingles and shared-shingle anchors (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest shingle table that is broadcast (20 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def plain_words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits; no words for null."""
    parts = F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def word_hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: str, k: int) -> Column:
    """Hashes of the k-word runs of an array of word hashes; fewer than k words give none."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(k))
    return F.expr(f"if(size({hashes}) >= {k}, transform(sequence(0, size({hashes}) - {k}), i -> xxhash64({parts})), array())")


def with_shingles(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """Columns ``keep``, words, wh (word hashes) and sh (shingle hashes) of df.text."""
    return (
        df.select(*keep, plain_words("text").alias("words"))
        .select(*keep, "words", word_hashes("words").alias("wh"))
        .select(*keep, "words", "wh", shingle_hashes("wh", k).alias("sh"))
    )


def anchors(rows: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(key, pos, item, at): places where a shingle of a text equals shingle ``at`` of an item of table (item, at, h).

    The texts' shingles are streamed past the table, so nothing of a text but its key and the hits moves on. Any region
    that shares one shingle with an item has an anchor, which is all that retrieval by similarity needs.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    # the outer form keeps the optimizer from testing size(sh) > 0 below, with all of sh's expressions repeated
    runs = with_shingles(rows, k, "key").select("key", F.posexplode_outer("sh").alias("pos", "h"))
    return runs.join(table, "h").select("key", "pos", "item", "at")
