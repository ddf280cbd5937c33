"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

A window of an item's length is laid wherever a text shares a five-word shingle with that item (without one, no window
reaches the similarity). Windows and items of one length have 64-bit SimHash fingerprints of their words. Fingerprints
are cut in RADIUS + 1 blocks; two within RADIUS bits agree in a block, so joining on the blocks finds all of them. The
candidates within the radius are verified by the exact similarity of shingles weighted by their counts: the sum of the
smaller weights over the sum of the larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchors, with_shingles
from .common import id_and_text, load, stage

K, RADIUS = 5, 20

_FINGERPRINT = """aggregate(sequence(0, 63), 0L, (f, b) ->
    f | if(2 * aggregate(wh, 0L, (s, h) -> s + (shiftright(h, b) & 1L)) > size(wh), shiftleft(1L, b), 0L))"""
_WIDTH = 64 // (RADIUS + 1)
_BLOCKS = f"""transform(sequence(0, {RADIUS}), i -> named_struct('i', i, 'v',
    shiftrightunsigned(fp, i * {_WIDTH}) & if(i = {RADIUS}, {(1 << 64 - RADIUS * _WIDTH) - 1}L, {(1 << _WIDTH) - 1}L)))"""
_COMMON = """aggregate(array_intersect(sh, item_sh), 0, (s, x) ->
    s + least(size(filter(sh, y -> y = x)), size(filter(item_sh, y -> y = x))))"""


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(key, doc_id, item_id, start, similarity): the best window of each document and item that reach the similarity.

    key is a hash of doc_id and text, for joining results back. Words are lower-case runs of letters and digits. Null,
    empty and shorter texts than five words hold no item; items of fewer than five words or without id match nothing.
    A null doc_id stays null; rows equal in doc_id and text are one document; equal items all match. Ties take the
    first start. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    items = with_shingles(items.where("item IS NOT NULL").dropDuplicates(), K, "item").where("size(sh) > 0")
    items = stage(items.select("item", "wh", "sh", F.size("wh").alias("len")), "leak-items")
    table = items.select("item", F.posexplode("sh").alias("at", "h"))
    rows = id_and_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    found = anchors(rows, table, K).join(F.broadcast(items.select("item", "len")) if items.count() <= 100_000 else items.select("item", "len"), "item")
    spots = stage(found.select("key", F.greatest(F.expr("pos - at"), F.lit(0)).alias("start"), "len").distinct(), "leak-spots")

    texts = with_shingles(rows.join(spots.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), K, "key", "doc_id")
    windows = texts.join(spots, "key").select(
        "key", "doc_id", "start", "len", F.expr("slice(wh, start + 1, len)").alias("wh"),
        F.expr(f"if(size(sh) > start, slice(sh, start + 1, len - {K - 1}), array())").alias("sh"),
    )
    windows = stage(windows.withColumn("fp", F.expr(_FINGERPRINT)).drop("wh"), "leak-windows")
    marks = items.withColumn("fp", F.expr(_FINGERPRINT))
    item_blocks = marks.select("item", "len", F.col("fp").alias("item_fp"), F.explode_outer(F.expr(_BLOCKS)).alias("b")).select("item", "len", "item_fp", "b.*")
    blocks = windows.select("key", "start", "len", "fp", F.explode_outer(F.expr(_BLOCKS)).alias("b")).select("key", "start", "len", "fp", "b.*")
    near = blocks.join(item_blocks, ["len", "i", "v"]).where(f"bit_count(fp ^ item_fp) <= {RADIUS}")
    near = near.select("key", "start", "len", "item").distinct()
    both = near.join(windows.select("key", "doc_id", "start", "len", "sh"), ["key", "start", "len"]).join(
        items.select("item", F.col("sh").alias("item_sh")), "item"
    )
    scored = both.withColumn("common", F.expr(_COMMON)).withColumn("similarity", F.expr("common / (size(sh) + size(item_sh) - common)"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best")
    out = scored.where(F.col("similarity") >= similarity).groupBy("key", "doc_id", F.col("item").alias("item_id")).agg(best)
    return out.select("key", "doc_id", "item_id", (-F.col("best.s")).alias("start"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    bad = leaks(docs, benchmark, similarity).select(F.col("key").alias("__leak")).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(bad, key == bad["__leak"], "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("key")


