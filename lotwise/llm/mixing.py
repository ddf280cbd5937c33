"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are put in a seeded random order and laid end to end; the mix reads that tape from its start,
wrapping round, until the source's target of words is read. The tape is cut into blocks of ``block_words`` words; a
reading of a document belongs to the block it starts in, so documents stay whole. A binary tree over the output shards
splits the sources' exact block quotas: at each node the left half of the shards draws its blocks from the node's by a
multivariate hypergeometric distribution, so quotas stay exact at every level. Each shard then draws as many blocks of a
source as its quota says from a seeded permutation of them, disjoint from the other shards' ones, and orders all its
readings by a hash (local shuffle).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, id_and_text, load, stage

SEED = 20240501


def targets(sizes: list[float], weights: list[float], epochs: float) -> list[float]:
    """Share sum(sizes) by weight; a target stops at epochs x its size and the excess is shared again by weight."""
    out = [0.0] * len(sizes)
    free, rest = list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = rest / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > epochs * sizes[i]]
        for i in over:
            out[i] = float(epochs * sizes[i])
            rest -= out[i]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        free = [i for i in free if i not in set(over)]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source for each shard: rows are shards, column sums are the quotas exactly."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out: list[list[int]] = []

    def walk(have: np.ndarray, n: int) -> None:
        if n == 1:
            out.append([int(x) for x in have])
            return
        left = n // 2
        mine = rng.multivariate_hypergeometric(have, int(have.sum()) * left // n, method="marginals")
        walk(mine, left)
        walk(have - mine, n - left)

    walk(np.array(quotas, dtype=np.int64), shards)
    return out


def permutation(n: int, seed: int) -> tuple[int, int]:
    """(a, b) of the permutation k -> (a k + b) mod n of n blocks; a is no small step either way, a * n stays below 2^63
    for n below 2^31."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = int(rng.integers(n // 4, n - n // 4 + 1)) if n > 1 else 1
    while math.gcd(a, max(n, 1)) != 1:
        a += 1
    return a, int(rng.integers(0, max(n, 1)))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), epochs: int = 3, shards: int = 16,
    block_words: int | None = None, seed: int = SEED, max_sources: int = 100_000,
) -> DataFrame:
    """Plan of the mix: a row per input row with doc_id, source, key, size, source_size, target, readings.

    readings: array of (shard, block, epoch, n_words, place), one for each time the row is read: n_words is its size, or
    fewer where the source's target ends inside; place orders a shard's readings. Sources, by code point and null last,
    take the weights in turn. A null text has size 0 and no readings; a source of size 0 has target 0; rows of null doc_id
    or null source count like others; repeated rows lie on the tape once each. Tables without rows give no rows. One row
    per source (at most max_sources, else ValueError) reaches the driver. block_words None: the least power of two from
    4096 on that gives fewer than 500 million blocks, which the draw can handle; no document's words depend on it.
    """
    spark = docs.sparkSession
    sized = stage(
        id_and_text(docs, F.col("source").cast("string").alias("source")).select(
            "doc_id", "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"),
        ),
        "mix-sizes",
    )
    found = sized.groupBy("source").agg(F.sum("size"), F.count("*")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], epochs)
    words = [int(t + 1e-6) for t in goal]
    if block_words is None:
        block_words = max(4096, 1 << (sum(words) // 500_000_000).bit_length())
    blocks = [-(-t // block_words) for t in words]
    quotas = split_quotas(blocks, shards, seed) if found else []
    ends = np.cumsum(np.array(quotas, dtype=np.int64).reshape(len(quotas), len(found)), axis=0)
    moves = [permutation(n, seed + 1 + i) for i, n in enumerate(blocks)]
    plan = spark.createDataFrame(
        [(i, r[0], sizes[i], goal[i], words[i], blocks[i], *moves[i], [int(x) for x in ends[:-1, i]]) for i, r in enumerate(found)],
        "sid int, source string, source_size long, target double, words long, blocks long, step long, shift long, ends array<long>",
    )
    # a source may hold a third of all rows: its tape is summed in hash buckets first, those in coarser ones
    bits = 2 * max(3, ((max(sizes, default=1) // 20_000).bit_length() + 1) // 2)
    rows = sized.join(F.broadcast(plan), sized.source.eqNullSafe(plan.source)).drop(plan.source)
    rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits)).withColumn("coarse", F.shiftright("bucket", bits // 2))
    sums = rows.groupBy("sid", "coarse", "bucket").agg(F.sum("size").alias("n"))
    tops = sums.groupBy("sid", "coarse").agg(F.sum("n").alias("n"))
    upto = lambda of, by: F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("sid", "coarse", upto(["sid"], "coarse").alias("top"))
    sums = sums.select("sid", "coarse", "bucket", upto(["sid", "coarse"], "bucket").alias("base")).join(tops, ["sid", "coarse"])
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(sums.drop("coarse"), ["sid", "bucket"])
    rows = rows.withColumn("a", F.expr("top + base + upto - size"))
    readings = f"""
      transform(
        filter(sequence(0, if(source_size > 0, cast((words - 1) div greatest(source_size, 1) as int), 0)),
               e -> size > 0 and e * source_size + a < words),
        e -> named_struct(
          'shard', size(filter(ends, x -> x <= (step * ((e * source_size + a) div {block_words}) + shift) % blocks)),
          'block', (e * source_size + a) div {block_words}, 'epoch', e,
          'n_words', least(size, words - e * source_size - a), 'place', xxhash64({seed}, key, e)))"""
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", F.expr(readings).alias("readings"))


TAKEN = "aggregate(readings, 0L, (s, r) -> s + r.n_words)"


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each reading, with the documents' five columns, its shard and its place there.

    Whole readings repeat the row; the reading in which a source's target ends keeps the words before that end, joined
    by one space. Rows equal in doc_id and text are read together as often as all of them. Null and empty texts are not
    read. Sorted by shard and place, the rows are the shuffled shards (see write_shards).
    """
    seed = options.get("seed", SEED)
    plan = mix(docs, **options).select("doc_id", "key", "size", F.explode("readings").alias("r")).select("doc_id", "key", "size", "r.*")
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars",
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"),
    )
    out = (
        docs.dropDuplicates(["key", "doc_id"])
        .join(plan, docs.key.eqNullSafe(plan.key) & docs.doc_id.eqNullSafe(plan.doc_id))
        .select(docs.doc_id, "text", "lang", "source", "n_chars", "size", "n_words", "shard", "place")
    )
    whole = F.col("n_words") == F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("n_words").cast("int")), " ")
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(head))
    return out.select(
        "doc_id", "text", "lang", "source",
        F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"), "shard", "place",
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the mix to a folder shard=N for each shard, its readings in their shuffled order from file to file.

    Rows are dealt by ranges of (shard, place), so large shards are written by many tasks.
    """
    order = mixed_documents(docs, **options).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    order.write.partitionBy("shard").parquet(path)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 and at most 3 readings: a row per document, with the shard and place of its
    first reading (null without one)."""
    first = F.get("readings", F.lit(0))
    return mix(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", F.expr(TAKEN).alias("taken"), F.size("readings").alias("n_readings"),
        first.getField("shard").alias("shard"), first.getField("place").alias("place"),
    )
