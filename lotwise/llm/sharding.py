"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Groups of equal texts hash to one of ``arcs`` equal arcs of the ring. Every shard owns many virtual nodes; the arcs up
to the next virtual node clockwise are at home there. A shard's load is bounded by (1 + slack) of the mean: an arc that
would overflow its shard continues clockwise to the next virtual node of a shard with room. Loads are summed by arc in
Spark, so the walk sees ``arcs`` numbers whatever the input's size. A group larger than 1/32 of a shard is walked on
its own, before the arcs; one that no shard has room for is dealt over the ring by salted row hashes instead.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, load, stage


def _point(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def ring_walk(loads: list[int], heavy: list[tuple[int, int]], shards: int, vnodes: int, slack: float, seed: int):
    """Shard of each arc and of each heavy (arc, load) group, and the shards' loads.

    heavy goes first, largest first; then the arcs in order of the ring. Nothing is placed above the bound while any
    shard has room; what fits nowhere (coarse loads) goes to the emptiest shard.
    """
    ring = sorted((_point(seed, s, v), s) for s in range(shards) for v in range(vnodes))
    home, at = [], 0
    for arc in range(len(loads)):
        point = (2 * arc + 1) * (1 << 63) // len(loads)
        while at < len(ring) and ring[at][0] < point:
            at += 1
        home.append(at % len(ring))
    total = sum(loads) + sum(x for _, x in heavy)
    bound, have = total / shards * (1 + slack), [0] * shards

    def place(start: int, load: int) -> int:
        seen: set[int] = set()
        for step in range(len(ring)):
            s = ring[(start + step) % len(ring)][1]
            if have[s] + load <= bound:
                break
            seen.add(s)
            if len(seen) == shards:
                s = min(range(shards), key=lambda i: (have[i], i))
                break
        have[s] += load
        return s

    order = sorted(range(len(heavy)), key=lambda i: (-heavy[i][1], heavy[i][0], i))
    placed = {i: place(home[heavy[i][0]], heavy[i][1]) for i in order}
    return [place(home[a], x) if x else ring[home[a]][1] for a, x in enumerate(loads)], [placed[i] for i in range(len(heavy))], have


def shard(
    docs: DataFrame, shards: int = 24, vnodes: int = 64, arcs: int = 8192, slack: float = 0.002, seed: int = 7
) -> DataFrame:
    """Shard and slot of every row under the law `bytes`: shards' sizes (UTF-8 bytes + 8 a row) are near equal.

    Rows of equal text share a shard unless their group exceeds half a shard's fair load; such a group is split by
    salted hashes, as no single shard could hold it in balance. Null texts are one group of size 8 a row; a null doc_id
    is a value like others; repeated rows get slots of their own. Slots are gapless from 0 in each shard, ordered by
    hash. An empty table gives no rows. At most 32 x shards heavy groups and ``arcs`` sums reach the driver.
    """
    text = F.col("text")
    rows = stage(
        id_and_text(docs).select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.when(text.isNotNull(), F.crc32(F.encode(text, "UTF-8"))).cast("long").alias("text_crc32"),
            F.xxhash64(F.lit(seed), text).alias("grp"),
            F.xxhash64(F.lit(seed), "doc_id", text).alias("own"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    fair = max(1, total // shards)
    big = [tuple(r) for r in rows.groupBy("grp").agg(F.sum("size").alias("s")).where(F.col("s") > max(1024, fair // 32)).collect()]
    split = [g for g, s in big if s > fair // 2]
    whole = sorted((g, s) for g, s in big if s <= fair // 2)
    literal = lambda ids: F.array(*[F.lit(x) for x in ids]).cast("array<long>")
    spread = F.array_contains(literal(split), F.col("grp")) if split else F.lit(False)
    heavy = F.coalesce(F.array_position(literal([g for g, _ in whole]), F.col("grp")).cast("int"), F.lit(0)) if whole else F.lit(0)
    rows = rows.withColumn("arc", F.pmod(F.when(spread, F.col("own")).otherwise(F.col("grp")), F.lit(arcs)).cast("int"))
    rows = rows.withColumn("heavy", heavy)
    loads = [0] * arcs
    for arc, load_ in rows.where("heavy = 0").groupBy("arc").agg(F.sum("size")).collect():
        loads[arc] = load_
    of_arc, of_heavy, _ = ring_walk(loads, [(g % arcs, s) for g, s in whole], shards, vnodes, slack, seed)
    table = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",")
    where = F.element_at(table(of_arc), F.col("arc") + 1)
    if whole:
        where = F.when(F.col("heavy") > 0, F.element_at(table(of_heavy), F.greatest("heavy", F.lit(1)))).otherwise(where)
    rows = rows.withColumn("shard", where.cast("int")).withColumn("part", F.pmod("own", F.lit(64)))
    # slots: rows are numbered in 64 parts of each shard, each part starting after the parts before it
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("own", "doc_id"))
    rows = rows.withColumn("rn", number.cast("long")).join(F.broadcast(counts), ["shard", "part"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.expr("base + rn - 1").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes."""
    return shard(load(spark, sf_dir, "documents"))
