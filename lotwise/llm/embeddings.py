"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random lines, in groups of lines. Within a group all lines but one are cut into
cells of width CELL and the last one is sorted; two vectors collide in a group if they share the cell and lie within
the query-centred window of each other on the sorted line. Collisions are counted over all groups. For a pair exactly
at the threshold the count is binomial, so the number of groups and the least count are calibrated to the wanted
recall; pairs that reach the count are verified by their cosine in double precision. The number of lines in a group
grows with the logarithm of the rows, which keeps chance collisions of a vector in a group at a small constant. Equal
vectors are one class, which is sent on once with its number of vectors.

Every vector is sent to one sorted run for each group, and a pair is judged where it collides first, so links are
counted once without ever listing pairs. Cells of more than ``block`` rows are split into blocks, and pairs of blocks
go to different tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, load, ship, small, stage
from .textvec import mix

CELL = 2.0
WIDE = 2.5  # half window on the sorted line, in distances of a pair at the threshold


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def cell_chance(distance: float) -> float:
    """Chance that two points this far apart share a cell on one line."""
    r = CELL / distance
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Plan:
    """Lines, groups and least count for n vectors of one dimension."""

    def __init__(self, n: int, dim: int, threshold: float, recall: float, seed: int):
        self.threshold, self.distance = threshold, math.sqrt(2 * (1 - threshold))
        near, far = cell_chance(self.distance), cell_chance(math.sqrt(2))
        self.lines = max(2, math.ceil(math.log(max(n, 16) / 8) / -math.log(far)))
        hit = near ** (self.lines - 1) * (2 * _phi(WIDE) - 1)
        self.least, self.groups = 2, 2
        while (1 - hit) ** self.groups * (1 + self.groups * hit / (1 - hit)) > 1 - recall:
            self.groups += 1
        rng = np.random.Generator(np.random.PCG64(seed + dim))
        self.matrix = rng.normal(size=(dim, self.groups * self.lines))
        self.shift = rng.uniform(0, CELL, self.groups * self.lines)
        self.window = WIDE * self.distance

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell hash, place on the sorted line) of each vector in each group."""
        p = (unit @ self.matrix + self.shift).reshape(len(unit), self.groups, self.lines)
        cells = np.floor(p[:, :, :-1] / CELL).astype(np.int64).view(np.uint64)
        h = np.full(p.shape[:2], np.uint64(unit.shape[1]))
        for j in range(self.lines - 1):
            h = mix(h + cells[:, :, j], j)
        return mix(h + np.arange(self.groups, dtype=np.uint64), 99).view(np.int64), p[:, :, -1]


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _judge(plan: Plan, key, proj, side, group, ids, weight, unit):
    """(ids, links, root ids) of linked classes of complete cells, sorted by cell and place on the line; weight: vectors of
    each class, which its partners count as links."""
    found_a, found_b = [], []
    pair_block = group["b1"] != group["b2"]
    for step in range(1, len(key)):
        i = np.flatnonzero((key[step:] == key[:-step]) & (proj[step:] - proj[:-step] <= plan.window))
        if not len(i):
            break
        i = i[(~pair_block[i] | (side[i] != side[i + step])) & (ids[i] != ids[i + step])]
        for c in range(0, len(i), 20_000):
            a = i[c : c + 20_000]
            ok = np.einsum("ij,ij->i", unit[a], unit[a + step]) >= plan.threshold
            found_a.append(a[ok])
            found_b.append(a[ok] + step)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    if not len(a):
        return None
    used, flat = np.unique(np.append(a, b), return_inverse=True)
    h, p = plan.keys(unit[used])
    x, y = flat[: len(a)], flat[len(a) :]
    keep = np.zeros(len(a), bool)
    for c in range(0, len(a), 20_000):
        s = slice(c, c + 20_000)
        hit = (h[x[s]] == h[y[s]]) & (np.abs(p[x[s]] - p[y[s]]) <= plan.window)
        keep[s] = (hit.sum(1) >= plan.least) & (hit.argmax(1) == group["g"][a[s]])
    x, y = x[keep], y[keep]
    if not len(x):
        return None
    # a vector may stand in several cells of this call: links and roots are by row, summed by vector later
    order = np.argsort(ids[used], kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    roots = _local_roots(rank[x], rank[y], len(used))
    links = np.bincount(np.append(x, y), weight[used][np.append(y, x)], len(used)).astype(np.int64)
    some = np.flatnonzero(links)
    return ids[used][some], links[some], ids[used][order][roots[rank[some]]]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, seed: int = 3, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links are pairs of vectors with cosine >= threshold.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, as do vectors of
    different lengths. A null vec_id links with nothing: n_links 0, component_id null, kept false. Rows that repeat a
    vec_id stand for one vector (the smallest of theirs); each gets its result. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    single = dict(rows.dtypes)["v"] == "array<float>"
    if not single:
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    number = "<f4" if single else "<f8"
    known = rows.where("vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    known = known.groupBy("vec_id").agg(F.min("v").alias("v")).where("exists(v, x -> x != 0)")
    known = known.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    known = stage(known, "vectors")
    # a third of all vectors may be equal: classes by two hashes, counted before they are shuffled
    hashes = known.select("vec_id", "h1", "h2")
    copies = hashes.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = stage(copies, "vector-copies")
    members = hashes.join(small(copies), ["h1", "h2"]).select(F.col("vec_id").alias("member"), "rep", "n")
    others = members.where("member != rep").select(F.col("member").alias("vec_id"))
    sizes_of = copies.select(F.col("rep").alias("vec_id"), "n")
    known = known.select("vec_id", "v").join(small(others), "vec_id", "left_anti").join(small(sizes_of), "vec_id", "left")
    known = stage(known.select("vec_id", "v", F.coalesce("n", F.lit(1)).alias("n")), "vector-classes")
    sizes = {r[0]: r[1] for r in known.groupBy(F.size("v")).count().orderBy(F.desc("count")).limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1000 different dimensions")
    plans = spark.sparkContext.broadcast({d: Plan(n, d, threshold, recall, seed) for d, n in sizes.items()})

    def units(raw: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(raw), number).reshape(len(raw), -1).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)  # squares of huge or tiny components stay finite
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists, weight = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            dims = np.array([len(x) for x in lists])
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for c in range(0, len(mine), 1000):
                    part = mine[c : c + 1000]
                    raw = [np.array(lists[i], number).tobytes() for i in part]
                    key, proj = plans.value[int(dim)].keys(units(raw))
                    g = np.arange(key.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel()), pa.array(proj.ravel()), pa.array(np.tile(g, len(part))), pa.array(np.repeat(ids[part], len(g))),
                         pa.array(np.repeat(weight[part], len(g))), pa.array([r for r in raw for _ in g], pa.binary())],
                        ["key", "proj", "g", "vec_id", "n", "raw"],
                    )

    placed = known.mapInArrow(spread, "key long, proj double, g int, vec_id long, n long, raw binary")
    hot = placed.select("key").groupBy("key").count().where(F.col("count") > block)
    hot = stage(hot.select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot-cells")
    one = F.lit(0).alias("b1"), F.lit(0).alias("b2"), F.lit(0).alias("side")
    if hot.limit(1).count():
        placed = placed.join(hot, placed.key == hot.hot_key, "left").withColumn("side", F.expr("pmod(xxhash64(vec_id), coalesce(blocks, 1))").cast("int"))
        placed = placed.withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
        placed = placed.select("key", "proj", "g", "vec_id", "n", "raw", F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"), "side")
    else:
        placed = placed.select("key", "proj", "g", "vec_id", "n", "raw", *one)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table):
            col = {n: table.column(n).to_numpy() for n in ("key", "proj", "g", "vec_id", "n", "b1", "b2", "side")}
            raw = table.column("raw").to_pylist()
            lens = np.array([len(r) for r in raw])
            cell = np.cumsum(np.append(0, (np.diff(col["key"]) != 0) | (np.diff(col["b1"]) != 0) | (np.diff(col["b2"]) != 0)))
            lonely = np.bincount(cell)[cell] == 1
            for size in np.unique(lens[~lonely]):
                mine = np.flatnonzero((lens == size) & ~lonely)
                got = _judge(
                    plans.value[int(size) // np.dtype(number).itemsize], cell[mine], col["proj"][mine], col["side"][mine],
                    {k: col[k][mine] for k in ("g", "b1", "b2")}, col["vec_id"][mine], col["n"][mine], units([raw[i] for i in mine]),
                )
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["vec_id", "links", "root"])

        def cut(table: pa.Table) -> int:
            """First row of the last, maybe incomplete, cell."""
            n = table.num_rows
            same = np.ones(n, bool)
            for name in ("key", "b1", "b2"):
                x = table.column(name).to_numpy()
                same &= x == x[-1]
            return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 20_000:
                table = pa.Table.from_batches(held)
                if at := cut(table):
                    yield from work(table.slice(0, at))
                    held = table.slice(at).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    found = placed.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "proj", "vec_id")
    found = stage(found.mapInArrow(judge, "vec_id long, links long, root long"), "vector-links")
    links = found.groupBy(F.col("vec_id").alias("linked")).agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = rows.select("vec_id").join(small(members), F.col("vec_id") == F.col("member"), "left").withColumn("of", F.coalesce("rep", "vec_id"))
    out = out.join(small(links), F.col("of") == F.col("linked"), "left").join(small(groups), F.col("of") == F.col("node"), "left")
    return out.select(
        "vec_id", F.expr("CAST(coalesce(links, 0) + coalesce(n, 1) - 1 AS BIGINT)").alias("n_links"), F.coalesce("root", "of").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near_vectors(load(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS r FROM v UNION SELECT l.y AS x, reach.r FROM reach JOIN links l ON l.x = reach.x),
low AS (SELECT x, min(r) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low ON low.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
