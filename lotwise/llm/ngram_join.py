"""N-gram Jaccard join by vertical partitioning.

The order of n-grams is that of their 64-bit hashes; cutting it at even places gives fragments. A pair's overlaps are
counted in each fragment on its own and summed for the pair.

Candidates. In any fixed ranking of n-grams, a set of n of them meets every partner of the wanted similarity in one of its
first n - t n + 1. The ranking is: n-grams of a part of the hash space by their number of sets, then the others, then
very frequent ones as a sketch of counts over all documents tells them. Most sets have enough n-grams in that part, so
they deal out only those; passages that many documents share rank late and seldom bring documents together.

Groups. Equal sets are one class. In a bucket of one n-gram, members are first paired with a hub; very frequent n-grams
have several salted buckets with a hub each, and those are paired. Classes chained by buckets make a cluster. In a
cluster, the members outside its commonest component are compared with all others of different components by parity bit
maps, which only rule out pairs that cannot link: first to find the nearest one of each, then all. So no link between
components is missed, and groups of near copies cost pairs in proportion to their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, id_and_text, load, small, stage
from .textvec import Words, distinct_per_row, mix, shingles, text_chunks

SEGMENTS = 8
CELLS = 1 << 22  # of the sketch: one byte each when broadcast
SLICES = 16


def _differing(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Most n-grams in which sets of sizes a and b may differ: i >= percent * (a + b) / (100 + percent) are common."""
    common = -(-(percent * (a + b)) // (100 + percent))
    return a + b - 2 * common


def _sets(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, grams, set sizes) of pieces of the column: each row's distinct n-gram hashes."""
    for a, b, data, offsets in text_chunks(column):
        w = Words(data, offsets)
        grams, at = shingles(w, w.hashes(lower=True), k)
        rows, grams = distinct_per_row(w.rows[at], grams)
        yield a, b, rows, grams, np.bincount(rows, minlength=b - a)


def _digests(rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.cumsum(sizes) - sizes
    out = np.zeros((2, len(sizes)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        for i in (0, 1):
            out[i][full] = mix(np.add.reduceat(mix(grams, 11 + i), first[full]) + sizes[full].astype(np.uint64), 20 + i)
    return out[0].view(np.int64), out[1].view(np.int64)


def _parity(rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parity of each row's n-grams in a bit map of 64 * 2^i >= 2 n bits: sets differ in at least as many places as these."""
    bits = 1 << np.ceil(np.log2(np.maximum(2 * sizes, 64))).astype(np.int64)
    base = np.cumsum(bits) - bits
    place = base[rows] + (mix(grams, 71) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(base, bits.sum()) // 64, pa.int32()), pa.array(words))


class _Met:
    """Set classes that this task has met, at most a million of them; one that is forgotten is handled again."""

    def __init__(self, limit: int = 1 << 20):
        self.seen, self.limit = set(), limit

    def fresh(self, classes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(classes), bool)
        for i, x in enumerate(classes.tolist()):
            if x not in self.seen:
                out[i] = True
                if len(self.seen) < self.limit:
                    self.seen.add(x)
        return out


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows: of a document (doc_id, n-gram set size n, two digests c and d, parity bit map), and of a task's
    sketch (part, slice, counts: packed 64-bit numbers of sets in that slice of the cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, cells = _Met(), None
        for batch in batches:
            for a, b, rows, grams, sizes in _sets(batch.column(1), k):
                c, d = _digests(rows, grams, sizes)
                cells = np.zeros(CELLS, np.int64) if cells is None else cells
                np.add.at(cells, (grams[met.fresh(c)[rows]] & np.uint64(CELLS - 1)).astype(np.int64), 1)
                none = pa.nulls(b - a, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(c), pa.array(d), _parity(rows, grams, sizes),
                     none, none, pa.nulls(b - a, pa.binary())],
                    ["doc_id", "n", "c", "d", "parity", "part", "slice", "counts"],
                )
        if cells is not None:
            part = TaskContext.get().partitionId()
            for s, counts in enumerate(cells.reshape(SLICES, -1)):
                if counts.any():
                    one = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
                    packed = pa.array([pa.compress(counts.tobytes(), "zstd", asbytes=True)], pa.binary())
                    one += [pa.array([part], pa.int32()), pa.array([s], pa.int32()), packed]
                    yield pa.RecordBatch.from_arrays(one, ["doc_id", "n", "c", "d", "parity", "part", "slice", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, c long, d long, parity array<long>, part int, slice int, counts binary")


class Ranks:
    """Tiers of n-grams in the ranking: 0 for those of the first part of the hash space, 1 for the others, more for very
    frequent ones: those whose cell of the sketch counts more than ``hot`` sets and eight times the mean."""

    def __init__(self, sketch: DataFrame, percent: int, hot: int):
        """sketch: the (part, slice, counts) rows. They are summed slice by slice, 256 tasks' at a time first; one byte a
        cell reaches the driver, whatever the input's size."""
        width = CELLS // SLICES
        kinds = "part int, slice int, counts binary"

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for part, s, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    one = np.frombuffer(pa.decompress(counts, width * 8, "zstd", asbytes=True), np.int64)
                    sums[part // 256, s] = sums.get((part // 256, s), 0) + one
            for (part, s), total in sums.items():
                packed = pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s], pa.int32()), packed], ["part", "slice", "counts"])

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for s, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    one = np.frombuffer(pa.decompress(counts, width * 8, "zstd", asbytes=True), np.int64)
                    sums[s] = sums.get(s, 0) + one
            for s, total in sums.items():
                tier = np.where(total > hot + 8 * total.mean(), 2 + np.floor(2 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
                packed = pa.array([pa.compress(tier.tobytes(), "zstd", asbytes=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([s], pa.int32()), packed], ["part", "slice", "counts"])

        sums = sketch.withColumn("of", F.expr("part div 256")).repartition("of", "slice").drop("of").mapInArrow(add, kinds)
        self.tier = np.zeros(CELLS, np.uint8)
        for r in sums.repartition("slice").mapInArrow(close, kinds).toLocalIterator():
            self.tier[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(pa.decompress(r["counts"], width, "zstd", asbytes=True), np.uint8)
        # a set needs 1 - t of its n-grams; the first part holds somewhat more
        self.first = np.uint64((107 - percent) * 65536 // 100)
        self.salts = np.maximum(1, np.ceil(2.0 ** np.clip((np.arange(256) - 1) / 2, 0, 50) / hot)).astype(np.int64)

    def tiers(self, grams: np.ndarray) -> np.ndarray:
        tier = self.tier[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
        later = ((grams >> np.uint64(32)) & np.uint64(0xFFFF)) >= self.first
        return np.where(tier == 0, later, tier).astype(np.int64)


def candidate_keys(docs: DataFrame, k: int, percent: int, ranks) -> DataFrame:
    """(key, slot, c, room): the n-grams that may be among a set class's first ones, once for each task that meets the class.

    ranks: a broadcast Ranks. slot holds the tier and, above its lowest 8 bits, the salt of a frequent n-gram. room is the
    number of n-grams that the class needs, less its n-grams of tier 0, for the others also less those of tier 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in batches:
            for _, _, rows, grams, sizes in _sets(batch.column(1), k):
                c, _ = _digests(rows, grams, sizes)
                mine = met.fresh(c)[rows]
                rows, grams = rows[mine], grams[mine]
                tier = ranks.value.tiers(grams)
                need = sizes - -(-sizes * percent // 100) + 1
                first, second = (np.bincount(rows[tier == t], minlength=len(sizes)) for t in (0, 1))
                mine = (tier == 0) | (first < need)[rows]
                rows, grams, tier = rows[mine], grams[mine], tier[mine]
                room = (need - first)[rows] - np.where(tier > 0, second[rows], 0)
                c = c[rows]
                salt = (mix(c.view(np.uint64), 41) % ranks.value.salts[tier].astype(np.uint64)).astype(np.int64)
                salt[tier < 2] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(tier + (salt << 8)), pa.array(c), pa.array(room)], ["key", "slot", "c", "room"]
                )

    return docs.mapInArrow(run, "key long, slot long, c long, room long")


def first_keys(keys: DataFrame) -> DataFrame:
    """(key, slot, c) of candidate_keys that are among the first n-grams of their class in the ranking.

    An n-gram of one class ranks first in its tier, brings nobody together and is left out here. Two windows: by n-gram,
    whose rows are bounded as frequent ones are salted, and by class, bounded by a text's n-grams.
    """
    gram, of = Window.partitionBy("key", "slot"), Window.partitionBy("c")
    tier = F.col("slot").bitwiseAND(255)
    shared = keys.select("key", "slot", "c", "room", F.count("*").over(gram).alias("df"), F.min("c").over(gram).alias("lo"), F.max("c").over(gram).alias("hi"))
    shared = shared.where((tier > 1) | (F.col("lo") < F.col("hi"))).select("key", "slot", "c", "room", F.when(tier < 2, F.col("df")).otherwise(0).alias("df"))
    shared = shared.repartition("c").dropDuplicates(["c", "key"]).withColumn("tier", tier)
    met = F.count(F.when(F.col("tier") == 0, 1)).over(of) + F.when(F.col("tier") > 0, F.count(F.when(F.col("tier") == 1, 1)).over(of)).otherwise(0)
    place = F.row_number().over(of.orderBy("tier", "df", "key"))
    return shared.withColumn("place", place - met).where("place <= room").select("key", "slot", "c")


def segments(docs: DataFrame, k: int) -> DataFrame:
    """(c, n, fragment, grams): the sets of the documents, cut into fragments of the hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, rows, grams, sizes in _sets(batch.column(1), k):
                c, _ = _digests(rows, grams, sizes)
                part = rows * SEGMENTS + (grams >> np.uint64(64 - SEGMENTS.bit_length() + 1)).astype(np.int64)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                values = pa.ListArray.from_arrays(pa.array(np.append(cut, len(part)).astype(np.int32)), pa.array(grams.view(np.int64)))
                row = part[cut] // SEGMENTS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[row]), pa.array(sizes[row]), pa.array((part[cut] % SEGMENTS).astype(np.int32)), values],
                    ["c", "n", "fragment", "grams"],
                )

    return docs.mapInArrow(run, "c long, n long, fragment int, grams array<long>")


def _close(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that their sizes and parity bit maps don't rule out."""
    one = known.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    two = known.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    fold = "transform(sequence(0, size({0}) div 2 - 1), i -> {0}[i] ^ {0}[i + size({0}) div 2])"
    part = "aggregate(zip_with({}, {}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"
    differ = f"""CASE WHEN size(pa) > size(pb) THEN {part.format(fold.format("pa"), "pb")}
        WHEN size(pa) < size(pb) THEN {part.format("pa", fold.format("pb"))} ELSE {part.format("pa", "pb")} END"""
    may = f"na + nb - 2 * (({percent} * (na + nb) + {99 + percent}) div {100 + percent})"
    met = pairs.join(one, "a").where("na > 0").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return met.where(f"{differ} <= {may}").select("a", "b")


def _compare(c, label, n, side, parity: list[np.ndarray], percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of different components whose sizes and bit maps allow a link: rows of side 0 with those of side 1,
    or all rows where only side 0 is there. nearest: only the closest such partner of every row of side 0."""
    order = np.argsort(n, kind="stable")
    c, label, n, side = c[order], label[order], n[order], side[order]
    width = np.array([len(parity[i]) for i in order])
    at = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}  # runs, as width grows with n
    maps = {w: np.stack([parity[i] for i in order[ix]]).view(np.uint64) for w, ix in at.items()}
    folded = {w: m[:, : w // 2] ^ m[:, w // 2 :] for w, m in maps.items() if w > 1}
    low = np.searchsorted(n, -(-n * percent // 100), side="left")
    top = np.searchsorted(n, n * 100 // percent, side="right")
    crossed = side.any()
    out_a, out_b = [], []
    for i in np.flatnonzero(side == 0):
        w, own = int(width[i]), maps[int(width[i])][i - at[int(width[i])][0]]
        best, partner = 1 << 40, -1
        for other, matrix, probe in (
            (w, maps[w], own),
            (2 * w, folded.get(2 * w), own),
            (w // 2, maps.get(w // 2) if w > 1 else None, own[: w // 2] ^ own[w // 2 :]),
        ):
            if matrix is None:
                continue
            first = at[other][0]
            lo, hi = max(int(low[i]), first), min(int(top[i]), first + len(matrix))
            if not crossed and not nearest:
                lo = max(lo, i + 1)
            if lo >= hi:
                continue
            ok = label[lo:hi] != label[i]
            if crossed:
                ok &= side[lo:hi] == 1
            j = np.flatnonzero(ok)
            differ = np.bitwise_count(matrix[lo - first : hi - first][j] ^ probe).sum(1, dtype=np.int64)
            fits = differ <= _differing(n[i], n[lo + j], percent)
            j, differ = j[fits] + lo, differ[fits]
            if not len(j):
                continue
            if nearest:
                if differ.min() < best:
                    best, partner = differ.min(), int(j[differ.argmin()])
            else:
                out_a.append(np.full(len(j), i))
                out_b.append(j)
        if partner >= 0:
            out_a.append(np.array([i]))
            out_b.append(np.array([partner]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    return np.minimum(c[a], c[b]), np.maximum(c[a], c[b])


def _cluster_pairs(rows: DataFrame, percent: int, nearest: bool, block: int) -> DataFrame:
    """(a, b) of _compare for every cluster of rows (cluster, c, label, n, parity) with more than one label.

    The commonest label's rows of a cluster are its main part, the others are compared with them and with each other. Each
    part is dealt into blocks, and a task compares two of them.
    """
    labels = rows.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    info = labels.groupBy("cluster").agg(F.max(F.struct("k", "label")).alias("main"), F.sum("k").alias("n_rows"))
    info = info.where("main.k < n_rows").select(
        "cluster", F.col("main.label").alias("main"),
        F.ceil(F.col("main.k") / block).cast("int").alias("mains"),
        F.ceil((F.col("n_rows") - F.col("main.k")) / block).cast("int").alias("minors"),
    )
    info = stage(info, "ngram-clusters")
    mixed = rows.join(small(info), "cluster").withColumn("is_main", F.expr("label = main"))
    mixed = mixed.withColumn("own", F.expr("cast(pmod(xxhash64(c), if(is_main, mains, minors)) as int)"))
    with_main = "transform(sequence(1, mains), i -> named_struct('g1', -i, 'g2', own, 'side', 0))"
    with_minor = "transform(sequence(0, minors - 1), j -> named_struct('g1', least(own, j), 'g2', greatest(own, j), 'side', if(own <= j, 0, 1)))"
    as_main = "transform(sequence(0, minors - 1), j -> named_struct('g1', -1 - own, 'g2', j, 'side', 1))"
    mixed = mixed.select("cluster", "c", "label", "n", "parity", F.explode(F.expr(f"if(is_main, {as_main}, concat({with_main}, {with_minor}))")).alias("g"))
    mixed = mixed.select("cluster", "g.*", "c", "label", "n", "parity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            col = {k: t.column(k).to_numpy() for k in ("cluster", "g1", "g2", "side", "c", "label", "n")}
            cut = np.flatnonzero((np.diff(col["cluster"]) != 0) | (np.diff(col["g1"]) != 0) | (np.diff(col["g2"]) != 0)) + 1
            parity = t.column("parity").combine_chunks()
            offsets, values = parity.offsets.to_numpy(), parity.values.to_numpy()
            for lo, hi in zip(np.append(0, cut), np.append(cut, t.num_rows), strict=True):
                maps = [values[offsets[i] : offsets[i + 1]] for i in range(lo, hi)]
                a, b = _compare(*(col[k][lo:hi] for k in ("c", "label", "n", "side")), maps, percent, nearest)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            same = np.ones(t.num_rows, bool)
            for k in ("cluster", "g1", "g2"):
                x = t.column(k).to_numpy()
                same &= x == x[-1]
            whole = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1  # rows before the last, maybe unfinished, group
            held.append(t.slice(0, whole))
            if whole:
                yield from work(pa.concat_tables(held))
                held = []
            held.append(t.slice(whole))
        if held:
            yield from work(pa.concat_tables(held))

    return mixed.repartition("cluster", "g1", "g2").sortWithinPartitions("cluster", "g1", "g2").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that link: the overlaps in each fragment, summed."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    parts = parts.join(small(ids), "c", "left_semi")
    one = parts.select(F.col("c").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    two = parts.select(F.col("c").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb"))
    both = pairs.join(one, "a").join(two, ["b", "fragment"]).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    total = both.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("part").alias("i"))
    return total.where(f"100 * i >= {percent} * (na + nb - i)").select("a", "b")


def ngram_join(
    docs: DataFrame, k: int = 4, percent: int = 85, nearest_turns: int = 2, hot: int = 4096, block: int = 4096
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of sets with 100 * overlap >= percent * union.

    Words are split at ASCII white space and lower-cased in A-Z; a text of fewer than k words is one n-gram. Null and
    empty texts have size 0 and link with nothing. A null doc_id links with nothing and has a null component_id. Rows
    repeating a doc_id count as one document with the union of their links. Empty tables give no rows. n-grams stand as
    64-bit hashes of their words; classes as two of them. hot: rows of a bucket and block: rows of a part of a cluster
    beyond which it is dealt to several tasks; neither changes a result.
    """
    docs = id_and_text(docs)
    named = docs.where("doc_id IS NOT NULL")
    described = stage(describe(docs, k), "ngram-docs")
    seen = described.where("slice IS NULL").select("doc_id", "n", "c", "d", "parity")
    ranks = Ranks(described.where("slice IS NOT NULL").select("part", "slice", "counts"), percent, hot)
    keys = candidate_keys(named, k, percent, docs.sparkSession.sparkContext.broadcast(ranks))
    known = seen.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("c", "d").agg(F.min("doc_id").alias("rep"))
    bucket = Window.partitionBy("key", "slot")
    hub = F.min(F.struct(F.xxhash64("c", F.pmod("key", F.lit(4))).alias("o"), F.col("c").alias("h"))).over(bucket)
    buckets = stage(
        first_keys(keys)
        .select("key", (F.col("slot").bitwiseAND(255) > 1).alias("hot"), "c", F.min("c").over(bucket).alias("lo"), F.max("c").over(bucket).alias("hi"), hub.alias("hub"))
        .where("hot OR lo < hi").select("key", "hot", "c", "lo", F.col("hub.h").alias("hub")),
        "ngram-buckets",
    )
    # the buckets of a frequent n-gram: their first members are paired with the first of all
    salted = buckets.where("hot").select("key", F.col("lo").alias("c")).distinct()
    salted = salted.select(F.min("c").over(Window.partitionBy("key")).alias("a"), F.col("c").alias("b"))
    chains = stage(buckets.select(F.col("lo").alias("a"), F.col("c").alias("b")).unionByName(salted).where("a != b").distinct(), "ngram-chains")
    pairs = buckets.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).unionByName(salted)
    tested = stage(pairs.where("a != b").distinct(), "ngram-pairs")
    clusters = components(chains).select(F.col("node").alias("c"), F.col("root").alias("cluster"))
    members = known.select("c", "n", "parity").join(small(clusters), "c").dropDuplicates(["c"])
    members = stage(members, "ngram-members")
    wanted = stage(classes.join(small(members.select("c")), "c", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "ngram-wanted")
    parts = segments(named.join(small(wanted), "doc_id", "left_semi"), k)
    parts = stage(parts.dropDuplicates(["c", "fragment"]), "ngram-segments")

    links = stage(_verify(stage(_close(tested, members, percent), "ngram-close"), parts, percent), "ngram-links")
    labels = components(links)
    for nearest in [True] * nearest_turns + [False]:
        left = members.join(small(labels), members.c == labels.node, "left").select("cluster", "c", F.coalesce("root", "c").alias("label"), "n", "parity")
        found = _cluster_pairs(left, percent, nearest, block).distinct()
        found = stage(found.join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
        if found.isEmpty():
            continue
        new = stage(_verify(found, parts, percent), "ngram-links")
        tested = tested.unionByName(found)
        if not new.isEmpty():  # components so far are stars already: only what is new takes rounds
            stars = labels.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            labels = components(stars.unionByName(new))
    group = classes.join(small(labels), classes.c == labels.node, "left").select("c", "d", "rep", F.coalesce("root", "c").alias("root"))
    least = group.groupBy("root").agg(F.min("rep").alias("component_id"))
    group = group.join(least, "root").select("c", "d", "component_id")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = seen.join(group, ["c", "d"], "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return _merge_repeats(out)


def _merge_repeats(out: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id with other texts: their components are one."""
    edges = out.where("doc_id IS NOT NULL AND doc_id != component_id")
    split = edges.groupBy("doc_id").agg(F.countDistinct("component_id").alias("k")).where("k > 1").limit(1).count()
    if not split:
        return out
    merged = components(edges.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    return out.join(merged, out.doc_id == merged.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "component_id").alias("component_id")
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word sets are similar to 85%."""
    return ngram_join(load(spark, sf_dir, "documents"))
