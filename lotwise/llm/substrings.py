"""Substring dedup with a count-min prefilter.

A window is ``WINDOW`` consecutive words. Every window has an anchor, the smallest hash among its ``GRAM``-word runs;
neighbouring windows mostly share it, and windows with one anchor at one place make a block. Equal windows have equal
anchors, so a window can repeat only if its anchor's run of words does.

1. Every task keeps a count-min sketch of the anchors it meets (one count for each block); the sketches are merged by
   slices. Merged cells never underestimate.
2. Blocks whose anchor is estimated at two or more are grouped exactly by all their words. All windows of a block that
   is not the first of its group start earlier in that first block.
3. What is left is equal windows in different blocks of one anchor. The first blocks of such anchors (marked in a Bloom
   filter, which may mark more but never fewer) send their windows one by one, again grouped exactly.

So no window is lost by the sketch, and a group of copies costs a row for each block, not for each window.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, load, stage
from .textvec import Words, mix, text_chunks

WINDOW, GRAM = 20, 6
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        _POWERS.clear()
        for base in _BASES:
            for b in (base, pow(base, -1, 1 << 64)):
                out = np.full(size, b, np.uint64)
                out[0] = 1
                _POWERS.append(np.multiply.accumulate(out))
    return _POWERS


class Blocks:
    """Anchored blocks of a piece: row, first and last window start (words in the row), anchor hash; and window hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(data, offsets)
        h = w.hashes()
        n, span = len(h), WINDOW - GRAM + 1
        self.h = h
        empty = np.zeros(0, np.int64)
        self.row = self.low = self.high = self.at = empty
        self.anchor = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        runs = np.zeros(n - GRAM + 1, np.uint64)
        for j in range(GRAM):
            runs += mix(h[j : len(runs) + j], j + 1)
        runs = mix(runs)
        count = n - WINDOW + 1
        best, where = runs[:count].copy(), np.zeros(count, np.int64)
        for j in range(1, span):
            cand = runs[j : j + count]
            less = cand < best
            best[less] = cand[less]
            where[less] = j
        start = np.arange(count)
        valid = np.flatnonzero(w.rows[:count] == w.rows[WINDOW - 1 : WINDOW - 1 + count])
        if not len(valid):
            return
        place = (start + where)[valid]
        cut = np.flatnonzero(np.append(True, (place[1:] != place[:-1])))
        self.first, self.last = valid[cut], valid[np.append(cut[1:], len(valid)) - 1]
        self.anchor = best[valid[cut]]
        self.at = place[cut]
        self.row = w.rows[self.first]
        base = w.bounds[:-1][self.row]
        self.low, self.high = self.first - base, self.last - base

    def spans(self, start: np.ndarray, end: np.ndarray, more: np.ndarray | None = None) -> list[np.ndarray]:
        """Two hashes of the words [start, end) each."""
        p = _powers(len(self.h) + 1)
        out = []
        for i in (0, 1):
            total = np.append(np.uint64(0), np.cumsum(mix(self.h, 41 + i) * p[2 * i][: len(self.h)]))
            value = (total[end] - total[start]) * p[2 * i + 1][start] + (end - start).astype(np.uint64)
            out.append(mix(value if more is None else value + mix(more.astype(np.uint64), 43), 45 + i).view(np.int64))
        return out


def _cells(values: np.ndarray, cells: int, depth: int) -> list[np.ndarray]:
    return [(mix(values, 50 + d) & np.uint64(cells - 1)).astype(np.int64) for d in range(depth)]


def _merged(sketches: DataFrame, slices: int) -> DataFrame:
    """Sum (up to two) of the tasks' packed slices: a slice never needs more memory than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(zlib.decompress(r[k]), np.uint8) for k in ("once", "twice"))
                if (k := r["slice"]) in once:
                    twice[k] |= b | (once[k] & a)
                    once[k] |= a
                else:
                    once[k], twice[k] = a.copy(), b.copy()
        for k in once:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([zlib.compress(x[k].tobytes(), 1)], pa.binary()) for x in (once, twice))], ["slice", "once", "twice"])

    return sketches.repartition(slices, "slice").mapInArrow(run, "slice int, once binary, twice binary")


def _sketch_rows(counts: np.ndarray, slices: int) -> pa.RecordBatch:
    """A task's saturated counts as two bit maps a slice; slices without any count are left out."""
    parts = [(k, c) for k, c in enumerate(np.split(counts, slices)) if c.any()]
    pack = lambda bits: zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in parts], pa.int32()), pa.array([pack(c > 0) for _, c in parts], pa.binary()), pa.array([pack(c > 1) for _, c in parts], pa.binary())],
        ["slice", "once", "twice"],
    )


def _bits(sketches: DataFrame, slices: int, size: int, column: str) -> np.ndarray:
    """The merged bit map of ``column``, size / 8 bytes (a bound that doesn't grow with the data)."""
    out = np.zeros(size // 8, np.uint8)
    step = size // 8 // slices
    for r in _merged(sketches, slices).select("slice", column).collect():
        out[r[0] * step : (r[0] + 1) * step] = np.frombuffer(zlib.decompress(bytes(r[1])), np.uint8)
    return out


def _marked(bits: np.ndarray, cells: list[np.ndarray], size: int) -> np.ndarray:
    """Whether all of a value's cells are set; row d of the map has its own size cells."""
    ok = np.ones(len(cells[0]), bool)
    for d, c in enumerate(cells):
        c = c + d * size
        ok &= (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return ok


def repeated_words(docs: DataFrame, cells: int = 1 << 25, depth: int = 2, bloom: int = 1 << 26, slices: int = 16) -> DataFrame:
    """(doc_id, key, ranges): starts [a, b] of the windows of a document that start earlier elsewhere, as an array.

    The sketch takes cells * depth bytes in a task, the broadcast maps cells * depth / 8 and bloom / 8 bytes, at any
    size of input; beyond that many anchors more windows are grouped exactly, none fewer.
    """
    spark = docs.sparkSession

    def pieces(batch: pa.RecordBatch):
        for a, b, data, offsets in text_chunks(batch.column(2), 1 << 20):
            yield Blocks(data, offsets), (lambda c, a=a, b=b: batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells * depth, np.uint8)
        for batch in batches:
            for blocks, _ in pieces(batch):
                for d, c in enumerate(_cells(blocks.anchor, cells, depth)):
                    c, n = np.unique(c + d * cells, return_counts=True)
                    counts[c] = np.minimum(counts[c] + np.minimum(n, 2), 2)
        yield _sketch_rows(counts, slices)

    rows = docs.select("doc_id", "key", "text")
    often = spark.sparkContext.broadcast(_bits(rows.mapInArrow(count, "slice int, once binary, twice binary"), slices, cells * depth, "twice"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks, column in pieces(batch):
                if not len(blocks.anchor):
                    continue
                keep = np.flatnonzero(_marked(often.value, _cells(blocks.anchor, cells, depth), cells))
                first, last, row = blocks.first[keep], blocks.last[keep], blocks.row[keep]
                h1, h2 = blocks.spans(first, last + WINDOW, blocks.at[keep] - first)
                anchor = blocks.anchor[keep].view(np.int64)
                out.append((h1, h2, column(0)[row], column(1)[row], blocks.low[keep], anchor, blocks.high[keep] - blocks.low[keep]))
            if out:
                h1, h2, doc, key, low, anchor, more = (np.concatenate(x) for x in zip(*out, strict=True))
                kept, again = _again(h1, h2, doc, key, low)
                h1, h2, doc, key, low, anchor, more = (x[kept] for x in (h1, h2, doc, key, low, anchor, more))
                yield _rows(h1=h1, h2=_half(h2), doc_id=doc, key=key, low=_half(low), anchor=anchor, more=_half(more), again=again)

    where = "h1 long, h2 int, doc_id long, key long, low int"
    found = stage(rows.mapInArrow(group, f"{where}, anchor long, more int, again boolean"), "substring-blocks")
    place = F.struct("doc_id", "key", "low")
    # dealt by anchor once: equal blocks have equal anchors, so both windows need no other exchange; what repeats inside
    # a task's batch is marked there, so a passage of very many documents meets here once for each batch
    same, anchor = Window.partitionBy("anchor", "h1", "h2"), Window.partitionBy("anchor")
    dealt = found.where("NOT again").repartition("anchor").withColumn("first", F.min(place).over(same) == place)
    dealt = dealt.withColumn("varied", F.min("h1").over(anchor) != F.max("h1").over(anchor))
    dealt = stage(dealt.where("NOT first OR varied").select("doc_id", "key", "low", "more", "first"), "substring-dealt")
    span = F.struct("low", (F.col("low") + F.col("more")).alias("high")).alias("r")
    ranges = dealt.where("NOT first").select("doc_id", "key", span).unionByName(found.where("again").select("doc_id", "key", span))
    spots = dealt.where("first").select("doc_id", "key", "low")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(bloom // 2, np.uint8)
        for batch in batches:
            doc, key, low = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for d, c in enumerate(_cells(_spot(doc, key, low), bloom // 2, 1)):
                counts[c] = 1
        yield _sketch_rows(counts, slices)

    spread = spots.repartition(max(1, spark.sparkContext.defaultParallelism))
    spot_bits = spark.sparkContext.broadcast(_bits(spread.mapInArrow(mark, "slice int, once binary, twice binary"), slices, bloom // 2, "once"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks, column in pieces(batch):
                if not len(blocks.anchor):
                    continue
                doc, key = column(0)[blocks.row], column(1)[blocks.row]
                keep = np.flatnonzero(_marked(often.value, _cells(blocks.anchor, cells, depth), cells))
                keep = keep[_marked(spot_bits.value, _cells(_spot(doc[keep], key[keep], blocks.low[keep]), bloom // 2, 1), bloom // 2)]
                size = blocks.last[keep] - blocks.first[keep] + 1
                if not size.sum():
                    continue
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat(blocks.first[keep], size) + inside
                h1, h2 = blocks.spans(start, start + WINDOW)
                out.append((h1, h2, np.repeat(doc[keep], size), np.repeat(key[keep], size), np.repeat(blocks.low[keep], size) + inside))
            if out:
                h1, h2, doc, key, low = (np.concatenate(x) for x in zip(*out, strict=True))
                kept, again = _again(h1, h2, doc, key, low)
                h1, h2, doc, key, low = (x[kept] for x in (h1, h2, doc, key, low))
                yield _rows(h1=h1, h2=_half(h2), doc_id=doc, key=key, low=_half(low), again=again)

    windows = stage(rows.mapInArrow(single, f"{where}, again boolean"), "substring-windows")
    one = F.struct("low", F.col("low").alias("high")).alias("r")
    same = Window.partitionBy("h1", "h2")
    later = windows.where("NOT again").withColumn("first", F.min(place).over(same) == place).where("NOT first")
    for more in (later, windows.where("again")):
        ranges = ranges.unionByName(more.select("doc_id", "key", one))
    return ranges.groupBy("doc_id", "key").agg(F.collect_set("r").alias("ranges"))


def _half(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32)


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _again(h1, h2, doc, key, low) -> tuple[np.ndarray, np.ndarray]:
    """One row of each hashes and place, and which of them stand at an earlier place too: a repeated row is no repeat."""
    order = np.lexsort((low, key, doc, h2, h1))
    same, moved = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    same[1:] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    moved[1:] = ~same[1:] | np.any([x[order[1:]] != x[order[:-1]] for x in (doc, key, low)], axis=0)
    return order[moved], same[moved]


def _spot(doc: np.ndarray, key: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(np.uint64), 61) + mix(key.astype(np.int64).view(np.uint64), 62) + low.astype(np.uint64), 63)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of every row: words of windows that start earlier are removed.

    Windows are judged on the input. Null and empty texts have no words and keep the empty string; texts of fewer than
    20 words keep all. A null doc_id comes after every other id. Rows of one doc_id and different texts are ordered by
    a hash of the text; rows equal in both are one document, each getting its result. Empty tables give no rows.
    """
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    rows = id_and_text(docs)
    single = not rows.groupBy("doc_id").count().where("count > 1").limit(1).count()  # then doc_id alone orders the documents
    key = F.lit(0).cast("long") if single else F.xxhash64("text")
    rows = rows.select(F.col("doc_id").alias("id"), last.alias("doc_id"), key.alias("key"), "text")
    cut = repeated_words(rows)
    joined = rows.join(cut, ["doc_id", "key"], "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(2)
            for a, b, data, offsets in text_chunks(batch.column(1)):
                w = Words(data, offsets)
                raw = data.tobytes()
                counts, removed, kept = w.counts, [], []
                for i, own in enumerate(ranges.slice(a, b - a).to_pylist()):
                    lo, hi = w.bounds[i], w.bounds[i + 1]
                    gone = np.zeros(hi - lo + 1, np.int64)
                    for r in own or ():
                        gone[r["low"]] += 1
                        gone[r["high"] + WINDOW] -= 1
                    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + lo
                    removed.append(int(hi - lo - len(keep)))
                    kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)]))
                sha = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(sha), pa.array([k.decode() for k in kept], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that start earlier."""
    return dedup_substrings(load(spark, sf_dir, "documents")).drop("kept")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20),
windows AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h FROM starts),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS rn FROM windows) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(k.txt, '') END AS txt
  FROM w LEFT JOIN lists USING (doc_id)
  LEFT JOIN (
    SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS txt
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w) e
    ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
  ) k ON w.doc_id = k.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(txt) AS kept_sha256 FROM kept
"""
