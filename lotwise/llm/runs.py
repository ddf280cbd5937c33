"""Periodic runs of words: maximal pairs of an LCP-interval tree.

A run of smallest period q from s to e is the maximal pair (s, s + q) of length e - s - q: what follows both places is
equal so far and no further, and their left words differ. With a length of at least max(LEAST, FOLD * q), what repeats
has at least LEAST - LEAST // FOLD words, so only LCP intervals of that depth are built, and a pair's distance is at most
1 / (FOLD - 1) of its length.

1. Documents that repeat no such stretch (by hashes, which may let more through but never fewer) have no runs.
2. The others' words get numbers, a document's own ones, and their repeated suffixes are sorted by prefix doubling.
3. The interval tree is climbed bottom-up. An interval lists its places; those of its smaller child are compared with
   the places next to them in the larger one, if their left-word classes differ. Pairs that keep the constraints are
   runs: nothing is extended. Between s and s + q no other place starts with the same words (q would not be the smallest
   period), so neighbours are enough. Multiples of q give the same stretch; the smallest period stays.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, load
from .textvec import Words, mix, text_chunks

LEAST, FOLD = 24, 3
_DEPTH = LEAST - LEAST // FOLD
_BASE = 0x9E3779B97F4A7C15 | 1


def repeating_rows(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows in which a stretch of _DEPTH words may occur twice."""
    n = len(h) - _DEPTH + 1
    if n < 2:
        return np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for j in range(_DEPTH):
        grams = grams * np.uint64(_BASE) + h[j : j + n]
    inside = rows[:n] == rows[_DEPTH - 1 :]
    grams, rows = mix(grams + mix(rows[:n].astype(np.uint64), 3), 4)[inside], rows[:n][inside]
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    return np.unique(rows[twice[at] == grams])


def _suffixes(ids: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next _DEPTH words occur again, by the words from there on, and common words with the place before.

    ids: numbers of words, no two documents sharing one; end: the end of each place's document. A common length is 0
    where the depth isn't reached.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    levels, k = [rank], 1
    todo = np.arange(n)
    while len(todo):
        ahead = todo + k
        inside = ahead < end[todo]
        second = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
        order = np.lexsort((second, rank[todo]))
        a, b, place = rank[todo][order], second[order], todo[order]
        # a group keeps its rank, a later part of it moves up by the places before it: ranks stay in order of words
        head = np.append(True, a[1:] != a[:-1])
        new = head | np.append(True, b[1:] != b[:-1])
        at = np.arange(len(a))
        group, part = (np.maximum.accumulate(np.where(x, at, 0)) for x in (head, new))
        if k == 1:  # ranks count the places before a group, not the groups
            rank = np.empty(n, np.int32)
            rank[place] = group
            levels[0] = rank
            value = part
        else:
            value = a + part - group
        rank = rank.copy()
        rank[place] = value
        k *= 2
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(a)))
        todo = np.sort(place[np.repeat(size > 1, size)])
    deep = levels[min(len(levels) - 1, _DEPTH.bit_length() - 1)]
    order = np.argsort(rank, kind="stable")
    x, y = order[:-1], order[1:]
    common = np.zeros(n, np.int64)
    near = np.flatnonzero(deep[x] == deep[y]) if len(levels) >= _DEPTH.bit_length() else np.zeros(0, np.int64)
    i, j, length = x[near].copy(), y[near].copy(), np.zeros(len(near), np.int64)
    stop = np.append(end, n)
    for level in range(len(levels) - 1, -1, -1):
        r, step = levels[level], 1 << level
        can = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[can] = (r[i[can]] == r[j[can]]) & (i[can] + step <= stop[i[can]]) & (j[can] + step <= stop[j[can]])
        length[same] += step
        i[same] += step
        j[same] += step
    common[near + 1] = np.where(length >= _DEPTH, length, 0)
    keep = (common > 0) | np.append(common[1:] > 0, False)
    return order[keep], common[keep]


def maximal_pairs(places: list[int], common: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, distance, length) of maximal pairs with neighbouring places that keep the constraints.

    places: suffixes in order of their words, common: each one's common words with the one before (0: none that count),
    left: the class of the word before each place.
    """
    found: list[tuple[int, int, int]] = []

    def joined(a: list[int], b: list[int], length: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        reach = length // (FOLD - 1)
        for x in b:
            at = bisect_left(a, x)
            own = left[x]
            if at and x - a[at - 1] <= reach and left[a[at - 1]] != own and x - a[at - 1] + length >= LEAST:
                found.append((a[at - 1], x - a[at - 1], length))
            if at < len(a) and a[at] - x <= reach and left[a[at]] != own and a[at] - x + length >= LEAST:
                found.append((x, a[at] - x, length))
        for x in b:
            a.insert(bisect_left(a, x), x)
        return a

    open_: list[tuple[int, list[int]]] = []
    for x, length in zip(places + [-1], common + [0], strict=True):
        if open_:
            depth, own = open_.pop()  # the newest leaf, whose depth is without bound
            while open_ and open_[-1][0] > length:
                depth, above = open_.pop()
                own = joined(above, own, depth)
            if length:
                if open_ and open_[-1][0] == length:
                    own = joined(open_.pop()[1], own, length)
                open_.append((length, own))
            else:
                yield from found
                found.clear()
        open_.append((1 << 60, [x]))


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, by start, then period; documents are ids[bounds[i]:bounds[i + 1]]."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = np.append(-1, ids[:-1]) if len(ids) else ids
    left[bounds[:-1][np.diff(bounds) > 0]] = -1  # no word stands before a document's first one
    places, common = _suffixes(ids, bounds[1:][rows])
    best: dict[tuple[int, int], int] = {}
    for s, d, length in maximal_pairs(places.tolist(), common.tolist(), left.tolist()):
        stretch = (s, d + length)
        best[stretch] = min(best.get(stretch, d), d)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (s, length), period in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        row = int(rows[s])
        out.setdefault(row, []).append((s - int(bounds[row]), length, period))
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Places of the words that a document of n words shows: a tenth of the ids repeat a stretch to their end."""
    i = np.arange(n)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return i
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i >= a, a + (i - a) % p, i)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the run of greatest length / period), runs and kept of
    every row; kept is the text without the words that repeat a period, joined by single spaces.

    Runs have at least max(24, 3 * period) words. Null and empty texts have no runs and keep the empty string. Rows
    repeating an id are judged one by one; a null doc_id stays null. plant: first make every tenth document periodic
    (those without doc_id never). Empty tables give no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(a, b - a)
                yield _judged(ids, Words(data, offsets), data, plant)

    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long"
    return id_and_text(docs).mapInArrow(run, f"{kinds}, runs array<struct<start:long,length:long,period:long>>, kept string")


def _judged(doc_ids: pa.Array, w: Words, data: np.ndarray, plant: bool) -> pa.RecordBatch:
    shown = np.arange(len(w.starts))
    if plant:
        for row, doc_id in enumerate(doc_ids.to_pylist()):
            lo, n = int(w.bounds[row]), int(w.counts[row])
            if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
                shown[lo : lo + n] = lo + planted(doc_id, n)
    raw = data.tobytes()
    picked = repeating_rows(w.hashes()[shown], w.rows)
    words: dict[tuple[int, bytes], int] = {}
    numbers, bounds = [], [0]
    for row in picked.tolist():
        at = shown[w.bounds[row] : w.bounds[row + 1]]
        for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True):
            numbers.append(words.setdefault((row, raw[s:e]), len(words)))
        bounds.append(len(numbers))
    found = runs_of(np.array(numbers, np.int64), np.array(bounds)) if len(picked) else {}
    found = {int(picked[k]): v for k, v in found.items()}
    columns: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs", "kept")}
    for row in range(len(w.counts)):
        runs = found.get(row, [])
        lo, n = int(w.bounds[row]), int(w.counts[row])
        gone = np.zeros(n + 1, np.int64)
        top = None
        for s, length, q in runs:
            gone[s + q] += 1
            gone[s + length] -= 1
            if top is None or length * top[2] > top[1] * q:
                top = (s, length, q)
        at = shown[lo : lo + n][np.cumsum(gone[:-1]) == 0] if runs else shown[lo : lo + n]
        columns["n_runs"].append(len(runs))
        for name, value in zip(("start", "length", "period", "exponent_milli"), (*top, 1000 * top[1] // top[2]) if top else (None,) * 4, strict=True):
            columns[name].append(value)
        columns["runs"].append([{"start": s, "length": length, "period": q} for s, length, q in runs])
        columns["kept"].append(b" ".join([raw[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]).decode())
    long, one = pa.int64(), pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = {"runs": pa.list_(one), "kept": pa.string()}
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(v, kinds.get(k, long)) for k, v in columns.items())], ["doc_id", *columns])


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, every tenth of them made periodic first, with digests of the runs and of what is kept."""
    out = periodic_runs(load(spark, sf_dir, "documents"), plant=True)
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    return out.selectExpr(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        f"sha2({lines}, 256) AS runs_sha256", "sha2(kept, 256) AS collapsed_sha256",
    )
