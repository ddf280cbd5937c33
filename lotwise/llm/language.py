"""Language ID by prediction by partial matching over bytes.

Every language has a context tree of depth ``order`` (contexts of two, one and no bytes by default) with counts of the
bytes that followed. A byte's exact code length follows PPM method C with exclusion: seen bytes share N of N + q parts,
q parts escape to the shorter context without the bytes already excluded, and the last resort is uniform over the rest of
the 256 byte values. What is stored are sorted arrays of the contexts that occur. The statistics are frozen before
scoring, so the code lengths of all (context, byte) of training are tabled once; a text's language is the one that codes
it shortest, its score that language's posterior under equal priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .textvec import text_chunks

MAX_LANGS, MAX_ORDER = 256, 6


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte below the ``order`` bytes before it in its row (0 before the first)."""
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.int64)
    for k in range(1, order + 1):
        out[k:] |= np.where(inside[k:] >= k, data[:-k], 0).astype(np.int64) << (8 * k)
    return out


def count_contexts(docs: DataFrame, order: int = 2) -> DataFrame:
    """(lang, code, n): occurrences of each byte after ``order`` others, the byte in the code's lowest eight bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def squeeze(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            return codes[first], np.add.reduceat(counts, first)

        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                mine = batch.column(1).filter(pa.array(langs == lang))
                for _, _, data, offsets in text_chunks(mine):
                    if not len(data):
                        continue
                    held.setdefault(lang, []).append(np.unique(_codes(data, offsets, order), return_counts=True))
                if len(held.get(lang, ())) > 16:
                    held[lang] = [squeeze(lang)]
        for lang in held:
            codes, counts = squeeze(lang)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))],
                ["lang", "code", "n"],
            )

    return docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of values at each."""
    keys, of = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(of, weights=v, minlength=len(keys)) for v in values)


def _found(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values at the wanted keys, 0 where there is no such key."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return [np.where(keys[at] == wanted, v[at], 0) for v in values]


class Lengths:
    """Code lengths of one language by PPM-C with exclusion, from sorted codes (context and byte) and their counts."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, order: int, size: int = 256):
        self.order, self.levels = order, []
        shorter = None
        for k in range(order + 1):
            entries, counts = _sums(codes & ((1 << 8 * (k + 1)) - 1), n)
            # what a context excludes one level down: its bytes stand there too, with their counts of that level
            below = _found(*shorter[:1], entries & ((1 << 8 * k) - 1), shorter[1])[0] if k else np.zeros(len(entries))
            contexts = _sums(entries >> 8, counts, np.ones(len(entries)), below)
            self.levels.append((entries, counts, contexts))
            shorter = entries, counts
        self.rest = np.log2(max(1, size - len(self.levels[0][0])))

    def of(self, codes: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        gone_n, gone_q = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(self.order, -1, -1):
            entries, counts, (contexts, *sums) = self.levels[k]
            total, kinds, below = _found(contexts, (codes >> 8) & ((1 << 8 * k) - 1), *sums)
            n, q = total - gone_n, kinds - gone_q
            (count,) = _found(entries, codes & ((1 << 8 * (k + 1)) - 1), counts)
            here = open_ & (count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(here, out + np.log2(n + q) - np.log2(count), out)
                open_ &= ~here
                out = np.where(open_ & (q > 0), out + np.log2(n + q) - np.log2(q), out)
            gone_n, gone_q = below, kinds
        return out + np.where(open_, self.rest, 0.0)


def code_lengths(c3: np.ndarray) -> np.ndarray:
    """Bits of byte s after (x, y) for counts c3[x, y, s] over an alphabet of that size."""
    x, y, s = (i.ravel() for i in np.indices(c3.shape))
    codes, n = (x << 16) | (y << 8) | s, c3.ravel()
    return Lengths(codes[n > 0], n[n > 0], 2, c3.shape[0]).of(codes).reshape(c3.shape)


class LanguageModel:
    """Frozen statistics: the languages, their trees, and the code lengths of what occurs in any language."""

    def __init__(self, rows: list[tuple[str, int, int]], order: int = 2):
        self.langs, self.order = sorted({r[0] for r in rows}), order
        code = np.array([r[1] for r in rows], dtype=np.int64)
        n = np.array([r[2] for r in rows], dtype=np.int64)
        number = {name: i for i, name in enumerate(self.langs)}
        lang = np.array([number[r[0]] for r in rows])
        self.trees = [Lengths(code[lang == i], n[lang == i], order) for i in range(len(self.langs))]
        self.codes = np.unique(code)
        self.table = self._lengths(self.codes)

    def _lengths(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t.of(codes) for t in self.trees], 1)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row's whole text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if len(data):
            codes = _codes(data, offsets, self.order)
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            each = self.table[at]
            new = np.flatnonzero(self.codes[at] != codes)
            if len(new):
                kinds, of = np.unique(codes[new], return_inverse=True)
                each[new] = self._lengths(kinds)[of]
            full = np.flatnonzero(np.diff(offsets))
            out[full] = np.add.reduceat(each, offsets[:-1][full], axis=0)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = self.bits(data, offsets)
        best = bits.argmin(1)
        gap = bits - bits.min(1, keepdims=True)
        return best, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)


def train(docs: DataFrame, held_out: int = 2, order: int = 2) -> LanguageModel | None:
    """Statistics of all rows with text, lang and doc_id whose crc32(doc_id) mod 4 is not held_out; None without any.

    Counts are summed in Spark; a sum for each context and byte that occurs, at most 256^(order + 1), for each of at most
    MAX_LANGS languages (else ValueError) is read. An order from 0 to MAX_ORDER; 2 is less than a three-byte character.
    """
    if not 0 <= order <= MAX_ORDER:
        raise ValueError(f"order {order} is not from 0 to {MAX_ORDER}")
    of_id = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(of_id != held_out)
    counts = count_contexts(rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), order)
    got = [tuple(r) for r in counts.collect()]
    if len({r[0] for r in got}) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return LanguageModel(got, order) if got else None


def identify(docs: DataFrame, model: LanguageModel | None, *keep: str) -> DataFrame:
    """Columns ``keep`` of every row, lang_pred and score of its whole text.

    `und` with score 0 if the text is null or has no letter, or without a model. Ties go to the first language by name.
    Repeated rows are predicted alike; empty tables give no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"), *keep)
    schema = rows.drop("__text", "__letters").schema.add("lang_pred", "string").add("score", "double")
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a code length a language for each code that occurs in any

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch.column(0), 1 << 19):
                best, share = m.predict(data, offsets) if m else (np.zeros(b - a, int), np.zeros(b - a))
                ok = letters[a:b] & (m is not None)
                names = pa.array([m.langs[i] if k else "und" for i, k in zip(best, ok, strict=True)], pa.string())
                columns = [c.slice(a, b - a) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*columns, names, pa.array(np.where(ok, share, 0.0))], schema.names)

    return rows.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from three quarters of the ids."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, train(docs), "doc_id").select("doc_id", held.alias("held_out"), "lang_pred", "score")
