"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (surface features, then a learned tanh
layer); gated attention weighs the passages, and the weighted sum is scored by a logistic unit. Only document labels
train it. Features come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .textvec import Words, distinct_per_row, text_chunks

PASSAGE = 64
_KINDS, _BUCKETS = 12, 24
_CLASS = np.full(256, 10, np.uint8)
for _i, _chars in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"'\"-()", b"#$%&*@^~", b"|")
):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 11


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, first passage of each row): every row has a passage, an empty one if it has no words."""
    w = Words(data, offsets)
    per_row = np.maximum(1, -(-w.counts // PASSAGE))
    first = np.cumsum(per_row) - per_row
    n = int(per_row.sum())
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    nth = np.arange(n) - first[row_of]
    # bytes of a passage: from its first word (the row's first passage: from the row's start) to the next one's
    word_at = np.minimum(w.bounds[:-1][row_of] + nth * PASSAGE, max(len(w.starts) - 1, 0))
    start = np.where(nth == 0, offsets[:-1][row_of], w.starts[word_at] if len(w.starts) else 0)
    size = np.diff(np.append(start, len(data)))
    passage = np.repeat(np.arange(n), size)
    kinds = np.bincount(passage * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    share = kinds / np.maximum(1, kinds.sum(1, keepdims=True))
    of_word = first[w.rows] + (np.arange(len(w.rows)) - w.bounds[:-1][w.rows]) // PASSAGE
    words = np.maximum(1, np.bincount(of_word, minlength=n))
    count = lambda mask: np.bincount(of_word[mask], minlength=n) / words
    h, lens = w.hashes(), w.ends - w.starts
    upper = np.append(0, np.cumsum(_CLASS[data] == 1))
    lower = np.append(0, np.cumsum((_CLASS[data] == 0) | (_CLASS[data] == 11)))
    ups, lows = upper[w.ends] - upper[w.starts], lower[w.ends] - lower[w.starts]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    distinct = np.bincount(distinct_per_row(of_word, h)[0], minlength=n) / words
    last = _CLASS[data[w.ends - 1]] if len(h) else np.zeros(0, np.uint8)
    mean = np.bincount(of_word, lens, minlength=n) / words
    shape = [
        mean / 10, np.sqrt(np.bincount(of_word, lens**2, minlength=n) / words) / 10, distinct, count(again),
        count((ups > 0) & (lows == 0)), count((ups == 1) & (lows > 0)), count(lens <= 2), count((lens > 2) & (lens <= 4)),
        count(lens > 12), count(last == 8), count(last == 6), count(last == 5), np.log1p(words) / 5,
        np.log1p(per_row)[row_of] / 5,
    ]
    bucket = np.bincount(of_word * _BUCKETS + (h % np.uint64(_BUCKETS)).astype(np.int64), minlength=n * _BUCKETS)
    bucket = bucket.reshape(n, _BUCKETS) / words[:, None]
    return np.hstack([share, np.stack(shape, 1), bucket]), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class AttentionModel:
    """Passage encoder, gated attention and document score."""

    def __init__(self, dim: int, hidden: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(dim), np.ones(dim)
        self.p = {"E": init(dim, hidden), "e": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate, 1)[:, 0], "s": init(hidden, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        score = (v * u) @ p["w"]
        sizes = np.diff(np.append(first, len(x)))
        grow = np.exp(score - np.repeat(np.maximum.reduceat(score, first), sizes))
        a = grow / np.repeat(np.add.reduceat(grow, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return x, h, v, u, a, z, _sigmoid(z @ p["s"] + p["b"]), sizes

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 160, rate: float = 0.02, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        share = y.mean()
        weight = np.where(y > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) ** 0.5
        weight /= weight.sum()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, rounds + 1):
            xs, h, v, u, a, z, out, sizes = self.forward(x, first)
            p, d = self.p, (out - y) * weight
            g = {"s": z.T @ d, "b": np.array([d.sum()])}
            dz = np.repeat(d[:, None] * p["s"], sizes, axis=0)
            da = (dz * h).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, first), sizes))
            g["w"] = (v * u).T @ ds
            dv, du = ds[:, None] * p["w"] * u * (1 - v**2), ds[:, None] * p["w"] * v * u * (1 - u)
            g["V"], g["U"] = h.T @ dv, h.T @ du
            dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
            g["E"], g["e"] = xs.T @ dh, dh.sum(0)
            for k in p:
                grad = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                q[k] = 0.999 * q[k] + 0.001 * grad**2
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-9)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, first = passage_features(data, offsets)
        return self.forward(x, first)[6]


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, held_out: int = 1) -> AttentionModel | None:
    """Fit on at most ``sample`` labelled documents (smallest hashes of doc_id) with crc32(doc_id) mod 3 != held_out.

    The sample bound is the model's documented limit: 4,000 documents are ample for some 2,500 weights. Whole texts of
    the sample are used. Null labels are left out, a doc_id labelled twice takes the larger label. None without labels.
    """
    of_id = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(of_id != held_out)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(2)):
                x, first = passage_features(data, offsets)
                cuts = np.append(first, len(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x[i:j].astype("<f4").tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                    ["doc_id", "quality", "x"],
                )

    got = sorted(map(tuple, rows.mapInArrow(run, "doc_id long, quality int, x binary").collect()))
    if not got:
        return None
    model = AttentionModel(_KINDS + 14 + _BUCKETS)
    bags = [np.frombuffer(bytes(r[2]), "<f4").reshape(-1, len(model.mean)).astype(np.float64) for r in got]
    sizes = np.array([len(b) for b in bags])
    model.fit(np.vstack(bags), np.cumsum(sizes) - sizes, np.array([float(r[1] > 0) for r in got]))
    return model


def score(docs: DataFrame, model: AttentionModel | None, *keep: str) -> DataFrame:
    """Columns ``keep`` of every row and score in [0, 1] of its whole text; null and empty texts score as an empty passage.

    Without a model (no labels) every score is 0.5. Repeated rows score alike; empty tables give no rows.
    """
    rows = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    schema = rows.drop("__text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(0)):
                s = np.full(b - a, 0.5) if model is None else model.score(data, offsets)
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[1:]] + [pa.array(s)], schema.names)

    return rows.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labels of two thirds of the ids."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, load(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, model, "doc_id").select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
