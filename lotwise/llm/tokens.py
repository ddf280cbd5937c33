"""Token-ID output: public tokenizer, Simple-8b segments in ascending doc_id order, and the reader of those files.

A file is a Parquet file of segments. A segment holds whole documents in order: their ids and token counts, and all
their token ids as Simple-8b words with block offsets (see simple8b). (part, seq) orders the segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import id_and_text, load, shared_dir
from .encoder import ChunkEncoder
from .textvec import text_chunks

SEGMENTS = (
    "part int, seq int, n_docs int, n_ids long, doc_ids binary, known binary, lengths binary, words binary, offsets binary"
)
CHUNK = 1 << 19  # bytes of text encoded at a time: a worker holds some fifty times this beside its memory of units
_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def encode_segments(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 19) -> DataFrame:
    """Segments of all documents in ascending doc_id (null last, ties by text); each document ends with end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, end_id) not in _ENCODERS:
            _ENCODERS[tokenizer, end_id] = ChunkEncoder(tokenizer, end_id)
        enc = _ENCODERS[tokenizer, end_id]
        part, seq = TaskContext.get().partitionId(), 0
        docs_, held, lengths, size = [], [], [], 0  # of the segment under way: doc_ids, ids and their counts, piece by piece

        def flush():
            sizes, ids = np.concatenate(lengths).astype("<u4"), np.concatenate(held).astype(np.uint64)
            doc = pa.concat_arrays(docs_)
            words, offsets = simple8b.encode(ids)
            row = {
                "part": [part], "seq": [seq], "n_docs": [len(doc)], "n_ids": [len(ids)],
                "doc_ids": [doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
                "known": [doc.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes()],
                "lengths": [sizes.tobytes()], "words": [words.astype("<u8").tobytes()], "offsets": [offsets.astype("<u4").tobytes()],
            }
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
                ids, counts = enc.encode(data, offsets)
                ends, done = np.cumsum(counts), 0  # done: documents of this chunk that are in a segment
                while done < b - a:
                    base = int(ends[done - 1]) if done else 0
                    full = int(np.searchsorted(ends, base + segment_ids - size)) + 1  # with the document that fills the segment
                    last = min(full, b - a)
                    docs_.append(batch.column(0).slice(a + done, last - done))
                    held.append(ids[base : ends[last - 1]])
                    lengths.append(counts[done:last])
                    size, done = size + int(ends[last - 1]) - base, last
                    if size >= segment_ids:
                        yield flush()
                        docs_, held, lengths, size, seq = [], [], [], 0, seq + 1
        if docs_:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    return id_and_text(docs).repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(run, SEGMENTS)


def read_segments(segments: DataFrame) -> DataFrame:
    """Documents of written segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                words, offsets = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4")
                ids = simple8b.decode(words, offsets, r["n_ids"]).astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, lengths, strict=True)]
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["known"], "u1") == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc), r["part"], np.int32)), pa.array(np.full(len(doc), r["seq"], np.int32)),
                        doc, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    docs = segments.mapInArrow(run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # starts: sums of the parts first (a row for each written part), then of the segments of each part
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seq_base")).join(sums, "part")
    return docs.join(bases, ["part", "seq"]).select(
        "doc_id", F.expr("part_base + seq_base + inside").alias("start"), "n_tokens", "ids_crc32"
    )


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 19) -> None:
    """Encode all documents and write their segments to path (a folder all executors share)."""
    encode_segments(docs, tokenizer, end_id, segment_ids).write.parquet(path)


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files in the shared folder and describe every document from what is read back.

    Null and empty texts have the end id only. A null doc_id sorts last and stays null; repeated doc_ids follow each
    other by text, each with a row; an empty table writes no segment and gives no rows. Whole texts are encoded.
    """
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_segments(spark.read.schema(SEGMENTS).parquet(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token index of all documents, read back from their Simple-8b files."""
    return token_index(load(spark, sf_dir, "documents"), default_tokenizer())
