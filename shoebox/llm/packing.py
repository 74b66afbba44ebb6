"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / limit) pieces of ``limit`` tokens and one piece for
each set bit of the rest, longest first.  Pieces of equal length form a bucket, every piece is a
sequence of its own, so no sequence crosses documents and none needs padding.  Training batches
then take sequences from one bucket at a time.

Each document is cut where it is read, so the operator needs no shuffle at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from .batches import bound_batches, slices, text_column
from .bpe_words import with_end, word_encoder

#: Bits of a sequence id: bucket above, then the reading task, then its running number there.
BUCKET_SHIFT, TASK_SHIFT = 58, 34


def power_pieces(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each piece, its length) in document order; ``limit`` is a power of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError(f"limit must be a power of two, not {limit}")
    top = limit.bit_length() - 1
    columns = [lengths >> top] + [(lengths >> k) & 1 for k in range(top - 1, -1, -1)]
    sizes = np.asarray([limit >> k for k in range(top + 1)], dtype=np.int64)
    times = np.stack(columns, axis=1).ravel() if len(lengths) else np.zeros(0, dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), top + 1)
    return np.repeat(rows, times), np.repeat(np.tile(sizes, len(lengths)), times)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document.

    Returns ``doc_id, piece int, start long, length long, ids binary (little-endian uint32),
    doc_tokens long, bucket int (log2 of the length), sequence_id long, offset long``.

    * ``sequence_id`` is unique; its top bits are the bucket, so a bucket is one id range.  It
      depends on how the input is split into partitions, all other columns do not.
    * ``offset`` is 0 and a sequence is exactly as long as its piece.
    * Null and empty texts are the end id alone: one piece of length 1.  Repeated rows are packed
      once each; a null id stays null.  An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("bucket", T.IntegerType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def pack(batches):
        encoder = word_encoder(tokenizer)
        task = TaskContext.get().partitionId()
        used = np.zeros(64, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, counts = with_end(*encoder.encode(text_column(batch, "text")), end_id)
                row, length = power_pieces(counts, limit)
                ends = np.cumsum(length)
                doc_start = (np.cumsum(counts) - counts)[row]
                first = np.searchsorted(row, np.arange(len(counts)))
                piece = np.arange(len(row)) - first[row]
                bucket = np.log2(length).astype(np.int64)
                serial = np.empty(len(row), dtype=np.int64)
                for b in np.unique(bucket):
                    at = np.flatnonzero(bucket == b)
                    serial[at] = used[b] + np.arange(len(at))
                    used[b] += len(at)
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                    pa.array(ends - length - doc_start), pa.array(length), blob, pa.array(counts[row]),
                    pa.array(bucket.astype(np.int32)), pa.array((bucket << BUCKET_SHIFT) | (task << TASK_SHIFT) | serial),
                    pa.array(np.zeros(len(row), dtype=np.int64)),
                ], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(pack, schema)
