"""Arrow batch helpers for the vectorised stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Text bytes handled at once; bounds a worker's arrays however long its partition is.
SLICE_BYTES = 6 << 20
#: Rows of whole texts that Spark hands to Python at once, in place of its own default of 10,000.
TEXT_ROWS = 1500
ROWS_KEY, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to TEXT_ROWS rows, unless it was set to something else.

    Batches of texts are held whole on both sides of the pipe, two or three times over.
    """
    if spark.conf.get(ROWS_KEY, DEFAULT_ROWS) in (None, DEFAULT_ROWS):
        spark.conf.set(ROWS_KEY, str(TEXT_ROWS))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column as plain strings; null reads as empty."""
    return pc.fill_null(pc.cast(batch.column(name), pa.large_string()), "")


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of about ``limit`` bytes of ``name``; a longer row comes alone."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), dtype=np.int64)
    bins = (np.cumsum(sizes) - 1).clip(0) // limit
    cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield batch.slice(low, high - low)
    pa.default_memory_pool().release_unused()


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length of every row, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sum_by_row(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; an empty run gives zero."""
    if len(lengths) == 0:
        return np.zeros(0, dtype=values.dtype)
    ends = np.cumsum(lengths)
    totals = np.concatenate([np.zeros(1, dtype=np.result_type(values, np.int64)), np.cumsum(values)])
    return totals[ends] - totals[ends - lengths]


class TwoGenerations(dict):
    """A cache of bounded size: when the young half is full it becomes the old half.

    Entries used since the last turn move to the young half and survive it.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def find(self, key):
        value = self.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
