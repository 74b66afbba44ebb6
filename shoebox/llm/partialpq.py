"""Product codes over integers, with nearest entries found by partial distances.

Components become integers, vectors are cut into equal parts, and every part position has a small
codebook refined by Lloyd's rounds in integer arithmetic, so results are exact and do not depend on
how rows are dealt out.

The nearest entry of a codebook is searched entry by entry for many vectors at once.  A distance is
summed over one dimension at a time, those in which the codebook's entries differ most first, and a
mask drops the vectors whose sum so far strictly exceeds their best complete distance.  An equal
sum goes on, so that ties are settled by the lower index.

A round reads the vectors, and its tasks send one row for each part, entry and dimension.  What the
driver holds is a codebook: parts x entries x dimensions integers, whatever the number of vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``floor(SCALE * x)``, shorter vectors filled up with zeros to ``width``.

    Components so large that a squared distance would leave 64 bits stand at the last value that
    does not.
    """
    sizes = np.asarray(pc.list_value_length(column), dtype=np.int64)
    flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE)
    most = math.isqrt((1 << 62) // max(width, 1)) // 2
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(flat, -most, most).astype(np.int64)
    return out


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of each row's nearest entry, its squared distance, component differences taken).

    The first complete distance is that to an entry next to the row in the leading dimension.
    """
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = np.ascontiguousarray(x[:, order].T), book[:, order]
    dims, rows = x.shape
    along = np.argsort(book[:, 0], kind="stable")
    best = along[np.searchsorted(book[along, 0], x[0]).clip(max=len(book) - 1)]
    least, taken = np.zeros(rows, dtype=np.int64), rows * dims
    for d in range(dims):
        least += (x[d] - book[best, d]) ** 2
    begun = best.copy()
    for entry in range(len(book)):
        alive = np.flatnonzero(begun != entry)
        total = np.zeros(len(alive), dtype=np.int64)
        for d in range(dims):
            taken += len(alive)
            total += (x[d, alive] - book[entry, d]) ** 2
            stay = total <= least[alive]
            if not stay.all():
                alive, total = alive[stay], total[stay]
                if not len(alive):
                    break
        better = (total < least[alive]) | (entry < best[alive])
        best[alive[better]], least[alive[better]] = entry, total[better]
    return best, least, taken


@dataclass
class Codebooks:
    """``books``: parts x entries x dimensions, integers."""

    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), both rows x parts."""
        step = self.books.shape[2]
        found = [nearest_entries(x[:, i * step:(i + 1) * step], book) for i, book in enumerate(self.books)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def text(self) -> str:
        """All components in decimal, by part, entry and position, joined by commas."""
        return ",".join(map(str, self.books.ravel().tolist()))


def sound(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, vec, label)`` of the rows whose vector is not null and has neither null nor non-finite components."""
    vec = F.col(vec_col).cast("array<double>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), vec.alias("vec"), F.col(label_col).alias("label")).where(F.col("vec").isNotNull() & ~odd)


def _sums(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """For each part and entry: the number of its parts, then the sum of each component (as Python integers)."""
    parts, entries, step = books.books.shape

    def run(batches):
        total = np.zeros((parts, entries, step + 1), dtype=object)
        for batch in batches:
            x = integers(batch.column("vec"), books.width)
            codes, _ = books.assign(x)
            for p in range(parts):
                at = np.argsort(codes[:, p], kind="stable")
                used, begin = np.unique(codes[at, p], return_index=True)
                if len(used):
                    total[p, used, 0] += np.diff(begin, append=len(at)).astype(object)
                    total[p, used, 1:] += np.add.reduceat(x[at, p * step:(p + 1) * step], begin, axis=0).astype(object)
        where = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*[pa.array(w.astype(np.int32)) for w in where], pa.array([str(v) for v in total.ravel()])], names=["part", "entry", "place", "total"])

    found = rows.select("vec").mapInArrow(run, "part int, entry int, place int, total string").groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = np.zeros((parts, entries, step + 1), dtype=object)
    for r in found.collect():
        out[r["part"], r["entry"], r["place"]] = int(r["total"])
    return out


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``rows(id, vec)``, from the vectors of the smallest ids; None without rows.

    Ties between equal ids go by the vector; null ids come last.  If lengths differ, the longest counts.
    """
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return None
    step = max(1, -(-longest // parts))
    begin = rows.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").toArrow()["vec"].combine_chunks()
    x = integers(begin, parts * step)
    books = Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, step).transpose(1, 0, 2)))
    for _ in range(rounds):
        sums = _sums(rows, books)
        count = np.maximum(sums[:, :, :1], 1)
        moved = (sums[:, :, 1:] // count).astype(np.int64)
        books = Codebooks(np.where(sums[:, :, :1] > 0, moved, books.books))
    return books


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """``(vec_id, label, code binary, error)`` and the codebooks behind the codes.

    ``code`` holds an entry's index a part.  Vectors that are null or hold null or non-finite
    components are left out; repeated rows stay.  Vectors shorter than the longest, and a length that
    does not divide into the parts, are filled up with zeros.  An empty table gives an empty result.
    """
    rows = sound(vectors, id_col, vec_col, label_col)
    schema = T.StructType([T.StructField("vec_id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    books = fit_codebooks(rows, parts, entries, rounds)
    if books is None:
        return rows.sparkSession.createDataFrame([], schema), None

    def run(batches):
        for batch in batches:
            codes, errors = books.assign(integers(batch.column("vec"), books.width))
            raw = [r.tobytes() for r in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(raw, pa.binary()), pa.array(errors.sum(axis=1), pa.int64())], names=schema.names)

    return rows.select("id", "label", "vec").mapInArrow(run, schema), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the sum of ``error`` over rows of an equal label, nulls together.

    Sums are made before the shuffle; a label that many rows share is joined as a small table, or
    split by the adaptive join.  A sum that leaves 64 bits is null.
    """
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
