"""Substring search through an inverted index of character trigrams.

A text's lower-cased characters, closed by two terminators, give one trigram at each position; a trigram
is kept as one number, so that all trigrams that begin with one or two given characters are a range of
numbers.  Postings ``(gram, id)`` are stored sorted by gram, then id, and a search reads the row groups
that hold its grams.  Terms of three characters or more intersect the postings of their rarest
trigrams, shorter ones unite a range; what is left is verified against the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import graph

#: Bits of a character; Unicode needs 21.
BITS = 21
#: Trigrams of a term that are intersected at most, the rarest ones; the rest is left to the verification.
INTERSECTED = 4


def codes(text: str) -> np.ndarray:
    """The trigrams of a lower-cased text in order, one a character."""
    points = np.frombuffer((text + "\0\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return (points[:-2] << (2 * BITS)) | (points[1:-1] << BITS) | points[2:]


@dataclass
class TrigramIndex:
    """``postings(gram, id)``, ``counts(gram, n)`` and ``rows(id, text)``, all stored."""

    postings: DataFrame
    counts: DataFrame
    rows: DataFrame


def build(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> TrigramIndex:
    """The index of the texts; null and empty texts have no postings.  Ids are unique."""
    spark = rows.sparkSession
    texts = graph.materialize(rows.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("id", texts.schema["id"].dataType)])

    def post(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                found = [np.unique(codes(t)) for t in batch.column("text").to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column("id").take(pa.array(at))], names=schema.names)

    path = graph.work_folder(spark, "trigrams")
    texts.mapInArrow(post, schema).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.option("parquet.block.size", 8 << 20).parquet(path)
    postings = spark.read.schema(schema).parquet(path)
    return TrigramIndex(postings, graph.materialize(postings.groupBy("gram").agg(F.count("*").alias("n"))), texts)


def candidates(index: TrigramIndex, term: str) -> DataFrame:
    """``(id)`` of the texts that may hold the lower-cased ``term``; a term of one or two characters certainly."""
    if not term:
        return index.rows.select("id")
    if len(term) < 3:
        low, width = int(codes(term)[0]), 1 << ((3 - len(term)) * BITS)
        return index.postings.where((F.col("gram") >= low) & (F.col("gram") < low + width)).select("id").distinct()
    grams = sorted({int(c) for c in codes(term)[:-2]})
    # a row for each trigram of the term
    rare = index.counts.where(F.col("gram").isin(grams)).orderBy("n", "gram").collect()
    if len(rare) < len(grams):
        return index.rows.select("id").limit(0)
    chosen = [r["gram"] for r in rare[:INTERSECTED]]
    return index.postings.where(F.col("gram").isin(chosen)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen)).select("id")


def search(index: TrigramIndex, term: str, meter=None) -> DataFrame:
    """``(id)`` of the texts that contain ``term``, without regard to case.

    ``meter``, an accumulator, counts the texts that were verified.
    """
    lowered = index.rows.sparkSession.range(1).select(F.lower(F.lit(term))).first()[0]
    near = candidates(index, lowered)
    if len(lowered) < 3:
        return near
    held = index.rows.join(near, "id", "left_semi")
    if meter is not None:
        meter.add(held.count())
    return held.where(F.contains("text", F.lit(lowered))).select("id")
