"""Thumbnails kept in a table, converted again only when their image has changed.

A thumbnail is keyed by the hash of its image's path and its width.  A refresh compares modification
times, which are narrow columns, and loads and converts only what is missing or older than its image.
New rows are appended; the latest of a key counts, and compaction drops the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .images import thumbnail_key
from .tables import read_parquet

CACHE = "key string, path string, width int, modified timestamp, content binary"
#: The least and the largest width of a thumbnail.
LEAST, MOST = 64, 1024


def clamped(width: int) -> int:
    return max(LEAST, min(MOST, width))


def load_file(path: str) -> bytes:
    """The bytes of a file by its URI; a bare path is local."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with files.open_input_stream(at) as source:
        return source.read()


def _key(width: int) -> Column:
    return thumbnail_key(F.col("path"), F.lit(clamped(width)))


def stale(images: DataFrame, cache: DataFrame, width: int) -> DataFrame:
    """``images(path, modified)`` without a thumbnail of this width, or with one older than the image."""
    kept = cache.groupBy("key").agg(F.max("modified").alias("made"))
    return images.withColumn("key", _key(width)).join(kept, "key", "left").where(F.col("made").isNull() | (F.col("made") < F.col("modified"))).drop("made")


def refresh(images: DataFrame, cache: str, width: int, convert: Callable[[bytes, int], bytes], load: Callable[[str], bytes] = load_file) -> int:
    """Bring the thumbnails of ``images(path, modified)`` up to date; the number converted.

    An image that cannot be loaded or converted gets no row and is tried again by the next refresh.
    """
    spark, wide = images.sparkSession, clamped(width)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for path in frame["path"]:
                try:
                    made.append(convert(load(path), wide))
                except Exception:  # one image stops no other
                    made.append(None)
            yield frame.assign(width=wide, content=made)[["key", "path", "width", "modified", "content"]]

    old = stale(images.select("path", "modified"), read_parquet(spark, cache, CACHE), wide)
    counted = F.count_if(F.col("content").isNotNull())
    before = read_parquet(spark, cache, CACHE).agg(counted.alias("n")).first()["n"]
    old.select("key", "path", "modified").mapInPandas(run, CACHE).where("content is not null").write.mode("append").parquet(cache)
    return spark.read.schema(CACHE).parquet(cache).agg(counted.alias("n")).first()["n"] - before


def thumbnails(spark: SparkSession, cache: str) -> DataFrame:
    """The latest thumbnail of each key; contents of older ones are not shuffled."""
    rows = read_parquet(spark, cache, CACHE)
    last = rows.groupBy("key").agg(F.max("modified").alias("modified"))
    return rows.join(last, ["key", "modified"], "left_semi").dropDuplicates(["key"])


def compact(spark: SparkSession, cache: str, target: str) -> DataFrame:
    """Write the latest thumbnails to another folder and return them."""
    thumbnails(spark, cache).write.mode("overwrite").parquet(target)
    return read_parquet(spark, target, CACHE)
