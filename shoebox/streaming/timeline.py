"""The timeline over a stream of photos, in append mode: an event is written once, when it is closed.

Each batch takes the photos that wait in open sessions and the new ones, cuts them into sessions and
writes those that no later photo may join.  The boundary is the latest time seen before the batch less
the allowed lateness; photos older than it are kept apart.  A sentinel, a row without a path and with a
time behind all photos, closes what is open.  Every table is written under its batch's number, so a
batch that runs again replaces its own files and nothing is written twice.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import timeline
from ..sources.tables import read_parquet

#: Time of a sentinel row.
SENTINEL = "9999-12-31 00:00:00"


def _fold(spark: SparkSession, work: str, photos: DataFrame, batch: int, gap: str, late: str, least: int) -> None:
    clock, here = "latest timestamp_ntz", f"batch={batch}"
    seen = _stored(spark, f"{work}/seen/{batch - 1}", clock).first()
    real = photos.where("path is not null and taken_at is not null")
    back = lambda time, *spans: functools.reduce(lambda t, span: t - F.expr(f"INTERVAL {span}"), spans, F.lit(time).cast("timestamp_ntz"))
    on_time = real
    if seen and seen["latest"]:
        border = back(seen["latest"], late)
        on_time = real.where(F.col("taken_at") >= border)
        real.where(F.col("taken_at") < border).write.mode("overwrite").parquet(f"{work}/late/{here}")
    now = max((t for t in (seen and seen["latest"], photos.agg(F.max("taken_at")).first()[0]) if t), default=None)
    waiting = _stored(spark, f"{work}/open/{batch - 1}", photos.schema)
    held = timeline.members(waiting.unionByName(on_time), gap, 1)
    marked = held.withColumn("closed", F.col("end") < back(now, late, gap)).persist()
    marked.where("not closed").select(*photos.columns).write.mode("overwrite").parquet(f"{work}/open/{batch}")
    done = marked.where("closed").where(F.col("photo_count") >= least)
    timeline.heads(done).write.mode("overwrite").parquet(f"{work}/events/{here}")
    done.select("id", "pos", "path").write.mode("overwrite").parquet(f"{work}/photos/{here}")
    marked.unpersist()
    spark.createDataFrame([(now,)], clock).coalesce(1).write.mode("overwrite").parquet(f"{work}/seen/{batch}")


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    return read_parquet(spark, path, schema)


HEADS = "id string, start timestamp_ntz, end timestamp_ntz, duration_days int, photo_count long, cover string"


def run_events(stream: DataFrame, work: str, gap: str = "6 hours", late: str = "1 day", least: int = 3, stop: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, late photos) of :func:`run_heads`, events with all of their photos in the row."""
    found, photos, late_rows = run_heads(stream, work, gap, late, least, stop)
    listed = photos.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda r: r["path"]).alias("photos"))
    return found.join(listed, "id"), late_rows


def run_heads(stream: DataFrame, work: str, gap: str = "6 hours", late: str = "1 day", least: int = 3, stop: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, their photos, late photos) once the source of ``stream(path, taken_at, has_face)`` is drained.

    ``work`` holds the checkpoint and all tables; a run goes on where the one before ended or failed.
    Events are those of :func:`timeline.heads` over the photos that were not late, as far as they are
    closed; photos are ``(id, pos, path)``.  ``stop(batch)`` is called behind each batch and may raise, for tests.
    """
    spark = stream.sparkSession

    def fold(photos: DataFrame, batch: int) -> None:
        photos = photos.select("path", F.col("taken_at").cast("timestamp_ntz").alias("taken_at"), "has_face").persist()
        try:
            _fold(spark, work, photos, batch, gap, late, least)
        finally:
            photos.unpersist()
        if stop:
            stop(batch)

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    late_rows = _stored(spark, f"{work}/late", "path string, taken_at timestamp_ntz, has_face boolean").select("path", "taken_at", "has_face")
    photos = _stored(spark, f"{work}/photos", "id string, pos long, path string").select("id", "pos", "path")
    return _stored(spark, f"{work}/events", HEADS).select("id", "start", "end", "duration_days", "photo_count", "cover"), photos, late_rows
