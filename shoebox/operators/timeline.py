"""Events of photos close in time, and what a viewer sees of them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import access, geocode, graph

#: Fixed value: an event needs this many visible photos to show.
VISIBLE_LEAST = 3
#: Positions of one part of an event in which its middle is looked for.
MIDDLE_ROWS = 4096


def _ticks(photos: DataFrame, gap: str, owner: str | None) -> DataFrame:
    """Distinct times ``(owner, taken_at, n, day, start)`` with their photos and the first time of their session.

    Breaks are found day by day in parallel; what meets in one task of the whole time axis is one row a day.
    """
    keys, wide = [owner] if owner else [], F.expr(f"INTERVAL {gap}")
    counted = photos.where("taken_at is not null").groupBy(*keys, "taken_at").agg(F.count("*").alias("n"))
    ticks = graph.materialize(counted.withColumn("day", F.to_date("taken_at")))
    over_days = Window.partitionBy(*keys).orderBy("day")  # one row a day
    days = ticks.groupBy(*keys, "day").agg(F.max("taken_at").alias("last")).select(*keys, "day", F.lag("last").over(over_days).alias("previous"))
    in_day = Window.partitionBy(*keys, "day").orderBy("taken_at")
    marked = ticks.join(days, [*keys, "day"]).withColumn("before", F.coalesce(F.lag("taken_at").over(in_day), "previous"))
    breaks = F.col("before").isNull() | (F.col("taken_at") > F.col("before") + wide)
    marked = graph.materialize(marked.withColumn("own", F.max(F.when(breaks, F.col("taken_at"))).over(in_day)).select(*keys, "taken_at", "n", "day", "own"))
    # a day begins in the session that the days before it leave open
    left = marked.groupBy(*keys, "day").agg(F.max("own").alias("last")).select(*keys, "day", F.max("last").over(over_days.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return marked.join(left, [*keys, "day"]).select(*keys, "taken_at", "n", "day", F.coalesce("own", "carried").alias("start"))


def sessions(photos: DataFrame, gap: str = "6 hours", owner: str | None = None) -> DataFrame:
    """Photos with ``start``, the first time of their session.

    A gap longer than ``gap`` ends a session.  The library's whole timeline has one time axis, so
    without ``owner`` sessions are found on distinct times only.  Photos without a time are dropped.
    """
    keys = [owner] if owner else []
    starts = _ticks(photos, gap, owner).select(*keys, "taken_at", "start")
    return photos.where("taken_at is not null").join(starts, [*keys, "taken_at"])


def _shape(start: str = "start", end: str = "end") -> list[Column]:
    return [F.concat(F.lit("evt_"), F.date_format(start, "yyyyMMdd_HHmmss")).alias("id"), F.greatest(F.lit(1), F.datediff(end, start) + 1).alias("duration_days")]


def spans(photos: DataFrame, gap: str = "6 hours", least: int = 3, owner: str | None = None) -> DataFrame:
    """Events without their photos: ``id, start, end, duration_days, photo_count``, from distinct times alone."""
    keys = [owner] if owner else []
    found = _ticks(photos, gap, owner).groupBy(*keys, "start").agg(F.max("taken_at").alias("end"), F.sum("n").alias("photo_count")).where(F.col("photo_count") >= least)
    ident, days = _shape()
    return found.select(*keys, ident, "start", "end", days, "photo_count")


def members(photos: DataFrame, gap: str = "6 hours", least: int = 3, owner: str | None = None) -> DataFrame:
    """Photos of events of at least ``least``: their columns, ``id, start, end, duration_days, photo_count`` and ``pos``.

    Positions go by time, ties by path.  They are sums over days, then over the times of a day, then
    over the photos of one time, so an event of any size is numbered in parallel.
    """
    keys = [owner] if owner else []
    ticks = _ticks(photos, gap, owner)
    whole = Window.partitionBy(*keys, "start")
    days = ticks.groupBy(*keys, "start", "day").agg(F.sum("n").alias("in_day"), F.max("taken_at").alias("last"))  # one row a day
    days = days.select(
        *keys, "start", "day", F.coalesce(F.sum("in_day").over(whole.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
        F.sum("in_day").over(whole).alias("photo_count"), F.max("last").over(whole).alias("end"),
    ).where(F.col("photo_count") >= least)
    times = Window.partitionBy(*keys, "start", "day").orderBy("taken_at").rowsBetween(Window.unboundedPreceding, -1)
    based = ticks.join(days, [*keys, "start", "day"]).withColumn("base", F.col("earlier") + F.coalesce(F.sum("n").over(times), F.lit(0)))
    found = photos.where("taken_at is not null").join(based.select(*keys, "taken_at", "start", "end", "photo_count", "base"), [*keys, "taken_at"])
    same = Window.partitionBy(*keys, "taken_at").orderBy("path", "has_face")
    ident, length = _shape()
    return found.withColumn("pos", F.col("base") + F.row_number().over(same) - 1).select(*photos.columns, ident, "start", "end", length, "photo_count", "pos")


def heads(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events of :func:`members` without their photos, with ``cover``: the middle photo, or the one with a face nearest to it."""
    off = F.abs(F.col("pos") - F.floor(F.col("photo_count") / 2))
    rank = F.struct(F.when(F.col("has_face"), 0).otherwise(1), off, "pos")
    return rows.groupBy(*keys, "id", "start", "end", "duration_days", "photo_count").agg(F.min_by("path", rank).alias("cover"))


#: Paths that stand in one piece of an event's text.
PIECE = 64


def pieces(rows: DataFrame, keys: tuple[str, ...] = ("id",), between: str = ",", path: Column | None = None) -> DataFrame:
    """``(keys, piece, text)``: the paths of an event in order, joined within pieces of bounded size."""
    at = F.floor(F.col("pos") / PIECE).alias("piece")
    shown = F.col("path") if path is None else path
    listed = rows.where(shown.isNotNull()).groupBy(*keys, at).agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("path")))).alias("l"))
    return listed.select(*keys, "piece", F.array_join(F.transform("l", lambda r: r["path"]), between).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """``(id, photos_md5)``: the digest of an event's paths joined by commas.

    A digest is sequential: the pieces of one event pass through one task, sorted, a batch at a time.
    """
    ordered = pieces(rows).repartition("id").sortWithinPartitions("id", "piece")

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                if ident != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = ident, hashlib.md5()
                else:
                    state.update(b",")
                state.update(text.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["id", "photos_md5"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["id", "photos_md5"])

    return ordered.select("id", "text").mapInArrow(run, "id string, photos_md5 string")


def session_windows(photos: DataFrame, gap: str, owner: str) -> DataFrame:
    """The same sessions per owner by the built-in session window; also valid on streams."""
    return photos.groupBy(owner, F.session_window("taken_at", gap).alias("w")).agg(F.count("*").alias("n"), F.min("taken_at").alias("start"), F.max("taken_at").alias("end")).drop("w")


def top_names(rows: DataFrame, keys: list[str], value: str, n: int = 3) -> DataFrame:
    """Per key the ``n`` most frequent values; ties by first position, then value."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first", value)
    # Spark keeps only the first rows of each key before the shuffle (window group limit)
    best = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(value).alias("v")))), lambda t: t["v"]).alias("top"))


def _cover(order: Column) -> Column:
    """Middle photo, or the one with a face nearest to it; ``order`` is sorted (.., path, has_face)."""
    middle = F.floor(F.size(order) / 2).cast("int")
    placed = F.transform(order, lambda r, i: F.struct(F.abs(i - middle).alias("off"), i.alias("i"), r["path"].alias("path"), r["has_face"].alias("has_face")))
    faced = F.array_sort(F.filter(placed, lambda r: r["has_face"]))
    return F.coalesce(F.try_element_at(faced, F.lit(1))["path"], F.get(order, middle)["path"])


def events(photos: DataFrame, gap: str = "6 hours", least: int = 3, owner: str | None = None) -> DataFrame:
    """One row per session of at least ``least`` photos, with all of its photos in the row.

    :func:`heads` and :func:`members` give the same for events that are too large for a row.
    ``photos(path, taken_at, has_face)``; returns ``id, start, end, duration_days, photo_count,
    photos, cover``.  Photos are in time order, ties by path.
    """
    keys = [owner] if owner else []
    grouped = sessions(photos, gap, owner).groupBy(*keys, "start").agg(
        F.max("taken_at").alias("end"), F.array_sort(F.collect_list(F.struct("taken_at", "path", "has_face"))).alias("order")
    )
    kept = grouped.where(F.size("order") >= least)
    days = F.greatest(F.lit(1), F.datediff("end", "start") + 1)
    return kept.select(
        *keys, F.concat(F.lit("evt_"), F.date_format("start", "yyyyMMdd_HHmmss")).alias("id"), "start", "end", days.alias("duration_days"),
        F.size("order").alias("photo_count"), F.transform("order", lambda r: r["path"]).alias("photos"), _cover(F.col("order")).alias("cover"),
    )


def event_photos(found: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per photo of an event with its position."""
    return found.select(*keys, F.posexplode("photos").alias("pos", "path"))


def _seen(rows: DataFrame, index: DataFrame, pets: DataFrame, perms: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    shown = rows.join(index, "path", "left").join(pets, "path", "left").crossJoin(F.broadcast(perms.limit(1)))  # one row
    return shown.where(access.can_see(F.col("path"), F.coalesce("face_ids", none), F.coalesce("pet_ids", none)))


def viewer_events(found: DataFrame, photos: DataFrame, index: DataFrame, pets: DataFrame, perms: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Events as the one viewer of ``perms`` sees them.

    ``found`` are :func:`heads`, ``photos(id, pos, path)`` their photos.  Fewer than three visible
    photos hide an event.  Counts, tops and cover come from visible photos only; start, end and
    duration stay.  ``index(path, face_ids, location_name)``, ``pets(path, pet_ids)``.
    ``words(word, translation)`` translates the top places once they are chosen.
    """
    none = F.array().cast("array<string>")
    found = graph.materialize(found)
    seen = graph.materialize(_seen(photos.select("id", "pos", "path"), index, pets, perms).select("id", "pos", "path", "face_ids", "location_name"))
    # the middle of the visible photos: by counts of parts of the event, then within one part
    part = F.floor(F.col("pos") / MIDDLE_ROWS)
    whole = Window.partitionBy("id")
    parts = seen.groupBy("id", part.alias("part")).agg(F.count("*").alias("n")).withColumn("shown", F.sum("n").over(whole))
    parts = parts.withColumn("before", F.sum("n").over(whole.orderBy("part")) - F.col("n")).withColumn("middle", F.floor(F.col("shown") / 2))
    holds = parts.where((F.col("shown") >= VISIBLE_LEAST) & (F.col("before") <= F.col("middle")) & (F.col("middle") < F.col("before") + F.col("n")))
    near = seen.select("id", "pos", "path", part.alias("part")).join(holds, ["id", "part"]).withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1)
    kept = near.where(F.col("k") == F.col("middle")).select("id", F.col("shown").alias("photo_count"), F.col("path").alias("middle"))
    covers = seen.select("id", F.col("path").alias("cover")).join(found.select("id", "cover"), ["id", "cover"], "left_semi").distinct().withColumnRenamed("cover", "seen_cover")
    tops = top_names(seen.select("id", "pos", F.explode("face_ids").alias("face")), ["id"], "face").withColumnRenamed("top", "top_faces")
    places = top_names(seen, ["id"], "location_name").withColumnRenamed("top", "top_places")
    if words is not None:
        spots = geocode.translated(places.select("id", F.posexplode("top_places").alias("pos", "spot")), words, "spot")
        places = spots.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "spot"))), lambda r: r["spot"]).alias("top_places"))  # three an event
    out = found.select("id", "start", "end", "duration_days").join(kept, "id").join(covers, "id", "left").join(tops, "id", "left").join(places, "id", "left")
    return out.select(
        "id", "start", "end", "duration_days", "photo_count", F.coalesce("top_faces", none).alias("top_faces"),
        F.coalesce("top_places", none).alias("top_places"), F.coalesce("seen_cover", "middle").alias("cover"),
    )


def event_detail(photos: DataFrame, event_id: str, index: DataFrame, pets: DataFrame, perms: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Photos of one event that the one viewer of ``perms`` sees, with time and place, in order.

    ``photos(id, pos, path)``.  A photo that the index lacks has neither faces nor place.
    ``pets(path, pet_ids)``; places are translated by ``words(word, translation)``.
    """
    seen = _seen(photos.where(F.col("id") == event_id).select("pos", "path"), index, pets, perms)
    return geocode.translated(seen.select("pos", "path", "taken_at", "location_name"), words)


def overview(index: DataFrame, pets: DataFrame, perms: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Photos with a time that the one viewer of ``perms`` may see, newest first, in a slim form; places are translated."""
    none = F.array().cast("array<string>")
    rows = index.where("taken_at is not null").join(pets, "path", "left").crossJoin(F.broadcast(perms.limit(1)))  # one row
    seen = rows.where(access.can_see(F.col("path"), F.coalesce("face_ids", none), F.coalesce("pet_ids", none)))
    return geocode.translated(seen.select("path", "taken_at", "year", "month", "location_name"), words).orderBy(F.desc("taken_at"), "path")
