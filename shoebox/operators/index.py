"""The photo index: captions joined with EXIF, positions, places, faces and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo, times
from . import geocode, labels as label_ops, overlay


def captions(rows: DataFrame) -> DataFrame:
    """One caption per path: the last row wins, rows with an error are dropped first."""
    return label_ops.last_row_wins(rows.where("error is null").select("path", F.col("text").alias("label"), "file_no", "seq"), "path", ["file_no", "seq"]).select("path", "label")


def faces_by_path(placed: DataFrame) -> DataFrame:
    """Faces of each photo in detection order as ``array<struct<id,name,det_score>>``."""
    face = F.struct("seq", F.struct(F.col("face_id").alias("id"), "name", "det_score").alias("f"))
    return placed.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(face)), lambda r: r["f"]).alias("faces"))


def build_index(label_rows: DataFrame, exif: DataFrame, placed: DataFrame, cities: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Index of the labelled photos.

    ``exif(path, exif_time, lat, lng, modified)``, one row per path (the last bundle wins before);
    ``placed(path, seq, face_id, name, det_score)`` with overlays applied.  Only captioned paths are
    in the index.  Write it partitioned by ``year``.
    """
    base = captions(label_rows).join(exif, "path", "left").join(faces_by_path(placed), "path", "left")
    when = times.resolved_time(F.col("exif_time"), F.col("path"), F.col("modified"))
    out = base.withColumn("when", when).select(
        "path", "label", F.coalesce("faces", F.from_json(F.lit("[]"), "array<struct<id:string,name:string,det_score:double>>")).alias("faces"),
        F.col("when.time").alias("taken_at"), F.year("when.time").alias("year"), F.month("when.time").alias("month"), F.col("when.source").alias("time_source"),
        "lat", "lng", F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), geo.coordinate_key(F.col("lat"), F.col("lng"))).alias("location"),
    )
    if cities is None:
        return out.withColumn("location_name", F.lit(None).cast("string"))
    named = geocode.place_names(out.where("location is not null").select("lat", "lng"), cities, overrides)
    return out.join(named, "location", "left")


def list_faces(placed: DataFrame, names: DataFrame, limit: int, named: bool | None = None, shown: int = 5) -> DataFrame:
    """Clusters by number of detections, with their first images; ``named`` keeps only (un)named ones."""
    seen = placed.groupBy("face_id", "path").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    counts = seen.groupBy("face_id").agg(F.sum("n").alias("count"))
    # Spark keeps the first images of each cluster before the shuffle (window group limit), so the lists are short
    early = seen.withColumn("_k", F.row_number().over(Window.partitionBy("face_id").orderBy("seq", "path"))).where(F.col("_k") <= shown)
    info = early.groupBy("face_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda r: r["path"]).alias("images"))
    rows = counts.join(info, "face_id").join(names.select(F.col("id").alias("face_id"), "name"), "face_id", "left")
    if named is not None:
        rows = rows.where(F.col("name").isNotNull() if named else F.col("name").isNull())
    return rows.orderBy(F.desc("count"), "face_id").limit(limit)


apply_overlays = overlay.apply_overlays
