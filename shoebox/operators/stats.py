"""Counts over the index, clusters and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import paths


def index_stats(index: DataFrame) -> DataFrame:
    """One row: photos in all, with time, with position, with faces."""
    return index.agg(
        F.count("*").alias("total"), F.count_if(F.col("taken_at").isNotNull()).alias("with_time"),
        F.count_if(F.col("location").isNotNull()).alias("with_gps"), F.count_if(F.size("faces") > 0).alias("with_faces"),
    )


def cluster_counts(detections: DataFrame, names: DataFrame) -> DataFrame:
    """One row: face clusters there are, and faces with a name."""
    total = detections.agg(F.count_distinct("face_id").alias("face_clusters_total"))
    return total.crossJoin(names.where("name <> ''").agg(F.count_distinct("id").alias("face_clusters_named")))  # one row each


def detection_totals(detections: DataFrame) -> DataFrame:
    """One row: images with a face, faces, faces of no cluster (``face_id`` null), clusters."""
    return detections.agg(
        F.count_distinct("path").alias("n_images"), F.count("*").alias("n_faces"), F.count_if(F.col("face_id").isNull()).alias("n_noise"), F.count_distinct("face_id").alias("n_clusters"),
    )


def time_sources(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("source").agg(F.count("*").alias("n"))


def top_folders(files: DataFrame, depth: int = 6) -> DataFrame:
    """Photos below each folder of ``depth`` parts, most first; skipped paths left out."""
    shown = files.where(~paths.is_skipped(F.col("path"))).select(paths.top_folder(F.col("path"), depth).alias("path")).where("path is not null")
    return shown.groupBy("path").agg(F.count("*").alias("count"))


def months(index: DataFrame, shown: int = 3) -> DataFrame:
    """Photos of each month with its number of places and the first ones by name."""
    grouped = index.where("taken_at is not null").groupBy("year", "month").agg(F.count("*").alias("photos"), F.array_sort(F.collect_set("location_name")).alias("all_places"))
    return grouped.select("year", "month", "photos", F.size("all_places").alias("n_places"), F.array_join(F.slice("all_places", 1, shown), ", ").alias("places"))


def event_years(events: DataFrame) -> DataFrame:
    return events.groupBy(F.year("start").alias("year")).agg(F.count("*").alias("events"))


def cluster_infos(detections: DataFrame, key: str = "face_id") -> DataFrame:
    """Per cluster: detections, distinct images, and its images in first-seen order."""
    by_image = detections.groupBy(key, "path").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return by_image.groupBy(key).agg(
        F.sum("n").alias("detections"), F.count("*").alias("images"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda r: r["path"]).alias("paths")
    )


def faces_of_images(detections: DataFrame) -> DataFrame:
    """Per image: its detections in order."""
    return detections.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "face_id", "det_score"))).alias("faces"))


def best_detection(detections: DataFrame, key: str = "face_id", score: str = "det_score") -> DataFrame:
    """Highest score of each cluster; the first one seen on a tie."""
    best = F.max_by(F.struct("path", score, "seq"), F.struct(F.col(score), -F.col("seq")))
    return detections.groupBy(key).agg(best.alias("b")).select(key, "b.path", f"b.{score}", "b.seq")


def best_of_first_images(detections: DataFrame, images: int = 5) -> DataFrame:
    """Best detection of each cluster among its first images."""
    seen = detections.groupBy("face_id", "path").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("face_id").orderBy("seq", "path")
    early = seen.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= images).select("face_id", "path")  # window group limit
    return best_detection(detections.join(early, ["face_id", "path"]))
