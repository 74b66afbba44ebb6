"""Face clusters of a whole library from a sample of it, in three phases.

Faces come as ``faces(id, path, stratum, vector)``, one row a detection.  A fixed number of photos of
each stratum is clustered by density; then every face goes to the nearest cluster centroid.  Only
the second phase compares faces with each other, and only the sampled ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors
from . import cluster, graph
from .labels import pending

#: Photos of a stratum, reach and neighbours of the density clusters, and the least similarity to a centroid.
PER_STRATUM, EPS, LEAST, ABOVE = 8, 0.4, 2, 0.3
UNKNOWN = "unknown"


def sampled_centroids(faces: DataFrame, seed: str, per_stratum: int = PER_STRATUM, eps: float = EPS, least: int = LEAST) -> DataFrame:
    """``(cluster, vector)``: unit centroids of the density clusters among the sampled photos' faces."""
    photos = faces.select("path", "stratum").distinct()
    chosen = cluster.stratified_sample(photos, "stratum", per_stratum, seed).select("path")
    sample = graph.materialize(faces.join(chosen, "path", "left_semi").select("id", vectors.unit(F.col("vector")).alias("vector")))
    labelled = cluster.dbscan(sample, eps, least).where("cluster <> -1")
    return graph.materialize(cluster.centroids(sample.join(labelled, "id")))


def assign_faces(faces: DataFrame, centres: DataFrame, above: float = ABOVE) -> DataFrame:
    """``(id, path, face_id, cluster, similarity)``; faces near no centroid are ``unknown``, cluster -1."""
    if centres.isEmpty():
        return faces.select("id", "path", F.lit(UNKNOWN).alias("face_id"), F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("similarity"))
    found = cluster.assign(faces.select("id", "vector"), centres, above)
    name = F.when(F.col("cluster") >= 0, F.concat(F.lit("face_"), F.col("cluster").cast("string"))).otherwise(F.lit(UNKNOWN))
    return faces.select("id", "path").join(found, "id").select("id", "path", name.alias("face_id"), "cluster", "similarity")


def three_phases(faces: DataFrame, seed: str, done: DataFrame | None = None, most: int = 0, **options) -> DataFrame:
    """Sample, cluster, assign.  Photos in ``done(path)`` are left out, and with ``most`` the rest waits for another run."""
    centres = sampled_centroids(faces, seed, **{k: v for k, v in options.items() if k != "above"})
    new = faces
    if done is not None or most:
        waiting = pending(faces.select("path").distinct(), done if done is not None else faces.select("path").limit(0), most=most or None)
        new = faces.join(waiting.select("path"), "path", "left_semi")
    return assign_faces(new, centres, options.get("above", ABOVE))
