"""Clusters of vectors: centroids, representatives, nearest assignment, propagation, sampling.

Rows come as ``items(id, vector)``.  Nearest targets are found by matrix products in Arrow batches
where the targets are few, else through an inverted file; density clusters have a module of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors
from . import density, graph, inverted, ranks
from .density import core, core_points, dbscan, neighbours  # noqa: F401

#: Rows of one block of either side.
BLOCK = 4096
#: Targets whose vectors take up to so many bytes go to every task as one table.
SMALL_SIDE = 16 << 20


def centroids(items: DataFrame, key: str = "cluster", normalised: bool = True) -> DataFrame:
    """Mean vector of each cluster, scaled to length one (plus 1e-12) if wanted."""
    means = items.select(key, F.posexplode(vectors.doubles(F.col("vector"))).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    built = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("vector"))
    if not normalised:
        return built
    size = vectors.norm(F.col("vector")) + 1e-12
    return built.withColumn("vector", F.transform("vector", lambda x: x / size))


def representatives(items: DataFrame, per_cluster: int, keep_noise: bool = True) -> DataFrame:
    """``(cluster, id, score, cluster_size)``: members most similar to their centroid.

    Noise (cluster -1) is kept whole with score 1 and no size if wanted.  Ties go to the smaller id.
    """
    real = items.where("cluster <> -1")
    middle = centroids(real).withColumnRenamed("vector", "centre")
    scored = real.join(middle, "cluster").select("cluster", "id", vectors.dot(F.col("vector"), F.col("centre")).alias("score"))
    size = scored.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    # Spark keeps the first rows of each cluster before the shuffle (window group limit)
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "id")
    best = scored.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_cluster).drop("_k").join(size, "cluster")
    if not keep_noise:
        return best
    return best.unionByName(items.where("cluster = -1").select("cluster", "id", F.lit(1.0).alias("score"), F.lit(None).cast("long").alias("cluster_size")))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def nearest(items: DataFrame, targets: DataFrame) -> DataFrame:
    """``(id, target, similarity)``: the target with the highest dot product; ties to the smaller one.

    ``targets(target, vector)``.  Targets of up to SMALL_SIDE bytes of vectors are sent to all tasks
    after they are measured; more of them are searched through an inverted file.  Rows without a
    sound vector are left out.
    """
    kind = targets.schema["target"].dataType
    out = T.StructType([T.StructField("id", items.schema["id"].dataType), T.StructField("target", kind), T.StructField("similarity", T.DoubleType())])
    ordered = density.sound(targets.withColumnRenamed("target", "id")).withColumnRenamed("id", "target")
    size = ordered.agg(F.sum(8 * F.size("vector"))).first()[0]
    rows = density.sound(items)
    if size is None:
        return items.sparkSession.createDataFrame([], out)
    if size <= SMALL_SIDE:
        listed = ordered.groupBy("vector").agg(F.min("target").alias("target")).orderBy("target").collect()
        arrow = to_arrow_type(kind)
        shared = items.sparkSession.sparkContext.broadcast(([r["target"] for r in listed], np.asarray([r["vector"] for r in listed], dtype=np.float64)))

        def best(batches):
            names, side = shared.value
            names = pa.array(names, arrow)
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(low, BLOCK)
                    top, score = inverted.winners(_matrix(part.column("vector")), side)
                    yield pa.RecordBatch.from_arrays([part.column("id"), names.take(pa.array(top)), pa.array(score)], names=out.names)

        return rows.mapInArrow(best, out)
    return inverted.nearest(rows, inverted.build(ordered))


def assign(items: DataFrame, centres: DataFrame, above: float = 0.3) -> DataFrame:
    """Nearest centroid of each unit-normalised item if its similarity exceeds ``above``, else -1."""
    scaled = items.select("id", vectors.unit(F.col("vector")).alias("vector"))
    found = nearest(scaled, centres.select(F.col("cluster").alias("target"), "vector"))
    return found.select("id", F.when(F.col("similarity") > above, F.col("target")).otherwise(F.lit(-1)).alias("cluster"), "similarity")


def propagate(items: DataFrame, seeds: DataFrame, least: float = 0.1) -> DataFrame:
    """Labels from seeds to their nearest neighbours.

    ``seeds(id, label)``; errors and empty labels must be gone.  Returns ``id, seed, label,
    similarity, is_seed, clustered``: seeds belong to themselves with similarity 1, others to the
    nearest seed, and are unclustered if their similarity is below ``least`` (equal stays).
    """
    known = items.join(seeds, "id")
    rest = items.join(seeds.select("id"), "id", "left_anti")
    found = nearest(rest, known.select(F.col("id").alias("target"), "vector")).withColumnRenamed("target", "seed")
    near = F.col("similarity") >= least
    labelled = found.join(seeds.select(F.col("id").alias("seed"), "label"), "seed").select(
        "id", F.when(near, F.col("seed")).alias("seed"), F.when(near, F.col("label")).alias("label"), "similarity", F.lit(False).alias("is_seed"), near.alias("clustered")
    )
    own = known.select("id", F.col("id").alias("seed"), "label", F.lit(1.0).alias("similarity"), F.lit(True).alias("is_seed"), F.lit(True).alias("clustered"))
    return own.unionByName(labelled)


def summary(clustered: DataFrame) -> DataFrame:
    return clustered.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"), F.count_if(F.col("cluster") == -1).alias("n_noise"))


#: Fixed value: restarts of k-means.
RESTARTS = 10


def usual_k(rows: int) -> int:
    """The number of clusters for that many rows if none is asked for: the root of half of them."""
    return max(2, math.isqrt(rows // 2))


def kmeans(items: DataFrame, k: int | None = None, seed: int = 42, rounds: int = 100, restarts: int = RESTARTS) -> DataFrame:
    """``(id, cluster)`` by Euclidean k-means on unit vectors; of several starts the one with the least cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    scaled = items.select("id", array_to_vector(vectors.unit(F.col("vector"))).alias("features"))
    scaled = graph.materialize(scaled)
    rows = scaled.count()
    k = max(1, min(usual_k(rows) if k is None else k, rows))
    models = [KMeans(k=k, seed=seed + i, maxIter=rounds).fit(scaled) for i in range(restarts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    return model.transform(scaled).select("id", F.col("prediction").alias("cluster"))


def seeded_sample(rows: DataFrame, ratio: float, seed: str, key: str = "id") -> DataFrame:
    """Exactly ``max(1, int(n * ratio))`` rows, those with the smallest hash of seed and key."""
    n = rows.count()
    return ranks.first_by_digest(rows, max(1, int(n * ratio)) if n else 0, F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)


def stratified_sample(rows: DataFrame, stratum: str, per_stratum: int, seed: str, key: str = "path") -> DataFrame:
    """``per_stratum`` rows of each stratum, those with the smallest hash of key and seed."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key), F.lit(seed))), key)
    # Spark keeps only the first rows of each group before the shuffle (window group limit)
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_stratum).drop("_k")
