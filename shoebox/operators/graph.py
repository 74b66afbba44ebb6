"""Components and dense numbering for cluster operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_KEY = "spark.checkpoint.dir"


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; on a single machine a temporary folder stands in where none is set."""
    root = spark.conf.get(_KEY, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_KEY} has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shoebox-")
        spark.conf.set(_KEY, root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so later steps neither recompute nor lose it."""
    spark = df.sparkSession
    path = work_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of ``edges(a, b)``: labels sink to the smallest neighbour, then jump.

    Each round takes every node's smallest neighbouring label and then that label's own label, so
    long chains shorten by half.  Ends when no label changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        step = materialize(met.join(jump, "via", "left").select("node", "was", F.least("via", F.coalesce("far", "via")).alias("component")))
        labels = step.select("node", "component")
        if not step.where("was <> component").limit(1).count():
            return labels


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """``column`` with its dense rank from 0: counted per range, then offset by the ranges before."""
    ranged = materialize(rows.select(column).repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"), F.min(column).alias("low"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return ranged.withColumn("i", inside).join(F.broadcast(offsets), "_p").select(column, (F.col("base") + F.col("i")).alias("rank"))
