"""Resumable ingestion into append tables, and sessions over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.tables import read_parquet


def drain(spark: SparkSession, source: str, schema, target: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame], key: str = "path", files_per_batch: int | None = None) -> DataFrame:
    """Process the files of ``source`` that earlier runs have not, and append to ``target``.

    ``stage`` maps a batch to result rows that carry ``key``.  Keys already in the target are skipped,
    so a batch that is run again after a failure adds nothing twice.  Returns the whole target once
    the source is drained; final aggregates belong after it.
    """
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def append(batch: DataFrame, _: int) -> None:
        done = existing(spark, target)
        fresh = batch if done is None else batch.join(done.select(key).distinct(), key, "left_anti")
        stage(fresh.dropDuplicates([key])).write.mode("append").parquet(target)

    query = stream.parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else None


def merged_sessions(rows: DataFrame, owner: str, gap: str) -> DataFrame:
    """``rows(owner, start, end, n)`` joined per owner where no more than ``gap`` lies between them."""
    order = Window.partitionBy(owner).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("before", before)
    first = F.when(F.col("before").isNull() | (F.col("start") > F.col("before") + F.expr(f"INTERVAL {gap}")), F.col("start"))
    marked = marked.withColumn("first", F.max(first).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(owner, "first").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("first")


def fold_sessions(stream: DataFrame, owner: str, time: str, gap: str, work: str) -> DataFrame:
    """``(owner, n, start, end)`` of all rows that the stream has brought, however late, once its source is drained.

    Each batch joins the sessions so far with its rows into a table under its number, so a batch that
    runs again replaces its own; nothing passes through the driver.  Rows without a time are dropped.
    """
    spark = stream.sparkSession
    shape = f"`{owner}` {stream.schema[owner].dataType.simpleString()}, start timestamp, end timestamp, n long"

    def fold(batch: DataFrame, number: int) -> None:
        moment = F.col(time).cast("timestamp")
        fresh = batch.where(moment.isNotNull()).groupBy(owner, moment.alias("start")).agg(F.count("*").alias("n"))
        known = read_parquet(spark, f"{work}/sessions/{number - 1}", shape)
        both = known.unionByName(fresh.withColumn("end", F.col("start")))
        merged_sessions(both, owner, gap).write.mode("overwrite").parquet(f"{work}/sessions/{number}")
        spark.createDataFrame([(number,)], "last long").coalesce(1).write.mode("overwrite").parquet(f"{work}/folded")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = read_parquet(spark, f"{work}/folded", "last long").first()  # one row
    return read_parquet(spark, f"{work}/sessions/{last['last'] if last else -1}", shape).select(owner, "n", "start", "end")
