"""Streaming queries over the driver's events, run until their source is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, graph
from ..streaming import logs, timeline as live, visited
from . import adapters as a
from .time_queries import ORACLES as _BATCH


def stream_assign(spark, d):
    """Nearest-centroid assignment of an embedding stream, appended and resumable."""
    items = a.items(spark, d)
    centres = graph.materialize(cluster.centroids(items))
    work = graph.work_folder(spark, "assign")
    schema = a.table(spark, d, "embeddings").schema

    def stage(batch):
        rows = batch.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        return cluster.assign(rows, centres, 0.35).withColumnRenamed("id", "vec_id")

    source = f"{d}/embeddings.parque[t]"  # a pattern: streams read folders or patterns, not single files
    out = logs.drain(spark, source, schema, f"{work}/log", f"{work}/checkpoint", stage, key="vec_id")
    return out.select(F.col("vec_id").alias("id"), F.col("cluster").cast("long").alias("cluster"))


def stream_sessions(spark, d):
    """Per-user sessions of the event stream, with all rows however late, so it equals the batch result."""
    schema = a.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.date_trunc("second", "ts"))
    out = logs.fold_sessions(events, "user_id", "ts", "6 hours", graph.work_folder(spark, "sessions"))
    return out.select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"))


def stream_timeline(spark, d):
    """The timeline in append mode, photos in four files, closed by a sentinel: equal to the batch result."""
    work = graph.work_folder(spark, "live")
    photos = a.photos(spark, d).select("path", "taken_at", "has_face")
    photos.repartitionByRange(4, "taken_at").write.parquet(f"{work}/in")
    sentinel = F.lit(live.SENTINEL).cast("timestamp_ntz")
    stream = spark.readStream.schema(photos.schema).option("maxFilesPerTrigger", 2)
    live.run_heads(stream.parquet(f"{work}/in"), f"{work}/run", "10 minutes", "3650 days")
    photos.limit(1).select(F.lit(None).cast("string").alias("path"), sentinel.alias("taken_at"), "has_face").write.mode("append").parquet(f"{work}/in")
    found, _, _ = live.run_heads(stream.parquet(f"{work}/in"), f"{work}/run", "10 minutes", "3650 days")
    return found.select("id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "photo_count", "cover")


def stream_visits(spark, d):
    """Captions measured once a document; texts without a word fail, and are tried again in a second run."""
    work = graph.work_folder(spark, "visits")
    schema = a.table(spark, d, "documents").select("doc_id", "text").schema

    def measure(rows):
        if not rows["text"].iloc[0] or len(rows["text"].iloc[0].split()) < 40:
            raise ValueError("too few words")
        return rows.assign(words=rows["text"].str.split().str.len().astype("int64"))

    a.table(spark, d, "documents").select("doc_id", "text").write.parquet(f"{work}/in")
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{work}/in")
        log = visited.drain(visited.visit(stream, measure, "doc_id long, words long", "doc_id"), f"{work}/out", f"{work}/checkpoint")
        a.table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", "text").write.mode("append").parquet(f"{work}/in")
    done = visited.finished(log).select("doc_id", "words", F.lit(None).cast("int").alias("tries"))
    return done.union(visited.open_failures(log, "doc_id").select("doc_id", F.lit(None).cast("long"), "tries"))


QUERIES = {f.__name__: f for f in (stream_assign, stream_sessions, stream_timeline, stream_visits)}

_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"

ORACLES = {
    "stream_timeline": f"SELECT id, start, \"end\", photo_count, cover FROM ({_BATCH['timeline_events']}) JOIN ({_BATCH['timeline_cover']}) USING (id)",
    "stream_visits": f"""SELECT doc_id, CASE WHEN n >= 40 THEN n END AS words, CASE WHEN n < 40 THEN CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END END AS tries
        FROM (SELECT doc_id, coalesce({_WORDS}, 0)::BIGINT AS n FROM documents)""",
    "stream_sessions": _BATCH["timeline_windows"],
    "stream_assign": f"SELECT id, cluster FROM ({_BATCH['nearest_centroid_assign']})",
}
