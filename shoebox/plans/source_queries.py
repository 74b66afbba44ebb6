"""Sources and sinks over files written from the driver tables: queries with their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, timeline
from ..sources import documents, tables, thumbnails
from . import adapters as a
from .time_queries import ORACLES as _EVENTS


def bundle_append(spark, d):
    """Two scans that overlap: the second adds what the first lacked."""
    bundle = f"{graph.work_folder(spark, 'bundle')}/vectors"
    scan = a.table(spark, d, "embeddings").select(
        F.concat(F.lit("/v/"), "vec_id").alias("path"), F.col("embedding").alias("vector"), F.lit(None).cast(tables.read_bundle(spark, bundle).schema["exif"].dataType).alias("exif"),
        F.lit("m1").alias("model"), F.size("embedding").alias("dim"), "vec_id",
    )
    tables.append_new(scan.where("vec_id % 3 > 0").drop("vec_id"), bundle)
    return tables.append_new(scan.drop("vec_id"), bundle).groupBy("model", F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("rows"), F.count_distinct("path").alias("paths"))


def log_lines(spark, d):
    """A log with broken lines among its rows."""
    path = f"{graph.work_folder(spark, 'log')}/lines"
    whole = F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("path")))
    a.table(spark, d, "events").select(F.when(F.col("event_id") % 9 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value")).write.text(path)
    return tables.read_log(spark, path, "seq long, path string")


def overlay_files(spark, d):
    """A sound overlay of lines, one document over several lines, one with a broken line, and one that is not there."""
    folder = graph.work_folder(spark, "overlays")
    a.names(spark, d).write.json(f"{folder}/sound")
    a.names(spark, d).select(F.concat(F.lit("{"), "id").alias("value")).write.text(f"{folder}/broken")
    read = lambda name: tables.read_overlay(spark, f"{folder}/{name}", "id string, name string").select(F.lit(name).alias("overlay"), "id", "name")
    documents.write_document(a.names(spark, d).select(F.lit("").alias("key"), documents.as_json("id", "name").alias("value")), f"{folder}/document.json", "list")
    return read("sound").unionByName(read("document.json")).unionByName(read("broken")).unionByName(read("absent"))


def curated_files(spark, d):
    """Overlays as documents of their own shapes, written and read back, an absent one among them."""
    folder = graph.work_folder(spark, "curated")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    names = a.names(spark, d).select(F.col("id").alias("key"), quoted(F.col("name")).alias("value"))
    documents.write_document(names, f"{folder}/names.json")
    moved = a.moves(spark, d).orderBy("seq").select(documents.as_json("path", F.col("src").alias("from"), F.col("dst").alias("to")).alias("value"))
    documents.write_document(moved, f"{folder}/moves.json", "list")
    gone = a.removed(spark, d).groupBy("id").agg(F.to_json(F.array_sort(F.collect_set("path"))).alias("value"))
    documents.write_document(gone.withColumnRenamed("id", "key"), f"{folder}/removed.json")
    documents.write_document(a.skipped(spark, d).select(quoted(F.col("id")).alias("value")), f"{folder}/skipped.json", "list")
    read = lambda name, kind: documents.read_curated(spark, f"{folder}/{name}.json", kind)
    out = read("names", "names").select(F.lit("names").alias("overlay"), "id", F.col("name").alias("value"))
    out = out.union(read("moves", "moves").select(F.lit("moves"), "src", F.concat_ws(">", "dst", "path", "seq")))
    out = out.union(read("removed", "removed").select(F.lit("removed"), "id", "path"))
    out = out.union(read("skipped", "skipped").select(F.lit("skipped"), "id", F.lit(None)))
    return out.union(read("absent", "merges").select(F.lit("merges"), "src", "dst"))


_IMAGE = "struct<taken_at:string,location_name:string,face_ids:array<string>>"


def index_document(spark, d):
    """The index and the timeline as single documents, replaced once, and read back."""
    folder = graph.work_folder(spark, "documents")
    index = a.photos(spark, d).select("path", F.col("taken_at").cast("string").alias("taken_at"), "location_name", "face_ids")
    documents.write_index_document(index.limit(1), f"{folder}/index.json", "2024-01-01")
    documents.write_index_document(index, f"{folder}/index.json", "2024-01-02")
    start = F.col("start").cast("string").alias("start")
    photos = graph.materialize(timeline.members(a.photos(spark, d).select("path", "taken_at", "has_face"), "10 minutes"))
    found = graph.materialize(timeline.heads(photos).select("id", start, "cover"))
    documents.write_timeline_document(found, photos.select("id", start, "pos", "path"), f"{folder}/timeline.json", "2024-01-02", 1 / 6, 3)
    images = documents.read_index(spark, f"{folder}/index.json", _IMAGE).select(F.lit("image").alias("part"), "path", F.col("taken_at").alias("at"), F.size("face_ids").cast("long").alias("n"), F.col("location_name").alias("more"))
    told, members = documents.read_timeline_rows(spark, f"{folder}/timeline.json", "struct<id:string,start:string,photos:array<string>,cover:string>")
    told = told.join(members.groupBy("seq").agg(F.count("*").alias("n")), "seq", "left")
    return images.union(told.select(F.lit("event"), "id", "start", F.coalesce("n", F.lit(0).cast("long")), "cover"))


def index_table(spark, d):
    """The stored index, read for one month of one year."""
    path = f"{graph.work_folder(spark, 'index')}/photos"
    tables.write_index(a.photos(spark, d), path)
    return spark.read.parquet(path).where("year = 2024 and month = 1").groupBy("event_type").agg(F.count("*").alias("photos"), F.max("path").alias("last"))


def photo_lookup(spark, d):
    """Single photos from a lookup table over the index: the first of three users, and one that is not there."""
    path = f"{graph.work_folder(spark, 'lookup')}/photos"
    tables.write_lookup(a.photos(spark, d), path)
    firsts = [r["path"] for r in a.photos(spark, d).where("user_id in (1, 2, 3)").groupBy("user_id").agg(F.min("path").alias("path")).collect()]  # three rows
    return tables.look_up(spark, path, [*firsts, "/absent.jpg"]).select("path", "event_id", "location_name")


def thumbnail_cache(spark, d):
    """A thumbnail of every photo; a second refresh makes none, a third only those of changed photos."""
    cache = f"{graph.work_folder(spark, 'thumbs')}/cache"
    images = a.photos(spark, d).select("path", F.col("taken_at").cast("timestamp").alias("modified"), "event_id")
    run = lambda rows: thumbnails.refresh(rows, cache, 2000, lambda content, width: b"%d:" % width + content[-12:], lambda path: path.encode())
    made = [run(images), run(images), run(images.withColumn("modified", F.when(F.col("event_id") % 10 == 0, F.col("modified") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("modified"))))]
    rounds = spark.createDataFrame([(f"round {i}", n, None) for i, n in enumerate(made)], "part string, n long, content string")
    kept = thumbnails.thumbnails(spark, cache).select(F.lit("thumbnail").alias("part"), F.col("width").cast("long").alias("n"), F.col("content").cast("string").alias("content"))
    return rounds.union(kept)


def timeline_table(spark, d):
    """Stored events, read by year."""
    path = graph.work_folder(spark, "timeline")
    photos = graph.materialize(timeline.members(a.photos(spark, d).select("path", "taken_at", "has_face"), "10 minutes"))
    tables.write_timeline(timeline.heads(photos), photos.select("id", "start", "pos", "path"), path)
    return spark.read.parquet(f"{path}/events").where("year = 2024").select("id", "photo_count", "cover")


QUERIES = {f.__name__: f for f in (bundle_append, log_lines, overlay_files, curated_files, index_document, index_table, photo_lookup, thumbnail_cache, timeline_table)}

ORACLES = {
    "bundle_append": "SELECT 'm1' AS model, CAST(len(embedding) AS BIGINT) AS dim, count(*) AS rows, count(DISTINCT vec_id) AS paths FROM embeddings GROUP BY 1, 2",
    "log_lines": "SELECT event_id AS seq, event_type AS path FROM events WHERE event_id % 9 <> 0",
    "overlay_files": f"{a.with_(a.NAMES)} SELECT overlay, id, name FROM names, (VALUES ('sound'), ('document.json')) t(overlay)",
    "curated_files": f"""{a.with_(a.PHOTOS, a.NAMES, a.MOVES, a.REMOVED, a.SKIPPED)} SELECT 'names' AS overlay, id, name AS value FROM names
        UNION ALL SELECT 'moves', src, dst || '>' || path || '>' || (row_number() OVER (ORDER BY seq) - 1) FROM moves
        UNION ALL SELECT DISTINCT 'removed', id, path FROM removed UNION ALL SELECT 'skipped', id, NULL FROM skipped""",
    "index_document": f"""{a.with_(a.PHOTOS)} SELECT 'image' AS part, path, strftime(taken_at, '%Y-%m-%d %H:%M:%S') AS "at", len(face_ids)::BIGINT AS n, location_name AS more FROM photos
        UNION ALL SELECT 'event', id, start, photo_count, cover FROM ({_EVENTS['timeline_events']}) JOIN ({_EVENTS['timeline_cover']}) USING (id)""",
    "index_table": f"{a.with_(a.PHOTOS)} SELECT event_type, count(*) AS photos, max(path) AS last FROM photos WHERE year = 2024 AND month = 1 GROUP BY 1",
    "photo_lookup": f"{a.with_(a.PHOTOS)} SELECT path, event_id, location_name FROM photos WHERE path IN (SELECT min(path) FROM photos WHERE user_id IN (1, 2, 3) GROUP BY user_id)",
    "thumbnail_cache": f"""{a.with_(a.PHOTOS)} SELECT 'round 0' AS part, count(*) AS n, NULL AS content FROM photos UNION ALL SELECT 'round 1', 0, NULL
        UNION ALL SELECT 'round 2', count(*), NULL FROM photos WHERE event_id % 10 = 0 UNION ALL SELECT 'thumbnail', 1024, '1024:' || right(path, 12) FROM photos""",
    "timeline_table": f"SELECT id, photo_count, cover FROM ({_EVENTS['timeline_events']}) JOIN ({_EVENTS['timeline_cover']}) USING (id) WHERE substr(id, 5, 4) = '2024'",
}
