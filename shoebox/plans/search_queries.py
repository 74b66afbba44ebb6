"""Search, index, functions and statistics: queries with their oracle."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from ..functions import boxes, geo, paths, text, times
from ..operators import cluster, geocode, index as index_ops, inverted, labels, search, stats, trigrams
from . import adapters as a


def vector_topk(spark, d):
    items = a.items(spark, d).select(F.col("id").alias("path"), "vector")
    return search.vector_top_k(items, a.query_vector(spark, d), 20).select(F.col("path").alias("id"), F.round("score", 6).alias("score"))


def inverted_topk(spark, d):
    """The same search over a stored inverted file, list by list."""
    file = inverted.build(a.items(spark, d).select(F.col("id").alias("target"), "vector"))
    return inverted.top_k(file, a.query_vector(spark, d), 20)[0].select(F.col("target").alias("id"), F.round("similarity", 6).alias("score"))


def inverted_nearest(spark, d):
    """Two thirds of the vectors, each with its nearest one of the others."""
    items = a.items(spark, d)
    file = inverted.build(items.where("id % 3 = 0").select(F.col("id").alias("target"), "vector"))
    return inverted.nearest(items.where("id % 3 > 0"), file).select("id", "target", F.round("similarity", 6).alias("similarity"))


#: A phrase, an ending, an accent alone, two characters, a mark, and a term that no text holds.
_TERMS = ["that the", "ing.", "é", "qu", "@", "zzzzq"]


def substring_index(spark, d):
    """Substring search in all captions through trigrams."""
    index = trigrams.build(a.table(spark, d, "documents"), "doc_id")
    hits = [trigrams.search(index, term).select(F.lit(term).alias("term"), F.col("id").alias("doc_id")) for term in _TERMS]
    return functools.reduce(DataFrame.union, hits)


def _library(spark, d):
    vec = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("vector"))
    exif = F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss").alias("exif_time")
    return a.photos(spark, d).join(vec, "event_id").select("path", "vector", exif, F.col("event_type").alias("make"), F.concat(F.lit("K"), "k").alias("model"), "event_id")


def _captions(spark, d):
    doc = a.table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "text")
    return a.photos(spark, d).join(doc, "event_id").select("path", "text", F.col("event_id").alias("seq"))


def hybrid_search(spark, d):
    out = search.hybrid_search(_library(spark, d), a.query_vector(spark, d, 1), "the ere", _captions(spark, d), k=15, weight=0.6)
    return out.select("path", F.round("vector_score", 6).alias("vector_score"), "keyword_score", F.round("score", 6).alias("score"))


def hybrid_filtered_date_camera(spark, d):
    out = search.hybrid_search(_library(spark, d), a.query_vector(spark, d, 2), "", None, k=25, since="2024-01-01", until="2024-01-02", camera="CLI")
    return out.select("path", F.round("score", 6).alias("score"))


_LIB = "lib AS (SELECT p.*, CAST(e.embedding AS DOUBLE[]) AS vector, d.text AS label FROM photos p JOIN embeddings e ON e.vec_id = p.event_id LEFT JOIN documents d ON d.doc_id = p.event_id)"
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {})"


def search_index_and_filters(spark, d):
    wanted = search.Filters(path="/click/", face="P5", year=2024, month=1, location="9.0000", query="the")
    return search.search_index(a.index(spark, d), wanted, 50).select("path", F.round("score", 4).alias("score"))


def search_faces_all(spark, d):
    pair = a.photos(spark, d).where("size(face_ids) = 2").agg(F.min(F.col("face_ids")[0]).alias("f")).first()["f"]
    return search.search_index(a.index(spark, d), search.Filters(faces=[pair, "P" + str(int(pair[5:]) + 1)]), 100).select("path", "score")


def search_soft_label(spark, d):
    return search.search_index(a.index(spark, d), search.Filters(query="ING THE", location_name="vie"), 40).select("path", "score")


def build_index_join(spark, d):
    base = a.photos(spark, d)
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "text")
    rows = base.join(docs, "event_id").select("path", "text", F.when(F.col("event_id") % 19 == 0, "failed").alias("error"), F.lit(0).alias("file_no"), F.col("event_id").alias("seq"))
    again = rows.where("seq % 4 = 0").select("path", F.concat(F.lit("R"), "text").alias("text"), "error", F.lit(1).alias("file_no"), "seq")
    exif = base.select("path", F.when(F.col("event_id") % 3 == 0, F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss")).alias("exif_time"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.col("taken_at").alias("modified"))
    placed = a.detections(spark, d).withColumn("name", F.col("face_id"))
    built = index_ops.build_index(rows.unionByName(again), exif, placed)
    return built.select("path", F.length("label").cast("long").alias("label_length"), F.array_join(F.transform("faces", lambda f: f["id"]), ",").alias("faces"), F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken_at"), "time_source", F.col("year").cast("long").alias("year"))


def index_stats(spark, d):
    counts = stats.cluster_counts(a.detections(spark, d), a.names(spark, d))
    return stats.index_stats(a.index(spark, d)).crossJoin(counts)  # one row each


def get_photo(spark, d):
    return a.index(spark, d).where(F.col("event_id") == 42).select("path", F.array_join("face_ids", ",").alias("faces"), "location", "location_name", text.preview(F.col("label"), 60).alias("label"))


def list_faces_topn(spark, d):
    out = index_ops.list_faces(a.detections(spark, d), a.names(spark, d), 20)
    return out.select("face_id", "name", "count", F.array_join("images", ",").alias("images"))


def unnamed_faces(spark, d):
    out = index_ops.list_faces(a.detections(spark, d), a.names(spark, d), 30, named=False)
    return out.select("face_id", "count", F.array_join("images", ",").alias("images"))


_FACES = "SELECT face_id, count(*) AS count FROM detections GROUP BY face_id"
_IMAGES = "SELECT face_id, string_agg(path, ',' ORDER BY seq) AS images FROM (SELECT face_id, path, min(seq) AS seq, row_number() OVER (PARTITION BY face_id ORDER BY min(seq)) AS k FROM detections GROUP BY face_id, path) WHERE k <= 5 GROUP BY face_id"


def filename_time_parse(spark, d):
    kind = F.col("event_id") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("/a/IMG_"), F.date_format("taken_at", "yyyyMMdd_HHmmss"), F.lit(".jpg"))).when(kind == 1, F.concat(F.lit("/a/IMG-"), F.date_format("taken_at", "yyyyMMdd"), F.lit("-WA0001.jpg")))
        .when(kind == 2, F.concat(F.lit("/a/"), F.date_format("taken_at", "yyyy-MM-dd HH.mm.ss"), F.lit(".png"))).when(kind == 3, F.lit("/a/20231399.jpg")).otherwise(F.lit("/a/cat.jpg"))
    )
    return a.photos(spark, d).select("event_id", F.date_format(times.filename_time(name), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def path_date_strata(spark, d):
    p = F.col("path")
    odd = F.when(F.col("event_id") % 3 == 0, p).when(F.col("event_id") % 3 == 1, F.concat(F.lit("/x/"), F.lit(2000) + F.col("event_id") % 40, F.lit("/a.jpg"))).otherwise(F.lit("/x/y.jpg"))
    return a.photos(spark, d).select("event_id", times.stratum_date(odd).alias("stratum"), times.compact_date(odd).alias("day"))


def time_fallback_chain(spark, d):
    rows = a.photos(spark, d).select(F.when(F.col("event_id") % 3 == 0, F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss")).alias("e"), F.when(F.col("event_id") % 2 == 0, F.col("path")).otherwise(F.lit("/q/none.jpg")).alias("p"), F.when(F.col("event_id") % 5 != 0, F.col("taken_at")).alias("m"))
    return stats.time_sources(rows.select(times.resolved_time(F.col("e"), F.col("p"), F.col("m")).alias("r")).select("r.source"))


def gps_decimal(spark, d):
    """Positions of all orders, as degrees, minutes and seconds or as one number, some of them out of range or missing."""
    k = F.col("o_orderkey")
    parts = lambda most: F.when(k % 4 == 0, F.array((k % most).cast("double"))).when(k % 11 > 0, F.array((k % most).cast("double"), (k % 60).cast("double"), (k % 59).cast("double")))
    p = geo.position(parts(95), F.when(k % 3 == 0, "s").otherwise("N"), parts(185), F.when(k % 5 == 0, "W"))
    return a.table(spark, d, "orders").select(k.alias("id"), p.alias("p")).select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


def _towns(spark, d):
    n = a.table(spark, d, "nation")
    return n.select((F.col("n_nationkey") * 3.5 - 40).alias("lat"), (F.col("n_nationkey") * 7.25 - 80).alias("lng"), F.col("n_name").alias("city"), F.concat(F.lit("c"), "n_regionkey").alias("cc"))


def reverse_geocode_distinct(spark, d):
    points = a.table(spark, d, "supplier").select(((F.col("s_suppkey") % 30) * 2.5 - 35).alias("lat"), ((F.col("s_suppkey") % 20) * 9.5 - 90).alias("lng"))
    over = spark.createDataFrame([("-35.0000,-90.0000", "Home")], "location string, name string")
    return geocode.place_names(points, _towns(spark, d), over)


def place_translate(spark, d):
    words = spark.createDataFrame([("NATION_1", "一"), ("NATION_2, R2", "二全"), ("NATION_2", "二")], "word string, translation string")
    places = a.table(spark, d, "nation").select(F.concat("n_name", F.lit(", R"), "n_regionkey").alias("name"))
    return geocode.translate(places, words)


def skip_path_filter(spark, d):
    p = F.col("path")
    made = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("/lib/@eaDir/"), "page_id")).when(F.col("page_id") % 6 == 1, F.concat(F.lit("/lib/.x/"), "page_id")).when(F.col("page_id") % 6 == 2, F.lit("")).otherwise(paths.url_path(F.col("url")))
    rows = a.table(spark, d, "pages").select("page_id", made.alias("path"))
    return rows.select("page_id", paths.is_skipped(p).alias("skipped"), paths.in_skipped_folder(p).alias("in_skipped_folder"), paths.is_hidden_file(p).alias("hidden"))


def prefilter_reasons(spark, d):
    rows = a.index(spark, d).select(times.compact_date(F.when(F.col("event_id") % 2 == 0, F.col("path")).otherwise(F.lit("/n.jpg"))).alias("day"), "label", "path")
    reason = F.when(paths.is_skipped(F.col("path")), "skip_path").when(F.col("day") < "2024-01-10", "too_old").when(~F.coalesce(F.col("label").rlike("(?i)the|una"), F.lit(False)), "caption").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def top_directories(spark, d):
    rows = a.table(spark, d, "pages").select(F.concat(F.lit("/a/b/c"), paths.url_path(F.regexp_replace("url", "^[a-z]+://", "")), F.lit("/f/g.jpg")).alias("path"))
    return stats.top_folders(rows)


def new_paths_anti(spark, d):
    scanned = a.table(spark, d, "documents").select(F.col("doc_id").alias("path"))
    return labels.pending(scanned, a.table(spark, d, "labels").select(F.col("doc_id").alias("path")))


def _log(spark, d):
    return a.table(spark, d, "conversations").select(F.concat(F.lit("p"), F.col("conv_id") % 40).alias("path"), "text", F.when(F.col("turn") % 3 == 1, "timeout").alias("error"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))


def label_totals(spark, d):
    return labels.totals(_log(spark, d))


def label_latest_success(spark, d):
    return labels.latest_success(_log(spark, d)).select("path", F.md5("text").alias("text_md5"), "seq")




def extract_response_text(spark, d):
    """Texts of responses built around all captions: plain, in segments, in other shapes, and broken."""
    t, k = F.col("text"), F.col("doc_id")
    said = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    segment = lambda kind, text_: F.struct(F.lit(kind).alias("type"), text_.alias("text"))
    response = F.when(k % 5 == 0, said(t)).when(k % 5 == 1, said(F.array(segment("text", t), segment("image", t), segment("text", F.lit("!"))))).when(k % 5 == 2, said(F.lit(7))).when(k % 5 == 3, F.concat(F.lit("{"), t))
    return a.table(spark, d, "documents").where("text is not null").select(k.alias("id"), F.md5(text.response_text(response)).alias("text_md5"))


def stratified_sample(spark, d):
    rows = a.photos(spark, d).withColumn("day", times.stratum_date(F.col("path")))
    return cluster.stratified_sample(rows, "day", 8, "7").select("day", "path")


def random_sample_exact(spark, d):
    return cluster.seeded_sample(a.items(spark, d), 0.13, "s1").select("id")


def path_and_text_functions(spark, d):
    p = a.photos(spark, d)
    url = F.concat(F.lit("a%20b+c//"), F.col("event_id").cast("string"), F.lit("%2Fd"))
    return p.select("event_id", text.short_id("mem_", F.col("path")).alias("short_id"), text.percent(F.col("k") / 97).alias("percent"), paths.url_path(url).alias("url_path"), text.data_url(F.col("event_type").cast("binary")).alias("data_url"), F.array_join(text.split_list(F.concat(F.lit(" a , ,"), "event_type")), "|").alias("parts"), text.has_cjk(F.concat(F.lit("x海"), "event_type")).alias("cjk"))


def box_rules(spark, d):
    p = a.photos(spark, d)
    box = F.array(*[(F.col("k") * m + F.col("event_id") % 50 - 20).cast("double") for m in (1, 2, 3, 4)])
    w, h = F.lit(320), F.lit(240)
    out = p.select("event_id", boxes.resized(F.col("k") * 40 + 1, F.col("event_id") % 3000 + 1, 1024).alias("r"), boxes.padded(box, F.lit(0.5), w, h).alias("pad"), boxes.face_crop(box, w, h).alias("crop"))
    return out.select("event_id", F.array_join("pad", ",").alias("pad"), F.array_join("crop", ",").alias("crop"), F.col("r.width").cast("long").alias("width"))


_BOX = "[CAST(k * m + event_id % 50 - 20 AS DOUBLE) FOR m IN [1, 2, 3, 4]]"
_T = "CAST(trunc({}) AS BIGINT)"

QUERIES = {f.__name__: f for f in (
    vector_topk, inverted_topk, inverted_nearest, substring_index, hybrid_search, hybrid_filtered_date_camera, search_index_and_filters, search_faces_all, search_soft_label, build_index_join, index_stats, get_photo, list_faces_topn,
    unnamed_faces, filename_time_parse, path_date_strata, time_fallback_chain, gps_decimal, reverse_geocode_distinct, place_translate, skip_path_filter, prefilter_reasons, top_directories,
    new_paths_anti, label_totals, label_latest_success, extract_response_text, stratified_sample, random_sample_exact, path_and_text_functions, box_rules,
)}

_P, _I = a.with_(a.PHOTOS), a.with_(a.PHOTOS, a.INDEX)
_HAS = "(list_contains(face_ids, '{0}') OR list_contains(list_transform(face_ids, lambda f: 'P' || substr(f, 6)), '{0}'))"

ORACLES = {
    "vector_topk": f"{a.with_(a.ITEMS)} SELECT id, round(s, 6) AS score FROM (SELECT id, list_inner_product(vector, {_Q.format(0)}) AS s FROM items) ORDER BY s DESC, id LIMIT 20",
    "inverted_topk": f"{a.with_(a.ITEMS)} SELECT id, round(s, 6) AS score FROM (SELECT id, list_inner_product(vector, {_Q.format(0)}) AS s FROM items) ORDER BY s DESC, id LIMIT 20",
    "inverted_nearest": f"""{a.with_(a.ITEMS)} SELECT id, target, round(s, 6) AS similarity FROM (
        SELECT x.id, t.id AS target, list_inner_product(x.vector, t.vector) AS s, row_number() OVER (PARTITION BY x.id ORDER BY list_inner_product(x.vector, t.vector) DESC, t.id) AS k
        FROM items x, items t WHERE x.id % 3 > 0 AND t.id % 3 = 0) WHERE k = 1""",
    "substring_index": f"SELECT term, doc_id FROM documents, (SELECT unnest({_TERMS}) AS term) WHERE contains(lower(text), term)",
    "hybrid_search": f"""{a.with_(a.PHOTOS, _LIB)} SELECT path, round(v, 6) AS vector_score, w AS keyword_score, round(0.6 * v + 0.4 * w, 6) AS score FROM (
        SELECT path, list_inner_product(vector, {_Q.format(1)}) AS v, CASE WHEN contains(lower(coalesce(label, '')), 'the ere') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM lib) ORDER BY 0.6 * v + (1 - 0.6) * w DESC, path LIMIT 15""",
    "hybrid_filtered_date_camera": f"""{a.with_(a.PHOTOS, _LIB)} SELECT path, round(s, 6) AS score FROM (SELECT path, list_inner_product(vector, {_Q.format(2)}) AS s FROM lib
        WHERE taken_at >= TIMESTAMP '2024-01-01' AND taken_at <= TIMESTAMP '2024-01-02' AND (contains(lower(event_type), 'cli') OR contains(lower('K' || k), 'cli'))) ORDER BY s DESC, path LIMIT 25""",
    "search_index_and_filters": f"""{_I} SELECT path, round(2.8 + CASE WHEN contains(lower(coalesce(label, '')), 'the') THEN 1 ELSE 0 END, 4)::DOUBLE AS score FROM idx
        WHERE contains(path, '/click/') AND {_HAS.format('P5')} AND year = 2024 AND month = 1 AND contains(lower(location), '9.0000') ORDER BY score DESC, path LIMIT 50""",
    "search_faces_all": f"""{_P} SELECT path, 2.0::DOUBLE AS score FROM photos, (SELECT min(face_ids[1]) AS f FROM photos WHERE len(face_ids) = 2)
        WHERE list_contains(face_ids, f) AND list_contains(face_ids, 'face_' || (CAST(substr(f, 6) AS BIGINT) + 1)) ORDER BY path LIMIT 100""",
    "search_soft_label": f"""{_I} SELECT path, (0.5 + CASE WHEN contains(lower(coalesce(label, '')), 'ing the') THEN 1 ELSE 0 END)::DOUBLE AS score FROM idx WHERE contains(lower(location_name), 'vie') ORDER BY score DESC, path LIMIT 40""",
    "build_index_join": f"""{a.with_(a.PHOTOS, a.DETECTIONS)} SELECT p.path, CAST(length(CASE WHEN event_id % 4 = 0 THEN 'R' || d.text ELSE d.text END) AS BIGINT) AS label_length, array_to_string(face_ids, ',') AS faces,
        strftime(taken_at, '%Y-%m-%d %H:%M:%S') AS taken_at, CASE WHEN event_id % 3 = 0 THEN 'exif' ELSE 'filename' END AS time_source, CAST(year AS BIGINT) AS year FROM photos p JOIN documents d ON d.doc_id = p.event_id WHERE event_id % 19 <> 0""",
    "index_stats": f"""{a.with_(a.PHOTOS, a.DETECTIONS, a.NAMES)} SELECT count(*) AS total, count(taken_at) AS with_time, count(location) AS with_gps, count(*) FILTER (WHERE has_face) AS with_faces,
        (SELECT count(DISTINCT face_id) FROM detections) AS face_clusters_total, (SELECT count(DISTINCT id) FROM names WHERE name <> '') AS face_clusters_named FROM photos""",
    "get_photo": f"{_I} SELECT path, array_to_string(face_ids, ',') AS faces, location, location_name, CASE WHEN length(label) > 60 THEN label[:60] || '...' ELSE label END AS label FROM idx WHERE event_id = 42",
    "list_faces_topn": f"{a.with_(a.PHOTOS, a.DETECTIONS, a.NAMES)} SELECT c.face_id, n.name, c.count, i.images FROM ({_FACES}) c JOIN ({_IMAGES}) i USING (face_id) LEFT JOIN names n ON n.id = c.face_id ORDER BY c.count DESC, c.face_id LIMIT 20",
    "unnamed_faces": f"{a.with_(a.PHOTOS, a.DETECTIONS, a.NAMES)} SELECT c.face_id, c.count, i.images FROM ({_FACES}) c JOIN ({_IMAGES}) i USING (face_id) ANTI JOIN names n ON n.id = c.face_id ORDER BY c.count DESC, c.face_id LIMIT 30",
    "filename_time_parse": f"{_P} SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(taken_at, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(taken_at, '%Y-%m-%d 12:00:00') WHEN 2 THEN strftime(taken_at, '%Y-%m-%d %H:%M:%S') END AS parsed FROM photos",
    "path_date_strata": f"""{_P} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(taken_at, '%Y-%m-%d') WHEN event_id % 3 = 1 AND event_id % 40 <= 30 THEN CAST(2000 + event_id % 40 AS VARCHAR) ELSE 'unknown' END AS stratum,
        CASE WHEN event_id % 3 = 0 THEN strftime(taken_at, '%Y-%m-%d') END AS day FROM photos""",
    "time_fallback_chain": f"{_P} SELECT CASE WHEN event_id % 3 = 0 THEN 'exif' WHEN event_id % 2 = 0 THEN 'filename' WHEN event_id % 5 <> 0 THEN 'mtime' END AS source, count(*) AS n FROM photos GROUP BY 1",
    "gps_decimal": """WITH g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 60) / 60.0::DOUBLE + (o_orderkey % 59) / 3600.0::DOUBLE END AS more, o_orderkey AS k FROM orders),
        p AS (SELECT id, (k % 95 + more) * CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END AS lat, (k % 185 + more) * CASE WHEN k % 5 = 0 THEN -1 ELSE 1 END AS lng FROM g),
        r AS (SELECT *, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0) AS sound FROM p)
        SELECT id, CASE WHEN sound THEN round(lat, 6) END AS lat, CASE WHEN sound THEN round(lng, 6) END AS lng FROM r""",
    "reverse_geocode_distinct": """WITH p AS (SELECT DISTINCT (s_suppkey % 30) * 2.5::DOUBLE - 35 AS lat, (s_suppkey % 20) * 9.5::DOUBLE - 90 AS lng FROM supplier),
        t AS (SELECT n_nationkey * 3.5::DOUBLE - 40 AS y, n_nationkey * 7.25::DOUBLE - 80 AS x, n_name AS city, 'c' || n_regionkey AS cc FROM nation),
        m AS (SELECT lat, lng, city, cc, row_number() OVER (PARTITION BY lat, lng ORDER BY power(lat - y, 2) + power((lng - x) * cos(radians(lat)), 2), city, cc) AS k FROM p, t)
        SELECT printf('%.4f,%.4f', lat, lng) AS location, CASE WHEN lat = -35 AND lng = -90 THEN 'Home' ELSE city || ', ' || cc END AS location_name FROM m WHERE k = 1""",
    "place_translate": "SELECT n_name || ', R' || n_regionkey AS name, CASE n_name WHEN 'NATION_1' THEN '一' WHEN 'NATION_2' THEN CASE WHEN n_regionkey = 2 THEN '二全' ELSE '二' END ELSE n_name || ', R' || n_regionkey END AS shown FROM nation",
    "skip_path_filter": "SELECT page_id, page_id % 6 < 3 AS skipped, page_id % 6 < 2 AS in_skipped_folder, false AS hidden FROM pages",
    "prefilter_reasons": f"""{_I} SELECT CASE WHEN event_id % 2 = 0 AND strftime(taken_at, '%Y-%m-%d') < '2024-01-10' THEN 'too_old' WHEN NOT coalesce(regexp_matches(label, '(?i)the|una'), false) THEN 'caption' ELSE 'kept' END AS reason, count(*) AS n FROM idx GROUP BY 1""",
    "top_directories": """WITH p AS (SELECT string_split('/a/b/c/' || regexp_replace(url_decode(replace(regexp_replace(url, '^[a-z]+://', ''), '+', '%2B')), '/+', '/', 'g') || '/f/g.jpg', '/') AS parts FROM pages)
        SELECT array_to_string(parts[:6], '/') || '/' AS path, count(*) AS count FROM p WHERE len(parts) > 6 GROUP BY 1""",
    "new_paths_anti": "SELECT doc_id AS path FROM documents ANTI JOIN labels USING (doc_id)",
    "label_totals": "SELECT count(*) AS count, count(*) FILTER (WHERE turn % 3 <> 1) AS succeeded, count(*) FILTER (WHERE turn % 3 = 1) AS failed FROM conversations",
    "label_latest_success": "SELECT 'p' || (conv_id % 40) AS path, md5(arg_max(text, conv_id * 1000 + turn)) AS text_md5, max(conv_id * 1000 + turn) AS seq FROM conversations WHERE turn % 3 <> 1 GROUP BY 1",
    "extract_response_text": "SELECT doc_id AS id, md5(CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || '!' ELSE '' END) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "stratified_sample": f"{_P} SELECT day, path FROM (SELECT strftime(taken_at, '%Y-%m-%d') AS day, path, row_number() OVER (PARTITION BY strftime(taken_at, '%Y-%m-%d') ORDER BY md5(path || '7'), path) AS k FROM photos) WHERE k <= 8",
    "random_sample_exact": "SELECT vec_id AS id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('s1' || vec_id), vec_id) AS k, count(*) OVER () AS n FROM embeddings) WHERE k <= greatest(1, CAST(floor(n * 0.13) AS BIGINT))",
    "path_and_text_functions": f"""{_P} SELECT event_id, 'mem_' || substr(md5(path), 1, 8) AS short_id, printf('%.1f%%', k / 97 * 100) AS percent, '/a b+c/' || event_id || '/d' AS url_path, 'data:image/jpeg;base64,' || to_base64(encode(event_type)) AS data_url, 'a|' || event_type AS parts, true AS cjk FROM photos""",
    "box_rules": f"""{_P}, b AS (SELECT event_id, k, (k + event_id % 50 - 20)::DOUBLE AS x1, (2 * k + event_id % 50 - 20)::DOUBLE AS y1, (3 * k + event_id % 50 - 20)::DOUBLE AS x2, (4 * k + event_id % 50 - 20)::DOUBLE AS y2 FROM photos),
        q AS (SELECT *, x1 / 0.5 AS ox1, y1 / 0.5 AS oy1, x2 / 0.5 AS ox2, y2 / 0.5 AS oy2 FROM b),
        r AS (SELECT event_id, k, greatest(0, {_T.format('ox1 - (ox2 - ox1) * 0.05::DOUBLE')}) AS p1, greatest(0, {_T.format('oy1 - (oy2 - oy1) * 0.05::DOUBLE')}) AS p2, least(320, {_T.format('ox2 + (ox2 - ox1) * 0.05::DOUBLE')}) AS p3, least(240, {_T.format('oy2 + (oy2 - oy1) * 0.05::DOUBLE')}) AS p4,
          greatest(0, least({_T.format('x1')}, 319)) AS c1, greatest(0, least({_T.format('y1')}, 239)) AS c2, greatest(0, least({_T.format('x2')}, 320)) AS c3, greatest(0, least({_T.format('y2')}, 240)) AS c4 FROM q),
        w AS (SELECT *, {_T.format('(c3 - c1) * 0.3::DOUBLE')} AS mx, {_T.format('(c4 - c2) * 0.3::DOUBLE')} AS my FROM r)
        SELECT event_id, CASE WHEN p3 > p1 AND p4 > p2 THEN concat_ws(',', p1, p2, p3, p4) END AS pad,
          CASE WHEN c3 > c1 AND c4 > c2 THEN concat_ws(',', greatest(0, c1 - mx), greatest(0, c2 - my), least(320, c3 + mx), least(240, c4 + my)) END AS crop,
          greatest(1, CAST(round_even((k * 40 + 1) * least(1.0::DOUBLE, 1024::DOUBLE / greatest(k * 40 + 1, event_id % 3000 + 1)), 0) AS BIGINT)) AS width FROM w""",
}
