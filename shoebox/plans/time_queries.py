"""Timeline, overview, memories and vector clusters: queries with their oracle."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from ..functions import text
from ..operators import access, cluster, faces, graph, memories, stats, timeline
from . import adapters as a

TODAY_ORDERS = datetime.date(2002, 3, 10)
TOPICS = {"first": ("x", ["the", "and", "ing"], ["idiot"]), "second": ("y", ["ereth", "er", "on"], [])}


_SHOWN = ("path", "taken_at", "has_face")


def _members(spark, d, *more, gap="10 minutes"):
    return timeline.members(a.photos(spark, d).select(*_SHOWN, *more), gap)


def _heads(spark, d):
    return timeline.heads(_members(spark, d))


def timeline_events(spark, d):
    photos = graph.materialize(_members(spark, d).select("id", "pos", "path"))
    found = timeline.spans(a.photos(spark, d).select(*_SHOWN), "10 minutes").join(timeline.digests(photos), "id", "left")
    return found.select("id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), F.col("duration_days").cast("long").alias("duration_days"), "photo_count", "photos_md5")


def timeline_cover(spark, d):
    return _heads(spark, d).select("id", "cover")


def timeline_user(spark, d):
    out = timeline.spans(a.photos(spark, d), "6 hours", owner="user_id")
    return out.select("user_id", "id", F.col("photo_count").cast("long").alias("photo_count"), F.col("duration_days").cast("long").alias("duration_days"))


def timeline_windows(spark, d):
    rows = timeline.session_windows(a.photos(spark, d), "6 hours", "user_id")
    return rows.select("user_id", "n", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


def timeline_top3(spark, d):
    photos = graph.materialize(_members(spark, d, "face_ids", "location_name").select("id", "pos", "face_ids", "location_name"))
    faces = timeline.top_names(photos.select("id", "pos", F.explode("face_ids").alias("face")), ["id"], "face").withColumnRenamed("top", "faces")
    places = timeline.top_names(photos, ["id"], "location_name").withColumnRenamed("top", "places")
    return faces.join(places, "id", "full").select("id", F.array_join("faces", ",").alias("faces"), F.array_join("places", ",").alias("places"))


def _perms(spark, who="bob"):
    return access.permissions(a.users(spark), a.groups(spark)).where(F.col("name") == who)


def viewer_timeline(spark, d):
    p = a.photos(spark, d)
    photos = graph.materialize(_members(spark, d))
    out = timeline.viewer_events(timeline.heads(photos), photos, p.select("path", "face_ids", "location_name"), p.select("path", "pet_ids"), _perms(spark), a.words(spark, d))
    return out.select("id", F.col("photo_count").cast("long").alias("photo_count"), F.array_join("top_faces", ",").alias("top_faces"), F.array_join("top_places", ",").alias("top_places"), "cover")


def _detail_of(spark, d, who, photos, one):
    p = a.photos(spark, d)
    # every eleventh photo has left the index since the timeline was built
    index = p.where("event_id % 11 <> 0").select("path", "face_ids", "taken_at", "location_name")
    return timeline.event_detail(photos, one, index, p.select("path", "pet_ids"), _perms(spark, who), a.words(spark, d)).select(F.lit(who).alias("viewer"), F.col("pos").cast("long").alias("pos"), "path", "location_name")


def event_detail(spark, d):
    """The largest event as an admin, a viewer of people and a viewer of pets see it."""
    one = timeline.spans(a.photos(spark, d), "10 minutes").agg(F.max_by("id", F.struct("photo_count", "id"))).first()[0]
    photos = graph.materialize(_members(spark, d).where(F.col("id") == one).select("id", "pos", "path"))
    ann, bob, cid = (_detail_of(spark, d, who, photos, one) for who in ("ann", "bob", "cid"))
    return ann.union(bob).union(cid)


def overview_photos(spark, d):
    p = a.photos(spark, d)
    out = timeline.overview(p.select("path", "taken_at", "year", "month", "location_name", "face_ids"), p.select("path", "pet_ids"), _perms(spark))
    return out.select("path", F.col("year").cast("long").alias("year"), "location_name")


def event_years(spark, d):
    return stats.event_years(timeline.spans(a.photos(spark, d), "10 minutes")).select(F.col("year").cast("long").alias("year"), "events")


def _orders(spark, d):
    """Orders as a library over years; customers are faces, priorities places."""
    o = a.table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("/o/"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("taken_at"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("location_name"), F.array(F.concat(F.lit("face_"), F.col("o_custkey") % 10)).alias("face_ids"), F.array(F.concat(F.lit("pet_"), F.col("o_orderkey") % 4)).alias("pet_ids"),
        (F.col("o_orderkey") % 3 > 0).alias("has_face"),
    )


def overview_months(spark, d):
    out = stats.months(_orders(spark, d))
    return out.select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "photos", F.col("n_places").cast("long").alias("n_places"), "places")


def mem_on_this_day(spark, d):
    return memories.on_this_day(_orders(spark, d), TODAY_ORDERS).select(F.col("year").cast("long").alias("year"), "n")


def mem_trip(spark, d):
    found = timeline.events(a.photos(spark, d), "1 hour")
    photos = timeline.event_photos(found).join(a.photos(spark, d).select("path", "location_name"), "path")
    places = timeline.top_names(photos, ["id"], "location_name").withColumnRenamed("top", "top_places")
    visible = a.photos(spark, d).crossJoin(F.broadcast(_perms(spark))).where(access.can_see(F.col("path"), F.col("face_ids"), F.col("pet_ids")))  # one viewer
    return memories.trips(found.join(places, "id"), visible)


def mem_topic(spark, d):
    return memories.topics(a.index(spark, d).select("path", "year", "month", "label"), TOPICS).select("topic", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "n", "hits")


def mem_place(spark, d):
    return memories.places(_orders(spark, d))


def _names(spark):
    return spark.createDataFrame([(f"face_{i}",) for i in range(5)], "id string")


def mem_person(spark, d):
    return memories.people(_orders(spark, d), _names(spark), ["face_1", "face_3"]).select("face", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "n")


def mem_season(spark, d):
    return memories.seasons(_orders(spark, d), datetime.date(2001, 1, 1)).select("season", F.col("season_year").cast("long").alias("season_year"), "n")


def mem_weekend(spark, d):
    return memories.weekends(_orders(spark, d)).select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "n")


def mem_pet(spark, d):
    names = spark.createDataFrame([("pet_1",), ("pet_2",)], "id string")
    return memories.pets(_orders(spark, d), names).select("pet", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "n")


def memories_pick(spark, d):
    photos = _orders(spark, d)
    month = F.concat("year", F.lit("_"), F.lpad("month", 2, "0"))
    cards = memories.cards("on_this_day", memories.on_this_day(photos, TODAY_ORDERS), F.col("year").cast("string"), F.col("year").cast("string"))
    cards = cards.unionByName(memories.cards("place", memories.places(photos), F.col("location_name"), F.col("location_name")))
    cards = cards.unionByName(memories.cards("weekend", memories.weekends(photos), month, month))
    cards = cards.unionByName(memories.cards("person", memories.people(photos, _names(spark)), F.concat("face", F.lit("_"), month), F.col("face")))
    return memories.pick(cards, "seed7").select(F.col("place").cast("long").alias("place"), "kind", "card_id", "title", "n")


_SAID = ["海邊的沙灘與海浪", "美食與蛋糕", "登山途中的山谷", "上海的海邊沙灘", "plain"]


def memories_view(spark, d):
    """All eight kinds over the orders, for a viewer who prefers two faces; a trip is a session of one person's photos."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("k") % len(_SAID)).cast("int") + 1)
    photos = _orders(spark, d).withColumn("k", F.substring("path", 4, 20).cast("long")).withColumn("label", said)
    owned = photos.withColumn("face", F.get("face_ids", 0))
    tour = timeline.events(owned, "2 days", owner="face").withColumn("id", F.concat_ws("_", "id", "face"))
    spots = timeline.top_names(timeline.event_photos(tour).join(photos.select("path", "location_name"), "path"), ["id"], "location_name").withColumnRenamed("top", "top_places")
    named = lambda kind, n: spark.createDataFrame([(f"{kind}_{i}", f"N{i}") for i in range(n)], "id string, name string")
    out = memories.view(photos, tour.join(spots, "id"), named("face", 5), named("pet", 3), TODAY_ORDERS, "seed9", "face_2", ["face_2", "face_4"], words=a.words(spark, d))
    return out.select(F.col("place").cast("long").alias("place"), "kind", "card_id", "title", "subtitle", "cover", F.md5(F.array_join("photos", ",")).alias("photos_md5"), F.col("photo_count").cast("long").alias("photo_count"))


def card_photos(spark, d):
    photos = _orders(spark, d).where("location_name = '1-URGENT'")
    return memories.card_photos(photos, "s3").select(F.col("pos").cast("long").alias("pos"), "path", "is_cover")


def cluster_centroids(spark, d):
    return cluster.centroids(a.items(spark, d)).select("cluster", F.posexplode("vector").alias("pos", "x")).select(F.col("cluster").cast("long").alias("cluster"), F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def cluster_representatives(spark, d):
    rows = a.items(spark, d).withColumn("cluster", F.when(F.col("id") % 50 == 0, -1).otherwise(F.col("cluster")))
    return cluster.representatives(rows, 3).select(F.col("cluster").cast("long").alias("cluster"), "id", F.round("score", 6).alias("score"), "cluster_size")


def kmeans_sizes(spark, d):
    return cluster.kmeans(a.items(spark, d), 8).groupBy("cluster").agg(F.count("*").alias("n"))


def dbscan_neighbours(spark, d):
    return cluster.neighbours(a.items(spark, d), 0.62).select("a", "b", F.round("distance", 6).alias("distance"))


def dbscan_core(spark, d):
    return cluster.core(a.items(spark, d), 0.62, 3)


def dbscan_labels(spark, d):
    return cluster.dbscan(a.items(spark, d), 0.62, 3).select("id", F.col("cluster").cast("long").alias("cluster"))


def _faces(spark, d):
    return a.items(spark, d).select("id", F.concat(F.lit("/f/"), "id").alias("path"), (F.col("id") % 10).alias("stratum"), "vector")


def face_phases(spark, d):
    out = faces.three_phases(_faces(spark, d), "s5", per_stratum=60, eps=0.62, least=3, above=0.3)
    return out.select("id", "face_id", F.round("similarity", 6).alias("similarity"))


def cluster_summary(spark, d):
    return cluster.summary(cluster.dbscan(a.items(spark, d), 0.62, 3))


def nearest_centroid_assign(spark, d):
    items = a.items(spark, d)
    return cluster.assign(items, cluster.centroids(items, normalised=True), 0.35).select("id", F.col("cluster").cast("long").alias("cluster"), F.round("similarity", 6).alias("similarity"))


def _seeds(spark, d):
    return a.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), "quality").alias("label"))


def label_propagation(spark, d):
    out = cluster.propagate(a.items(spark, d), _seeds(spark, d), 0.3)
    return out.select("id", "seed", "label", F.round("similarity", 6).alias("similarity"), "is_seed", "clustered")


def propagation_totals(spark, d):
    out = cluster.propagate(a.items(spark, d), _seeds(spark, d), 0.3)
    return out.agg(F.count("*").alias("total"), F.count_if("is_seed").alias("seeds"), F.count_if("clustered").alias("clustered"), F.count_if(~F.col("clustered")).alias("unclustered"))


QUERIES = {f.__name__: f for f in (
    timeline_events, timeline_cover, timeline_user, timeline_windows, timeline_top3, viewer_timeline, event_detail, overview_photos, event_years, overview_months, mem_on_this_day, mem_trip, mem_topic, mem_place,
    mem_person, mem_season, mem_weekend, mem_pet, memories_pick, memories_view, card_photos, cluster_summary, face_phases, cluster_centroids, cluster_representatives, kmeans_sizes, dbscan_neighbours, dbscan_core, dbscan_labels,
    nearest_centroid_assign, label_propagation, propagation_totals,
)}


def _sess(gap: str, owner: str = "") -> str:
    part = f"PARTITION BY {owner}" if owner else ""
    return f"""s1 AS (SELECT *, CASE WHEN taken_at <= lag(taken_at) OVER ({part} ORDER BY taken_at, path) + INTERVAL {gap} THEN 0 ELSE 1 END AS brk FROM photos),
      s2 AS (SELECT *, sum(brk) OVER ({part} ORDER BY taken_at, path ROWS UNBOUNDED PRECEDING) AS sid FROM s1),
      s3 AS (SELECT *, row_number() OVER (PARTITION BY {owner + ',' if owner else ''} sid ORDER BY taken_at, path) - 1 AS pos, count(*) OVER (PARTITION BY {owner + ',' if owner else ''} sid) AS cnt,
        min(taken_at) OVER (PARTITION BY {owner + ',' if owner else ''} sid) AS st, max(taken_at) OVER (PARTITION BY {owner + ',' if owner else ''} sid) AS en FROM s2),
      ev AS (SELECT *, 'evt_' || strftime(st, '%Y%m%d_%H%M%S') AS id, greatest(1, datediff('day', st, en) + 1) AS days FROM s3 WHERE cnt >= 3)"""


_EV = a.with_(a.PHOTOS, _sess("'10 minutes'"))
_COVER = "SELECT id, arg_min(path, (CASE WHEN has_face THEN 0 ELSE 1 END) * 1000000000000 + CASE WHEN has_face THEN abs(pos - cnt // 2) * 1000000 + pos ELSE abs(pos - cnt // 2) END) AS cover FROM ev GROUP BY id"


def _top(value: str, source: str, out: str, shown: str = "v", join: str = "") -> str:
    return f"""SELECT id, string_agg({shown}, ',' ORDER BY k) AS {out} FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos), v) AS k
      FROM (SELECT id, pos, {value} AS v FROM {source}) WHERE v IS NOT NULL GROUP BY id, v) {join} WHERE k <= 3 GROUP BY id"""


_ORD = """WITH o AS (SELECT '/o/' || o_orderkey AS path, o_orderdate AS taken_at, year(o_orderdate) AS year, month(o_orderdate) AS month, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS location_name,
  'face_' || (o_custkey % 10) AS face, 'pet_' || (o_orderkey % 4) AS pet FROM orders)"""
_OTD = "SELECT year, count(*) AS n FROM o WHERE month = 3 AND day(taken_at) = 10 AND year <> 2002 GROUP BY 1 HAVING count(*) >= 3"
_PLACE = "SELECT location_name, count(*) AS n FROM o WHERE location_name <> '' GROUP BY 1 HAVING count(*) >= 10"
_WEEKEND = "SELECT year, month, count(*) AS n FROM o WHERE isodow(taken_at) >= 6 GROUP BY 1, 2 HAVING count(*) >= 12"
_PERSON = "SELECT face, year, month, count(*) AS n FROM o WHERE face IN ({}) GROUP BY 1, 2, 3 HAVING count(*) >= 8"
_FIVE = ", ".join(f"'face_{i}'" for i in range(5))
_CEN = """m AS (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM items {}) GROUP BY 1, 2),
  c AS (SELECT cluster, list(x ORDER BY pos) AS raw FROM m GROUP BY 1), cen AS (SELECT cluster, list_transform(raw, lambda x: x / (sqrt(list_inner_product(raw, raw)) + 1e-12)) AS centre FROM c)"""
_NB = "nb AS (SELECT p.id AS a, q.id AS b, 1 - list_inner_product(p.vector, q.vector) AS distance FROM items p JOIN items q ON p.id <> q.id AND 1 - list_inner_product(p.vector, q.vector) <= 0.62)"
_CORE = "core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) + 1 >= 3)"
_SEED = "seeds AS (SELECT doc_id AS id, 'q' || quality AS label FROM labels WHERE doc_id IN (SELECT id FROM items))"
_PROP = f"""{a.with_(a.ITEMS, _SEED)}, best AS (SELECT i.id, s.id AS seed, s.label, list_inner_product(i.vector, v.vector) AS sim, row_number() OVER (PARTITION BY i.id ORDER BY list_inner_product(i.vector, v.vector) DESC, s.id) AS k
  FROM items i, seeds s JOIN items v ON v.id = s.id WHERE i.id NOT IN (SELECT id FROM seeds)),
  prop AS (SELECT id, CASE WHEN sim >= 0.3 THEN seed END AS seed, CASE WHEN sim >= 0.3 THEN label END AS label, round(sim, 6) AS similarity, false AS is_seed, sim >= 0.3 AS clustered FROM best WHERE k = 1
    UNION ALL SELECT id, id, label, 1.0, true, true FROM seeds)"""

_DBSCAN = f"""{a.with_(a.ITEMS, _NB, _CORE, recursive=True)}, reach AS (SELECT id AS node, id AS other FROM core UNION SELECT r.node, nb.b FROM reach r JOIN nb ON nb.a = r.other JOIN core c ON c.id = nb.b),
        roots AS (SELECT node AS id, min(other) AS root FROM reach GROUP BY 1), every AS (SELECT * FROM roots UNION ALL SELECT nb.a, min(r.root) FROM nb JOIN roots r ON r.id = nb.b WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY 1),
        ranks AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM roots))"""
_SAMPLED = """items AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS vector
  FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY md5('/f/' || vec_id || 's5'), '/f/' || vec_id) AS pick FROM embeddings) WHERE pick <= 60)"""
_CARD = "SELECT '{0}' AS kind, 'mem_' || CASE '{0}' WHEN 'on_this_day' THEN 'otd' ELSE '{0}' END || '_' || {1} AS card_id, {2} AS title, {3} AS subtitle, {4} AS grp, path, taken_at, {5} AS rank, {6} AS event_cover, count(*) OVER (PARTITION BY {7}) AS n, {8} AS least FROM {9}"
_WHEN, _STAMP = "year || ' 年 ' || month || ' 月 · '", "year || '_' || printf('%02d', month)"


def _card(kind: str, key: str, title: str, keys: str, source: str, subtitle: str = "''", grp: str = "NULL", rank: str = "0", cover: str = "NULL::VARCHAR") -> str:
    return _CARD.format(kind, key, title, subtitle, grp, rank, cover, keys, memories.LEAST[kind], source)


_TOPIC_HITS = " UNION ALL ".join(
    f"SELECT path, taken_at, year, month, '{name}' AS topic, {f"CASE WHEN regexp_matches(label, '{'|'.join(map(re.escape, exc))}') THEN 0 ELSE " if exc else ''}len(list_distinct(regexp_extract_all(label, '{'|'.join(map(re.escape, inc))}'))){' END' if exc else ''} AS hits FROM lib"
    for name, (_, inc, exc) in text.TOPICS.items()
)
_VIEW8 = f"""WITH {a.WORDS}, lib AS (SELECT '/o/' || o_orderkey AS path, o_orderdate AS taken_at, year(o_orderdate) AS year, month(o_orderdate) AS month, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS location_name,
    'face_' || (o_custkey % 10) AS face, 'pet_' || (o_orderkey % 4) AS pet, (o_orderkey % 3 > 0) AS has_face, {_SAID}[o_orderkey % {len(_SAID)} + 1] AS label FROM orders),
  photos AS (SELECT * FROM lib), {_sess("'2 days'", 'face').replace("%H%M%S')", "%H%M%S_') || face")}, orig AS ({_COVER}), spot AS ({_top('location_name', 'ev', 'spots')}),
  trip AS (SELECT e.id, year(e.st) AS year, month(e.st) AS month, e.days, e.path, e.taken_at, split_part(s.spots, ',', 1) AS spot, o.cover FROM ev e JOIN spot s USING (id) JOIN orig o USING (id) WHERE e.days >= 2),
  hits AS ({_TOPIC_HITS}), season AS (SELECT path, taken_at, CASE WHEN month BETWEEN 3 AND 5 THEN '春' WHEN month BETWEEN 6 AND 8 THEN '夏' WHEN month BETWEEN 9 AND 11 THEN '秋' ELSE '冬' END AS season, year - CASE WHEN month < 3 THEN 1 ELSE 0 END AS sy FROM lib),
  mem AS (
    {_card('on_this_day', 'year', "(2002 - year) || ' 年前的今天'", 'year', "lib WHERE month = 3 AND day(taken_at) = 10 AND year <> 2002", "year || ' 年 3 月 10 日'")}
    UNION ALL {_card('trip', 'id', f"{_WHEN} || {a.SHOWN.format('spot')}", 'id', 'trip', "days || ' 天'", cover='cover')}
    UNION ALL {_card('topic', f"topic || '_' || {_STAMP}", f"{_WHEN} || topic", 'topic, year, month', 'hits WHERE hits >= 2', grp='topic', rank='hits')}
    UNION ALL {_card('place', 'md5(location_name)[:8]', f"'在 ' || {a.SHOWN.format('location_name')}", 'location_name', "lib WHERE location_name <> ''", "'跨年度回顧'")}
    UNION ALL {_card('person', f"face || '_' || {_STAMP}", f"{_WHEN} || CASE WHEN face = 'face_2' THEN '那時候的我' ELSE '與 N' || substr(face, 6) END", 'face, year, month', "lib WHERE face IN ('face_2', 'face_4')")}
    UNION ALL {_card('season', "season || '_' || sy", "sy || ' 年的' || season || '天'", 'season, sy', 'season WHERE sy < 2002')}
    UNION ALL {_card('weekend', _STAMP, f"{_WHEN} || '週末'", 'year, month', 'lib WHERE isodow(taken_at) >= 6')}
    UNION ALL {_card('pet', f"pet || '_' || {_STAMP}", f"{_WHEN} || 'N' || substr(pet, 5)", 'pet, year, month', "lib WHERE pet IN ('pet_0', 'pet_1', 'pet_2')")}),
  cards AS (SELECT DISTINCT kind, card_id, coalesce(grp, card_id) AS grp, md5('seed9' || card_id) AS draw FROM mem WHERE n >= least),
  ones AS (SELECT *, row_number() OVER (PARTITION BY kind, grp ORDER BY draw) AS one FROM cards),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY draw) AS k FROM ones WHERE one = 1),
  chosen AS (SELECT card_id, row_number() OVER (ORDER BY draw) - 1 AS place FROM ranked WHERE k <= CASE kind WHEN 'trip' THEN 3 WHEN 'topic' THEN 3 WHEN 'on_this_day' THEN 1000000 ELSE 1 END),
  shown AS (SELECT * FROM (SELECT m.*, c.place, row_number() OVER (PARTITION BY m.card_id ORDER BY m.rank DESC, md5('seed9' || m.path), m.path) AS r FROM mem m JOIN chosen c USING (card_id)) WHERE r <= 30)"""

ORACLES = {
    "timeline_events": f"{_EV} SELECT id, strftime(st, '%Y-%m-%d %H:%M:%S') AS start, strftime(en, '%Y-%m-%d %H:%M:%S') AS \"end\", days AS duration_days, cnt AS photo_count, md5(string_agg(path, ',' ORDER BY pos)) AS photos_md5 FROM ev GROUP BY id, st, en, days, cnt",
    "timeline_cover": f"{_EV} {_COVER}",
    "timeline_user": f"{a.with_(a.PHOTOS, _sess(chr(39) + '6 hours' + chr(39), 'user_id'))} SELECT DISTINCT user_id, id, cnt AS photo_count, days AS duration_days FROM ev",
    "timeline_windows": f"{a.with_(a.PHOTOS, _sess(chr(39) + '6 hours' + chr(39), 'user_id'))} SELECT user_id, count(*) AS n, strftime(min(taken_at), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(taken_at), '%Y-%m-%d %H:%M:%S') AS \"end\" FROM s2 GROUP BY user_id, sid",
    "timeline_top3": f"{_EV} SELECT id, faces, places FROM ({_top('unnest(face_ids)', 'ev', 'faces')}) FULL JOIN ({_top('location_name', 'ev', 'places')}) USING (id)",
    "viewer_timeline": f"""{_EV}, {a.PERMS}, {a.WORDS}, seen AS (SELECT ev.*, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS vpos, count(*) OVER (PARTITION BY id) AS vcnt FROM ev, perms WHERE name = 'bob' AND {a.CAN_SEE}),
        kept AS (SELECT * FROM seen WHERE vcnt >= 3), orig AS ({_COVER}), mid AS (SELECT id, vcnt, path AS middle FROM kept WHERE vpos = vcnt // 2)
        SELECT m.id, m.vcnt AS photo_count, coalesce(f.top_faces, '') AS top_faces, coalesce(p.top_places, '') AS top_places, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.id = m.id AND k.path = o.cover) THEN o.cover ELSE m.middle END AS cover
        FROM mid m JOIN orig o ON o.id = m.id LEFT JOIN ({_top('unnest(face_ids)', 'kept', 'top_faces')}) f ON f.id = m.id LEFT JOIN ({_top('location_name', 'kept', 'top_places', 'coalesce(translation, v)', 'LEFT JOIN words ON word = v')}) p ON p.id = m.id""",
    "event_detail": f"""{_EV}, {a.PERMS}, {a.WORDS}, one AS (SELECT pos, path, pet_ids, CASE WHEN event_id % 11 <> 0 THEN face_ids ELSE CAST([] AS VARCHAR[]) END AS face_ids, CASE WHEN event_id % 11 <> 0 THEN location_name END AS place
          FROM ev WHERE id = (SELECT arg_max(id, cnt * 1e15 + CAST(replace(substr(id, 5), '_', '') AS BIGINT)) FROM ev))
        SELECT name AS viewer, pos, path, {a.SHOWN.format('place')} AS location_name FROM one, perms WHERE name IN ('ann', 'bob', 'cid') AND {a.CAN_SEE}""",
    "overview_photos": f"{a.with_(a.PHOTOS, a.PERMS)} SELECT path, year, location_name FROM photos, perms WHERE name = 'bob' AND {a.CAN_SEE}",
    "event_years": f"{_EV} SELECT year(st) AS year, count(DISTINCT id) AS events FROM ev GROUP BY 1",
    "overview_months": f"{_ORD} SELECT year, month, count(*) AS photos, count(DISTINCT location_name) AS n_places, array_to_string(list_sort(list(DISTINCT location_name) FILTER (WHERE location_name IS NOT NULL))[:3], ', ') AS places FROM o GROUP BY 1, 2",
    "mem_on_this_day": f"{_ORD} {_OTD}",
    "mem_trip": f"""{a.with_(a.PHOTOS, _sess("'1 hour'"), a.PERMS)} SELECT id, count(*) AS n FROM ev, perms WHERE name = 'bob' AND days >= 2 AND id IN (SELECT id FROM ev WHERE location_name IS NOT NULL) AND {a.CAN_SEE} GROUP BY 1 HAVING count(*) >= 5""",
    "mem_topic": f"""{a.with_(a.PHOTOS, a.INDEX)}, h AS (
        SELECT 'first' AS topic, year, month, CASE WHEN contains(label, 'idiot') THEN 0 ELSE len(list_distinct(regexp_extract_all(label, 'the|and|ing'))) END AS hits FROM idx
        UNION ALL SELECT 'second', year, month, len(list_distinct(regexp_extract_all(label, 'ereth|er|on'))) FROM idx)
        SELECT topic, year, month, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits FROM h WHERE hits >= 2 GROUP BY 1, 2, 3 HAVING count(*) >= 6""",
    "mem_place": f"{_ORD} {_PLACE}",
    "mem_person": f"{_ORD} {_PERSON.format(chr(39) + 'face_1' + chr(39) + ', ' + chr(39) + 'face_3' + chr(39))}",
    "mem_season": f"""{_ORD} SELECT season, season_year, count(*) AS n FROM (SELECT CASE WHEN month BETWEEN 3 AND 5 THEN '春' WHEN month BETWEEN 6 AND 8 THEN '夏' WHEN month BETWEEN 9 AND 11 THEN '秋' ELSE '冬' END AS season, year - CASE WHEN month < 3 THEN 1 ELSE 0 END AS season_year FROM o)
        WHERE season_year < 2001 GROUP BY 1, 2 HAVING count(*) >= 30""",
    "mem_weekend": f"{_ORD} {_WEEKEND}",
    "mem_pet": f"{_ORD} SELECT pet, year, month, count(*) AS n FROM o WHERE pet IN ('pet_1', 'pet_2') GROUP BY 1, 2, 3 HAVING count(*) >= 6",
    "memories_pick": f"""{_ORD}, cards AS (SELECT 'on_this_day' AS kind, 'mem_otd_' || year AS card_id, CAST(year AS VARCHAR) AS title, n, 1000000 AS quota FROM ({_OTD})
        UNION ALL SELECT 'place', 'mem_place_' || md5(location_name)[:8], location_name, n, 1 FROM ({_PLACE})
        UNION ALL SELECT 'weekend', 'mem_weekend_' || year || '_' || printf('%02d', month), year || '_' || printf('%02d', month), n, 1 FROM ({_WEEKEND})
        UNION ALL SELECT 'person', 'mem_person_' || face || '_' || year || '_' || printf('%02d', month), face, n, 1 FROM ({_PERSON.format(_FIVE)})),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('seed7' || card_id)) AS k FROM cards)
        SELECT row_number() OVER (ORDER BY md5('seed7' || card_id)) - 1 AS place, kind, card_id, title, n FROM ranked WHERE k <= quota""",
    "memories_view": f"""{_VIEW8}
        SELECT place, kind, card_id, any_value(title) AS title, any_value(subtitle) AS subtitle,
          coalesce(any_value(event_cover) FILTER (WHERE path = event_cover), any_value(path) FILTER (WHERE pos = shown_n // 2)) AS cover, md5(string_agg(path, ',' ORDER BY pos)) AS photos_md5, count(*) AS photo_count
        FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY taken_at, path) - 1 AS pos, count(*) OVER (PARTITION BY card_id) AS shown_n FROM shown) GROUP BY place, kind, card_id""",
    "face_phases": f"""{_DBSCAN.replace(a.ITEMS, _SAMPLED)}, everyone AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
        clustered AS (SELECT i.vector, k.cluster FROM items i JOIN every e ON e.id = i.id JOIN ranks k ON k.root = e.root),
        {_CEN.format('').replace('FROM items', 'FROM clustered')},
        n AS (SELECT e.id, cen.cluster, list_inner_product(list_transform(e.vector, lambda x: x / sqrt(list_inner_product(e.vector, e.vector))), centre) AS s FROM everyone e LEFT JOIN cen ON true),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cluster) AS r FROM n)
        SELECT id, CASE WHEN s > 0.3 THEN 'face_' || cluster ELSE 'unknown' END AS face_id, round(s, 6) AS similarity FROM k WHERE r = 1""",
    "cluster_summary": f"{_DBSCAN}, l AS (SELECT i.id, coalesce(k.cluster, -1) AS cluster FROM items i LEFT JOIN every e ON e.id = i.id LEFT JOIN ranks k ON k.root = e.root) SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters, count(*) FILTER (WHERE cluster = -1) AS n_noise FROM l",
    "card_photos": f"""{_ORD}, few AS (SELECT path, taken_at FROM o WHERE location_name = '1-URGENT' ORDER BY md5('s3' || path) LIMIT 30)
        SELECT pos, path, pos = n // 2 AS is_cover FROM (SELECT path, row_number() OVER (ORDER BY taken_at, path) - 1 AS pos, count(*) OVER () AS n FROM few)""",
    "cluster_centroids": f"{a.with_(a.ITEMS, _CEN.format(''))} SELECT CAST(cluster AS BIGINT) AS cluster, p - 1 AS pos, round(centre[p], 6) AS x FROM (SELECT cluster, centre, unnest(range(1, len(centre) + 1)) AS p FROM cen)",
    "cluster_representatives": f"""WITH items AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, CASE WHEN vec_id % 50 = 0 THEN -1 ELSE label END AS cluster FROM embeddings), {_CEN.format('WHERE cluster <> -1')},
        r AS (SELECT i.cluster, id, list_inner_product(vector, centre) AS s, count(*) OVER (PARTITION BY i.cluster) AS n, row_number() OVER (PARTITION BY i.cluster ORDER BY list_inner_product(vector, centre) DESC, id) AS k FROM items i JOIN cen USING (cluster) WHERE i.cluster <> -1)
        SELECT CAST(cluster AS BIGINT) AS cluster, id, round(s, 6) AS score, n AS cluster_size FROM r WHERE k <= 3 UNION ALL SELECT -1, id, 1.0, NULL FROM items WHERE cluster = -1""",
    "dbscan_neighbours": f"{a.with_(a.ITEMS, _NB)} SELECT a, b, round(distance, 6) AS distance FROM nb",
    "dbscan_core": f"{a.with_(a.ITEMS, _NB, _CORE)} SELECT id FROM core",
    "dbscan_labels": f"{_DBSCAN} SELECT i.id, coalesce(k.cluster, -1) AS cluster FROM items i LEFT JOIN every e ON e.id = i.id LEFT JOIN ranks k ON k.root = e.root",
    "nearest_centroid_assign": f"""{a.with_(a.ITEMS, _CEN.format(''))}, n AS (SELECT id, cen.cluster, list_inner_product(list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))), centre) AS s FROM items, cen),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cluster) AS r FROM n) SELECT id, CAST(CASE WHEN s > 0.35 THEN cluster ELSE -1 END AS BIGINT) AS cluster, round(s, 6) AS similarity FROM k WHERE r = 1""",
    "label_propagation": f"{_PROP} SELECT * FROM prop",
    "propagation_totals": f"{_PROP} SELECT count(*) AS total, count(*) FILTER (WHERE is_seed) AS seeds, count(*) FILTER (WHERE clustered) AS clustered, count(*) FILTER (WHERE NOT clustered) AS unclustered FROM prop",
}
