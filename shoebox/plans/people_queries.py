"""Clusters, overlays, permissions and names: queries with their oracle."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from ..operators import access, graph, labels, overlay, stats
from ..sources import commits
from . import adapters as a


def face_cluster_info(spark, d):
    return stats.cluster_infos(a.detections(spark, d)).select("face_id", "detections", "images", F.md5(F.array_join("paths", ",")).alias("paths_md5"))


def faces_per_image(spark, d):
    return stats.faces_of_images(a.detections(spark, d)).select("path", F.array_join(F.transform("faces", lambda f: f["face_id"]), ",").alias("faces"))


def best_detection(spark, d):
    return stats.best_detection(a.detections(spark, d)).select("face_id", "path", "det_score")


def best_of_first_images(spark, d):
    return stats.best_of_first_images(a.detections(spark, d)).select("face_id", "path", "det_score")


def merge_closure(spark, d):
    return overlay.merge_closure(a.merges(spark, d))


def overlay_apply(spark, d):
    out = overlay.apply_overlays(a.detections(spark, d), overlay.merge_closure(a.merges(spark, d)), a.moves(spark, d), a.removed(spark, d), a.names(spark, d))
    return out.select("path", "seq", "face_id", "name")


def _images(spark, d):
    return overlay.cluster_images(a.members(spark, d), a.merges(spark, d), a.moves(spark, d), a.removed(spark, d))


def _view(spark, d):
    return overlay.cluster_view(_images(spark, d), a.names(spark, d), a.skipped(spark, d))


def cluster_view(spark, d):
    return _view(spark, d).where("not user_created").select("id", "name", "count", "original_count", F.md5(F.array_join("images", ",")).alias("images_md5"), "skipped")


def cluster_view_synthetic(spark, d):
    return _view(spark, d).where("user_created").select("id", "name", "count", "original_count", F.md5(F.array_join("images", ",")).alias("images_md5"), "skipped")


def cluster_sort(spark, d):
    return overlay.with_rank(overlay.tab(_view(spark, d), "unnamed"), "face_5").select("rank", "id", "count")


def cluster_page(spark, d):
    return overlay.page(_view(spark, d), 1, "face_1").select("id", "name", "count", "skipped")


def cluster_stats(spark, d):
    return overlay.cluster_stats(a.members(spark, d), a.names(spark, d), a.skipped(spark, d), a.merges(spark, d))


def named_clusters(spark, d):
    return overlay.named_clusters(a.members(spark, d), a.names(spark, d), a.merges(spark, d))


def viewer_perms(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return access.permissions(*a.accounts(spark, d)).select("name", "is_admin", "identity", joined("allowed_faces"), joined("allowed_pets"), joined("blocked_paths"))


def visible_photos(spark, d):
    perms = access.permissions(a.users(spark), a.groups(spark))
    seen = a.photos(spark, d).crossJoin(F.broadcast(perms))  # four users
    return seen.where(access.can_see(F.col("path"), F.col("face_ids"), F.col("pet_ids"))).select("name", "event_id")


def visible_face_view(spark, d):
    perms = access.permissions(a.users(spark), a.groups(spark))
    rows = a.photos(spark, d).withColumn("cluster", F.explode("face_ids")).crossJoin(F.broadcast(perms))  # four users
    return rows.where(access.can_see_in_face_cluster(F.col("cluster"), F.col("path"), F.col("face_ids"))).select("name", "cluster", "event_id")


def visible_pet_view(spark, d):
    perms = access.permissions(a.users(spark), a.groups(spark))
    rows = a.photos(spark, d).withColumn("cluster", F.explode("pet_ids")).crossJoin(F.broadcast(perms))  # four users
    return rows.where(access.can_see_in_pet_cluster(F.col("cluster"), F.col("path"))).select("name", "cluster", "event_id")


_EDGES = [(1, "face_1", "face_2", "父", None, None), (2, "face_3", "face_2", "兄", "小弟", ""), (3, "face_4", "face_2", "朋友", None, None), (4, "face_2", "face_3", "姐", None, "大姐"), (5, "", "face_9", "母", None, None)]


def _edges(spark):
    return spark.createDataFrame(_EDGES, "seq long, src string, dst string, type string, alias_from string, alias_to string")


def alias_derive(spark, d):
    return access.aliases(_edges(spark))


def display_names(spark, d):
    people = a.table(spark, d, "customer").select(F.concat(F.lit("face_"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    return access.display_names(people, access.aliases(_edges(spark)), "face_2")


def clean_edges(spark, d):
    return access.clean_edges(_edges(spark), ("朋友",)).select("seq", "family", "listed")


def admins_left(spark, d):
    return access.admins_left(a.accounts(spark, d)[0], "Customer#000000100")


def next_user_id(spark, d):
    used = a.moves(spark, d).select(F.col("dst").alias("id")).union(spark.createDataFrame([("face_u2",), ("face_u5",)], "id string"))
    return spark.createDataFrame([(overlay.next_user_id(used, "face"),)], "next_id string")


def overlay_log_state(spark, d):
    """The overlay state of a log whose edits come from jobs and from hand, read through a snapshot and a tail."""
    log = commits.OverlayLog(spark, graph.work_folder(spark, "overlay"))
    event = lambda df, entry, id_, path, value, seq: df.select(seq.cast("long").alias("seq"), F.lit(entry).alias("entry"), id_.alias("id"), path.cast("string").alias("path"), value.cast("string").alias("value"))
    names, none, one = a.names(spark, d), F.lit(None), F.lit("1")
    number = F.substring("id", 6, 20).cast("long")
    log.commit_table(event(names, "name", F.col("id"), none, F.col("name"), number))
    log.commit_table(event(a.moves(spark, d), "move", F.col("src"), F.col("path"), F.col("dst"), F.col("seq")))
    log.snapshot()
    changed = names.where(number % 6 == 0).withColumn("name", F.when(number % 12 != 0, F.concat(F.lit("X"), "id")))
    log.commit_table(event(changed, "name", F.col("id"), none, F.col("name"), number))
    log.commit_table(event(a.removed(spark, d), "remove", F.col("id"), F.col("path"), one, F.lit(0)).union(event(a.skipped(spark, d), "skip", F.col("id"), none, one, F.lit(1))))
    log.commit(lambda events: overlay.skip_events(overlay.log_state(events, "skip"), ["face_1", "face_9"], 0))
    parts = [log.state(entry).select(F.lit(entry).alias("entry"), "id", "path", "value") for entry in ("name", "move", "remove", "skip")]
    return functools.reduce(DataFrame.union, parts)


def last_write_wins(spark, d):
    rows = a.photos(spark, d).select(F.col("user_id").alias("path"), "event_id", "k")
    return labels.last_row_wins(rows, "path", ["k", "event_id"]).select("path", "event_id", "k")


def viewer_face_clusters(spark, d):
    images = _images(spark, d)
    faces = overlay.effective_faces(a.members(spark, d), a.merges(spark, d), a.moves(spark, d))
    perms = access.permissions(a.users(spark), a.groups(spark)).where("name = 'bob'")
    return overlay.viewer_view(images, a.names(spark, d), a.skipped(spark, d), faces, perms, "face").select("id", "name", "count")


def _pet_members(spark, d):
    return a.photos(spark, d).select(F.explode("pet_ids").alias("id"), "path", F.col("event_id").alias("seq"))


def _pet_view(spark, d, perms=None):
    none = spark.createDataFrame([], "src string, dst string, path string, id string, name string, seq long")
    images = overlay.cluster_images(_pet_members(spark, d), none.select("src", "dst"), none.select("path", "src", "dst", "seq"), none.select("id", "path"))
    if perms is None:
        return overlay.cluster_view(images, none.select("id", "name"), none.select("id"))
    return overlay.viewer_view(images, none.select("id", "name"), none.select("id"), a.photos(spark, d).select("path", "face_ids"), perms, "pet")


def viewer_pet_clusters(spark, d):
    perms = access.permissions(a.users(spark), a.groups(spark))
    parts = [_pet_view(spark, d, perms.where(F.col("name") == who)).select(F.lit(who).alias("viewer"), "id", "count") for who in ("bob", "cid")]
    return parts[0].unionByName(parts[1])


def combined_clusters(spark, d):
    return overlay.combined_view(_view(spark, d), _pet_view(spark, d)).select("kind", "id", "count", "skipped")


def thumbnail_faces(spark, d):
    chosen = a.detections(spark, d).groupBy(F.col("face_id").alias("id")).agg(F.max("path").alias("path"))
    return overlay.thumbnail_faces(a.detections(spark, d), chosen, a.merges(spark, d))


def viewer_stats(spark, d):
    perms = access.permissions(a.users(spark), a.groups(spark)).where("name = 'bob'")
    return overlay.sum_stats([overlay.viewer_stats(a.names(spark, d), perms), overlay.viewer_stats(a.names(spark, d), perms)])


def cluster_metadata(spark, d):
    files = a.photos(spark, d).select("path", F.col("taken_at").alias("modified"))
    out = overlay.cluster_metadata(_images(spark, d), files, "face_1")
    return out.select("path", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))


def cluster_metadata_admin(spark, d):
    files = a.photos(spark, d).where("event_id % 4 <> 0").select("path", F.col("taken_at").alias("modified"))
    perms = access.permissions(a.users(spark), a.groups(spark)).where("name = 'ann'")
    out = overlay.cluster_metadata(_images(spark, d), files, "face_2", perms)
    return out.select("path", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "removed")


def detection_totals(spark, d):
    noisy = a.detections(spark, d).withColumn("face_id", F.when(F.col("seq") % 7 != 0, F.col("face_id")))
    return stats.detection_totals(noisy)


def _family(spark, d):
    """A graph over customers: edges of all family types and one other, with blanks to be cleaned."""
    c = a.table(spark, d, "customer")
    face = lambda n: F.concat(F.lit(" face_"), n.cast("string"))
    kinds = [*access.FAMILY, "朋友"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % len(kinds)).cast("int") + 1)
    edges = c.select(
        F.col("c_custkey").alias("seq"), face(F.col("c_custkey")).alias("src"), face(F.col("c_custkey") * 7 % 40).alias("dst"), F.concat(kind, F.lit(" ")).alias("type"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(" Nick ")).alias("alias_from"), F.lit("").alias("alias_to"),
    )
    nodes = c.select(face(F.col("c_custkey") % 60).alias("id")).union(spark.createDataFrame([(" ",)], "id string"))
    return nodes, edges, c.select(F.trim(face(F.col("c_custkey"))).alias("id"), F.col("c_acctbal").alias("x"), F.when(F.col("c_custkey") % 3 > 0, 1.0).alias("y"))


def family_aliases(spark, d):
    return access.aliases(access.clean_edges(_family(spark, d)[1], ("朋友",)))


def saved_graph(spark, d):
    nodes, edges, positions = access.clean_graph(*_family(spark, d), ("朋友",))
    return access.graph_totals(nodes, edges).crossJoin(positions.agg(F.count("*").alias("positions")))  # one row each


def thumbnail_rights(spark, d):
    perms = access.permissions(a.users(spark), a.groups(spark))
    clusters = spark.createDataFrame([("face_1",), ("face_2",), ("",)], "cluster string")
    return perms.crossJoin(clusters).select("name", "cluster", access.may_set_thumbnail(F.col("cluster")).alias("may"), access.can_see_cluster(F.col("cluster")).alias("sees"))


def dropped_group(spark, d):
    users, groups = access.drop_group(*a.accounts(spark, d), "r2")
    return access.permissions(users, groups).select("name", F.array_join("allowed_faces", ",").alias("allowed_faces"))


QUERIES = {f.__name__: f for f in (
    face_cluster_info, faces_per_image, best_detection, best_of_first_images, merge_closure, overlay_apply, cluster_view, cluster_view_synthetic, cluster_sort, cluster_page, cluster_stats,
    named_clusters, viewer_perms, visible_photos, visible_face_view, visible_pet_view, alias_derive, display_names, clean_edges, admins_left, next_user_id, overlay_log_state, last_write_wins,
    viewer_face_clusters, viewer_pet_clusters, combined_clusters, thumbnail_faces, viewer_stats, cluster_metadata, cluster_metadata_admin, detection_totals, family_aliases, saved_graph, thumbnail_rights, dropped_group,
)}

_D = a.with_(a.PHOTOS, a.DETECTIONS)
_MOVED = """last_moves AS (SELECT path, arg_max(src, seq) AS src0, arg_max(dst, seq) AS dst0 FROM moves GROUP BY path),
  rmoves AS (SELECT m.path, coalesce(s.dst, m.src0) AS src, coalesce(t.dst, m.dst0) AS dst, x.seq FROM last_moves m JOIN moves x ON x.path = m.path AND x.dst = m.dst0 LEFT JOIN closure s ON s.src = m.src0 LEFT JOIN closure t ON t.src = m.dst0),
  rremoved AS (SELECT DISTINCT coalesce(c.dst, r.id) AS id, r.path FROM removed r LEFT JOIN closure c ON c.src = r.id)"""
_OVER = a.with_(a.PHOTOS, a.DETECTIONS, a.MERGES, a.CLOSURE, a.MOVES, a.REMOVED, a.NAMES, a.SKIPPED, _MOVED, recursive=True)
_VIEW = _OVER + """, native AS (SELECT DISTINCT face_id AS id FROM detections), mset AS (SELECT DISTINCT src FROM merges),
  own AS (SELECT coalesce(c.dst, d.face_id) AS id, d.path, min(d.seq) AS seq FROM detections d LEFT JOIN closure c ON c.src = d.face_id GROUP BY 1, 2),
  own2 AS (SELECT o.* FROM own o WHERE o.id IN (SELECT id FROM native) AND o.id NOT IN (SELECT src FROM mset)),
  into_ AS (SELECT dst AS id, path, 1099511627776 + seq AS seq FROM rmoves WHERE dst NOT IN (SELECT src FROM mset)),
  every AS (SELECT id, path, min(seq) AS seq FROM (SELECT * FROM own2 UNION ALL SELECT * FROM into_) GROUP BY id, path),
  flagged AS (SELECT e.*, e.id NOT IN (SELECT id FROM native) AS uc,
    EXISTS (SELECT 1 FROM rmoves m WHERE m.src = e.id AND m.path = e.path) AS away, EXISTS (SELECT 1 FROM rremoved r WHERE r.id = e.id AND r.path = e.path) AS gone FROM every e),
  act AS (SELECT *, NOT gone AND NOT (away AND NOT uc) AS active FROM flagged),
  v AS (SELECT a.id, coalesce(any_value(n.name), '') AS name, count(*) FILTER (WHERE active) AS count, count(*) AS original_count,
    md5(coalesce(string_agg(path, ',' ORDER BY seq, path) FILTER (WHERE active), '')) AS images_md5, a.id IN (SELECT id FROM skipped) AS skipped, any_value(uc) AS uc
    FROM act a LEFT JOIN names n ON n.id = a.id GROUP BY a.id) """
_SEEN = a.with_(a.PHOTOS, a.PERMS)
_RULES = ", ".join(f"('{t}', '{x}', '{y}')" for t, (x, y) in access.FAMILY.items())
_TYPES = [*access.FAMILY, "朋友"]
_FAMILY = f"""WITH e AS (SELECT * FROM (SELECT c_custkey AS seq, 'face_' || c_custkey AS src, 'face_' || (c_custkey * 7 % 40) AS dst, {_TYPES}[c_custkey % {len(_TYPES)} + 1] AS type, CASE WHEN c_custkey % 5 = 0 THEN 'Nick' END AS alias_from FROM customer) WHERE src <> dst),
  rules AS (SELECT * FROM (VALUES {_RULES}) AS t(type, forward, backward)),
  said AS (SELECT seq * 2 AS o, dst AS viewer, src AS target, forward AS alias FROM e JOIN rules USING (type) UNION ALL SELECT seq * 2 + 1, src, dst, coalesce(alias_from, backward) FROM e JOIN rules USING (type)),
  known AS (SELECT viewer, target, arg_max(alias, o) AS alias FROM said GROUP BY 1, 2) """

ORACLES = {
    "face_cluster_info": f"{_D} SELECT face_id, sum(n)::BIGINT AS detections, count(*) AS images, md5(string_agg(path, ',' ORDER BY seq, path)) AS paths_md5 FROM (SELECT face_id, path, count(*) AS n, min(seq) AS seq FROM detections GROUP BY 1, 2) GROUP BY 1",
    "faces_per_image": f"{_D} SELECT path, string_agg(face_id, ',' ORDER BY seq) AS faces FROM detections GROUP BY 1",
    "best_detection": f"{_D} SELECT face_id, path, det_score FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY det_score DESC, seq) AS k FROM detections) WHERE k = 1",
    "best_of_first_images": f"""{_D}, i AS (SELECT face_id, path, row_number() OVER (PARTITION BY face_id ORDER BY min(seq)) AS k FROM detections GROUP BY 1, 2)
        SELECT face_id, path, det_score FROM (SELECT d.*, row_number() OVER (PARTITION BY d.face_id ORDER BY det_score DESC, seq) AS r FROM detections d JOIN i ON i.face_id = d.face_id AND i.path = d.path AND i.k <= 5) WHERE r = 1""",
    "merge_closure": f"{a.with_(a.MERGES, a.CLOSURE, recursive=True)} SELECT src, dst FROM closure",
    "overlay_apply": f"""{_OVER}, m AS (SELECT d.path, d.seq, coalesce(c.dst, d.face_id) AS f FROM detections d LEFT JOIN closure c ON c.src = d.face_id),
        p AS (SELECT m.path, m.seq, coalesce(r.dst, m.f) AS face_id FROM m LEFT JOIN rmoves r ON r.path = m.path AND r.src = m.f)
        SELECT p.path, p.seq, p.face_id, coalesce(n.name, p.face_id) AS name FROM p ANTI JOIN rremoved x ON x.path = p.path AND x.id = p.face_id LEFT JOIN names n ON n.id = p.face_id""",
    "cluster_view": f"{_VIEW} SELECT id, name, count, original_count, images_md5, skipped FROM v WHERE NOT uc",
    "cluster_view_synthetic": f"{_VIEW} SELECT id, name, count, original_count, images_md5, skipped FROM v WHERE uc",
    "cluster_sort": f"{_VIEW} SELECT row_number() OVER (ORDER BY skipped, id <> 'face_5', count DESC, id) - 1 AS rank, id, count FROM v WHERE name = '' AND NOT skipped",
    "cluster_page": f"{_VIEW} SELECT id, name, count, skipped FROM (SELECT *, row_number() OVER (ORDER BY skipped, id <> 'face_1', count DESC, id) - 1 AS r, count(*) OVER () AS n FROM v) WHERE r // 24 = least(1, (n - 1) // 24)",
    "cluster_stats": f"{_OVER} SELECT t AS total, t - m AS displayed, n AS named, s AS skipped, m AS merges FROM (SELECT (SELECT count(DISTINCT face_id) FROM detections) AS t, (SELECT count(*) FROM merges) AS m, (SELECT count(*) FROM names) AS n, (SELECT count(*) FROM skipped) AS s)",
    "named_clusters": f"{_OVER} SELECT n.id, n.name, count(*) AS count FROM (SELECT DISTINCT face_id, path FROM detections) d LEFT JOIN closure c ON c.src = d.face_id JOIN names n ON n.id = coalesce(c.dst, d.face_id) WHERE n.id NOT IN (SELECT src FROM merges) GROUP BY 1, 2",
    "viewer_perms": f"WITH {a.ACCOUNTS.format('')} SELECT name, is_admin, identity, {a.HELD.format('faces')} AS allowed_faces, {a.HELD.format('pets')} AS allowed_pets, {a.HELD.format('blocked')} AS blocked_paths FROM held",
    "visible_photos": f"{_SEEN} SELECT name, event_id FROM photos, perms WHERE {a.CAN_SEE}",
    "visible_face_view": f"{_SEEN} SELECT name, cluster, event_id FROM (SELECT *, unnest(face_ids) AS cluster, CAST([] AS VARCHAR[]) AS pet_ids FROM (SELECT path, face_ids, event_id FROM photos), perms) WHERE is_admin OR (list_contains(allowed_faces, cluster) AND {a.CAN_SEE})",
    "visible_pet_view": f"{_SEEN} SELECT name, cluster, event_id FROM (SELECT *, unnest(pet_ids) AS cluster FROM photos, perms) WHERE CASE WHEN is_admin THEN true WHEN len(allowed_pets) > 0 THEN list_contains(allowed_pets, cluster) ELSE len(list_filter(blocked_paths, lambda b: starts_with(path, b))) = 0 END",
    "alias_derive": "SELECT * FROM (VALUES ('face_2', 'face_1', '爸爸'), ('face_1', 'face_2', '子女'), ('face_2', 'face_3', '弟妹'), ('face_3', 'face_2', '大姐')) AS t(viewer, target, alias)",
    "display_names": "SELECT 'face_' || c_custkey AS id, c_name AS name, CASE c_custkey WHEN 1 THEN '爸爸' WHEN 3 THEN '弟妹' WHEN 2 THEN '我' ELSE c_name END AS shown FROM customer",
    "clean_edges": "SELECT * FROM (VALUES (1::BIGINT, true, true), (2, true, true), (3, false, true), (4, true, true)) AS t(seq, family, listed)",
    "admins_left": "SELECT count(*) AS admins FROM customer WHERE c_custkey % 100 = 0 AND c_name <> 'Customer#000000100'",
    "next_user_id": "SELECT 'face_u3' AS next_id",
    "overlay_log_state": f"""{a.with_(a.PHOTOS, a.NAMES, a.MOVES, a.REMOVED, a.SKIPPED)} SELECT 'name' AS entry, id, NULL AS path, CASE WHEN substr(id, 6)::BIGINT % 6 = 0 THEN 'X' || id ELSE name END AS value FROM names WHERE substr(id, 6)::BIGINT % 12 <> 0
        UNION ALL SELECT 'move', src, path, dst FROM moves UNION ALL SELECT DISTINCT 'remove', id, path, '1' FROM removed UNION ALL SELECT DISTINCT 'skip', id, NULL, '1' FROM (SELECT id FROM skipped UNION ALL VALUES ('face_1'), ('face_9'))""",
    "last_write_wins": f"{a.with_(a.PHOTOS)} SELECT user_id AS path, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id DESC) AS r FROM photos) WHERE r = 1",
    "viewer_face_clusters": f"""{_VIEW}, {a.PERMS}, eff AS (SELECT path, list(DISTINCT id) AS face_ids, CAST([] AS VARCHAR[]) AS pet_ids FROM (
          SELECT d.path, coalesce(m.dst, coalesce(c.dst, d.face_id)) AS id FROM detections d LEFT JOIN closure c ON c.src = d.face_id LEFT JOIN rmoves m ON m.path = d.path AND m.src = coalesce(c.dst, d.face_id)) GROUP BY path)
        SELECT x.id, coalesce(any_value(n.name), '') AS name, count(*) AS count FROM (SELECT act.id, eff.*, perms.* FROM act JOIN eff ON eff.path = act.path, perms WHERE act.active AND perms.name = 'bob') x LEFT JOIN names n ON n.id = x.id
        WHERE list_contains(allowed_faces, x.id) AND {a.CAN_SEE} GROUP BY x.id""",
    "viewer_pet_clusters": f"""{_SEEN} SELECT name AS viewer, cluster AS id, count(*) AS count FROM (SELECT *, unnest(pet_ids) AS cluster FROM photos, perms WHERE name IN ('bob', 'cid'))
        WHERE CASE WHEN len(allowed_pets) > 0 THEN list_contains(allowed_pets, cluster) ELSE len(list_filter(blocked_paths, lambda b: starts_with(path, b))) = 0 END GROUP BY 1, 2""",
    "combined_clusters": f"{_VIEW} SELECT 'face' AS kind, id, count, skipped FROM v UNION ALL SELECT 'pet', pet, count(*), false FROM (SELECT unnest(pet_ids) AS pet FROM photos) GROUP BY pet",
    "thumbnail_faces": f"{_OVER} SELECT ch.id, ch.path, min(d.seq) AS seq FROM (SELECT face_id AS id, max(path) AS path FROM detections GROUP BY 1) ch JOIN detections d ON d.path = ch.path LEFT JOIN closure c ON c.src = d.face_id WHERE coalesce(c.dst, d.face_id) = ch.id GROUP BY 1, 2",
    "viewer_stats": f"{a.with_(a.NAMES)} SELECT 8::BIGINT AS total, 8::BIGINT AS displayed, 2 * count(*) AS named, 0::BIGINT AS skipped, 0::BIGINT AS merges FROM names WHERE id IN ('face_2', 'face_3', 'face_5', 'face_7')",
    "cluster_metadata": f"{_VIEW} SELECT a.path, p.year, p.month FROM act a JOIN photos p ON p.path = a.path WHERE a.id = 'face_1' AND a.active",
    "cluster_metadata_admin": f"{_VIEW} SELECT f.path, p.year, p.month, f.gone AS removed FROM flagged f LEFT JOIN photos p ON p.path = f.path AND p.event_id % 4 <> 0 WHERE f.id = 'face_2' AND NOT (f.away AND NOT f.uc)",
    "detection_totals": f"{_D} SELECT count(DISTINCT path) AS n_images, count(*) AS n_faces, count(*) FILTER (WHERE seq % 7 = 0) AS n_noise, count(DISTINCT face_id) FILTER (WHERE seq % 7 <> 0) AS n_clusters FROM detections",
    "family_aliases": f"{_FAMILY} SELECT viewer, target, alias FROM known",
    "saved_graph": f"{_FAMILY} SELECT (SELECT count(DISTINCT c_custkey % 60) FROM customer) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM known) AS aliases, (SELECT count(*) FROM customer WHERE c_custkey % 3 > 0 AND c_custkey < 60) AS positions",
    "thumbnail_rights": f"{a.with_(a.PERMS)} SELECT name, cluster, is_admin OR (identity <> '' AND identity = cluster) AS may, is_admin OR list_contains(allowed_faces, cluster) AS sees FROM perms, (VALUES ('face_1'), ('face_2'), ('')) AS c(cluster)",
    "dropped_group": f"WITH {a.ACCOUNTS.format("WHERE grp <> 'r2'")} SELECT name, {a.HELD.format('faces')} AS allowed_faces FROM held",
}
