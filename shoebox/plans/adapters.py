"""Driver tables seen as a photo library, once for Spark and once as SQL for the oracle.

Events are photos: a path, a time, one or two detected faces, a place; documents are captions,
embeddings vectors, orders a library over several years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, taken_at, event_id, user_id, event_type, det_score, k, location, location_name, face_ids, has_face, pet_ids``."""
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")
    faces = F.array_compact(F.array(
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("face_"), "user_id")), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("face_"), F.col("user_id") + 1)),
    ))
    pets = F.when(F.col("event_id") % 13 == 0, F.array(F.concat(F.lit("pet_"), F.col("event_id") % 3))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/lib/"), "event_type", F.lit("/u"), "user_id", F.lit("/IMG_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), "event_id", F.lit(".jpg")).alias("path"),
        second.alias("taken_at"), "event_id", "user_id", "event_type", F.col("value").alias("det_score"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.when(F.col("event_id") % 5 != 0, F.concat((F.col("event_id") % 90).cast("string"), F.lit(".0000,"), (F.col("event_id") % 180).cast("string"), F.lit(".0000"))).alias("location"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("location_name"),
        faces.alias("face_ids"), (F.size(faces) > 0).alias("has_face"), pets.alias("pet_ids"), F.year("ts").alias("year"), F.month("ts").alias("month"),
    )


PHOTOS = """photos AS (
  SELECT '/lib/' || event_type || '/u' || user_id || '/IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_id || '.jpg' AS path,
    date_trunc('second', ts) AS taken_at, event_id, user_id, event_type, value AS det_score, CAST(props->>'$.k' AS BIGINT) AS k,
    CASE WHEN event_id % 5 <> 0 THEN (event_id % 90) || '.0000,' || (event_id % 180) || '.0000' END AS location,
    CASE WHEN event_id % 7 <> 0 THEN event_type END AS location_name,
    list_filter([CASE WHEN user_id % 4 <> 0 THEN 'face_' || user_id END, CASE WHEN event_id % 10 = 0 THEN 'face_' || (user_id + 1) END], lambda x: x IS NOT NULL) AS face_ids,
    (user_id % 4 <> 0 OR event_id % 10 = 0) AS has_face,
    CASE WHEN event_id % 13 = 0 THEN ['pet_' || (event_id % 3)] ELSE CAST([] AS VARCHAR[]) END AS pet_ids, year(ts) AS year, month(ts) AS month
  FROM events)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name`` of every second face."""
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("face_"), "c_custkey").alias("id"), F.col("c_name").alias("name"))


NAMES = "names AS (SELECT 'face_' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, seq, face_id, det_score``: one row per face of a photo; ``seq`` orders the library."""
    return photos(spark, sf_dir).select("path", F.posexplode("face_ids").alias("i", "face_id"), "event_id", "det_score").select(
        "path", (F.col("event_id") * 2 + F.col("i")).alias("seq"), "face_id", "det_score"
    )


DETECTIONS = """detections AS (
  SELECT path, event_id * 2 + i - 1 AS seq, face_ids[i] AS face_id, det_score FROM (SELECT *, unnest(range(1, len(face_ids) + 1)) AS i FROM photos))"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with captions and named faces, as the index holds them."""
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("label"))
    named = F.transform("face_ids", lambda f: F.struct(f.alias("id"), F.concat(F.lit("P"), F.substring(f, 6, 20)).alias("name"), F.lit(1.0).alias("det_score")))
    return photos(spark, sf_dir).join(text, "event_id", "left").withColumn("faces", named)


INDEX = "idx AS (SELECT p.*, d.text AS label FROM photos p LEFT JOIN documents d ON d.doc_id = p.event_id)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster"))


ITEMS = "items AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS cluster FROM embeddings)"


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as the query of a search."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, translation`` of half of the photos' places and of the orders' priorities."""
    places = table(spark, sf_dir, "events").select(F.col("event_type").alias("word")).union(table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()
    return places.where("ascii(word) % 2 = 1").select("word", F.concat(F.lit("地"), F.reverse("word")).alias("translation"))


WORDS = """words AS (SELECT word, '地' || reverse(word) AS translation
  FROM (SELECT event_type AS word FROM events UNION SELECT o_orderpriority FROM orders) WHERE ascii(word) % 2 = 1)"""
#: A place as it is shown: translated whole, else by its part before the first comma (no place here has one), else as it is.
SHOWN = "coalesce((SELECT translation FROM words WHERE word = {0}), {0})"


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge forest over suppliers with a cycle of two, a tail into it, and a self loop."""
    forest = table(spark, sf_dir, "supplier").where("s_suppkey > 2").select(F.concat(F.lit("face_"), "s_suppkey").alias("src"), F.concat(F.lit("face_"), (F.col("s_suppkey") / 3).cast("long")).alias("dst"))
    return forest.union(spark.createDataFrame([("x", "y"), ("y", "x"), ("t", "x"), ("z", "z")], "src string, dst string"))


MERGES = """merges AS (
  SELECT 'face_' || s_suppkey AS src, 'face_' || (s_suppkey // 3) AS dst FROM supplier WHERE s_suppkey > 2
  UNION ALL VALUES ('x', 'y'), ('y', 'x'), ('t', 'x'), ('z', 'z'))"""

CLOSURE = """walk AS (
  SELECT DISTINCT src AS start, src AS cur, [src] AS met FROM merges
  UNION ALL SELECT w.start, m.dst, list_append(w.met, m.dst) FROM walk w JOIN merges m ON m.src = w.cur
  WHERE len(w.met) = 1 OR NOT list_contains(w.met[:len(w.met) - 1], w.cur)
), closure AS (SELECT start AS src, arg_max(cur, len(met)) AS dst FROM walk GROUP BY start)"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).where("event_id % 11 = 0 and size(face_ids) > 0").select(
        "path", F.try_element_at("face_ids", F.lit(1)).alias("src"), F.when(F.col("event_id") % 22 == 0, F.lit("face_u1")).otherwise(F.lit("face_3")).alias("dst"), F.col("event_id").alias("seq")
    )


MOVES = "moves AS (SELECT path, face_ids[1] AS src, CASE WHEN event_id % 22 = 0 THEN 'face_u1' ELSE 'face_3' END AS dst, event_id AS seq FROM photos WHERE event_id % 11 = 0 AND len(face_ids) > 0)"


def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).where("event_id % 17 = 0 and size(face_ids) > 0").select(F.try_element_at("face_ids", F.lit(-1)).alias("id"), "path")


REMOVED = "removed AS (SELECT face_ids[-1] AS id, path FROM photos WHERE event_id % 17 = 0 AND len(face_ids) > 0)"


def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select(F.concat(F.lit("face_"), "c_custkey").alias("id"))


SKIPPED = "skipped AS (SELECT 'face_' || c_custkey AS id FROM customer WHERE c_custkey % 9 = 0)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select(F.col("face_id").alias("id"), "path", "seq")


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("ann", "admin", "face_1", []), ("bob", "viewer", "face_2", ["family", "friends"]), ("cid", "viewer", "", ["pets"]), ("dee", "viewer", None, [])],
        "name string, role string, identity string, groups array<string>",
    )


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("family", ["face_3", "face_5"], [], ["/lib/error/"]), ("friends", ["face_5", "face_7"], [], ["/lib/error/", "/lib/click/u9"]), ("pets", [], ["pet_0"], ["/lib/view/"])],
        "name string, allowed_faces array<string>, allowed_pets array<string>, blocked_paths array<string>",
    )


def accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(users, groups) of a large household: customers, with a group for each nation and each region."""
    key, none = F.col("c_custkey"), F.array().cast("array<string>")
    named = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    people = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.when(key % 100 == 0, "admin").otherwise("viewer").alias("role"), F.when(key % 3 > 0, named("face_", key)).otherwise("").alias("identity"),
        F.array(named("n", F.col("c_nationkey")), named("r", key % 5)).alias("groups"),
    )
    n = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").select(
        named("n", n).alias("name"), F.array(named("face_", n), named("face_", F.col("n_regionkey"))).alias("allowed_faces"),
        F.when(n % 2 == 0, F.array(named("pet_", n))).otherwise(none).alias("allowed_pets"), F.array(named("/n/", n)).alias("blocked_paths"),
    )
    regions = table(spark, sf_dir, "region").select(named("r", F.col("r_regionkey")).alias("name"), F.array(named("face_", F.col("r_regionkey") + 1)).alias("allowed_faces"), none.alias("allowed_pets"), none.alias("blocked_paths"))
    return people, nations.union(regions)


ACCOUNTS = """groups AS (
  SELECT 'n' || n_nationkey AS grp, ['face_' || n_nationkey, 'face_' || n_regionkey] AS faces, CASE WHEN n_nationkey % 2 = 0 THEN ['pet_' || n_nationkey] ELSE CAST([] AS VARCHAR[]) END AS pets, ['/n/' || n_nationkey] AS blocked FROM nation
  UNION ALL SELECT 'r' || r_regionkey, ['face_' || (r_regionkey + 1)], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM region),
users AS (SELECT c_name AS name, c_custkey % 100 = 0 AS is_admin, CASE WHEN c_custkey % 3 > 0 THEN 'face_' || c_custkey ELSE '' END AS identity, unnest(['n' || c_nationkey, 'r' || (c_custkey % 5)]) AS grp FROM customer),
held AS (SELECT name, is_admin, identity, flatten(list(faces)) || CASE WHEN identity <> '' THEN [identity] ELSE CAST([] AS VARCHAR[]) END AS faces, flatten(list(pets)) AS pets, flatten(list(blocked)) AS blocked FROM users JOIN groups USING (grp) {0} GROUP BY 1, 2, 3)"""
#: A list of ``held`` as text: distinct and sorted, empty for admins.
HELD = "CASE WHEN is_admin THEN '' ELSE array_to_string(list_sort(list_distinct({0})), ',') END"

PERMS = """perms AS (SELECT * FROM (VALUES
  ('ann', true, 'face_1', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])),
  ('bob', false, 'face_2', ['face_2', 'face_3', 'face_5', 'face_7'], CAST([] AS VARCHAR[]), ['/lib/click/u9', '/lib/error/']),
  ('cid', false, '', CAST([] AS VARCHAR[]), ['pet_0'], ['/lib/view/']),
  ('dee', false, '', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]))
) AS t(name, is_admin, identity, allowed_faces, allowed_pets, blocked_paths))"""

#: SQL of the photo predicate over columns path, face_ids, pet_ids and those of ``perms``.
CAN_SEE = """CASE WHEN is_admin THEN true WHEN identity <> '' AND list_contains(face_ids, identity) THEN true
  WHEN len(pet_ids) > 0 AND (len(allowed_pets) = 0 OR list_has_any(pet_ids, allowed_pets)) THEN true
  WHEN len(list_filter(blocked_paths, lambda b: starts_with(path, b))) > 0 THEN false
  WHEN list_has_any(face_ids, allowed_faces) THEN true ELSE false END"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "
