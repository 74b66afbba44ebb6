"""Operators against small definitions written here, and properties."""

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators import access, cluster, geocode, graph, index, labels, memories, overlay, search, timeline
from shoebox.sources import images, tables
from shoebox.streaming import logs


def follow(edges, start):
    seen, at = set(), start
    while at in edges and at not in seen:
        seen.add(at)
        at = edges[at]
    return at


def test_merge_closure_on_chains_tails_and_cycles(spark):
    edges = {"a": "b", "b": "c", "x": "y", "y": "x", "q": "t", "t": "x", "z": "z", "m": "n"}
    got = {r["src"]: r["dst"] for r in overlay.merge_closure(spark.createDataFrame(list(edges.items()), "src string, dst string")).collect()}
    assert got == {s: follow(edges, s) for s in edges}


def test_merge_closure_on_random_forests(spark):
    rng = random.Random(3)
    for _ in range(4):
        edges = {str(i): str(rng.randrange(12)) for i in rng.sample(range(12), 9)}
        got = {r["src"]: r["dst"] for r in overlay.merge_closure(spark.createDataFrame(list(edges.items()), "src string, dst string")).collect()}
        assert got == {s: follow(edges, s) for s in edges}


def test_merged_sources_take_the_end_s_name(spark):
    merges = spark.createDataFrame([("b", "c"), ("d", "a"), ("e", "c")], "src string, dst string")
    names = spark.createDataFrame([("a", "Ann"), ("c", "Cem")], "id string, name string")
    got = lambda sources, target: [(r.seq, r.entry, r.id, r.value) for r in overlay.merge_events(merges, names, sources, target, 10).collect()]
    # the end of b is c; a takes its name; c is the end, e leads there, d does so once a is merged
    assert got(["a", "c", "e", "d", "a", ""], "b") == [(10, "merge", "a", "c"), (11, "name", "a", "Cem")]
    assert got(["c"], "f") == [(10, "merge", "c", "f")] and got(["a"], "") == []


def test_next_user_id_fills_gaps(spark):
    used = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert overlay.next_user_id(used("face_u1", "face_u3", "face_2", "pet_u2"), "face") == "face_u2"
    assert overlay.next_user_id(used("face_9"), "face") == "face_u1"


def test_visibility_truth_table(spark):
    perms = [(admin, who, faces, pets, blocked) for admin in (True, False) for who in ("", "me") for faces in ([], ["f"]) for pets in ([], ["p"]) for blocked in ([], ["/x"])]
    photos = [(path, list(f), list(p)) for path in ("/x/1", "/y/1") for f in ([], ["me"], ["f"], ["o"]) for p in ([], ["p"], ["q"])]
    rows = [a + b for a, b in itertools.product(perms, photos)]
    df = spark.createDataFrame(rows, "is_admin boolean, identity string, allowed_faces array<string>, allowed_pets array<string>, blocked_paths array<string>, path string, f array<string>, p array<string>")

    def rule(admin, who, faces, pets, blocked, path, f, p):
        if admin or (who and who in f) or (p and (not pets or set(pets) & set(p))):
            return True
        return not any(path.startswith(b) for b in blocked) and bool(set(faces) & set(f))

    for r in df.withColumn("seen", access.can_see(F.col("path"), F.col("f"), F.col("p"))).collect():
        assert r["seen"] == rule(*r[:8]), r


def test_unknown_user_sees_nothing(spark):
    df = spark.sql("SELECT '/a' AS path, array('f') AS f, CAST(NULL AS BOOLEAN) AS is_admin, CAST(NULL AS STRING) AS identity, CAST(NULL AS ARRAY<STRING>) AS allowed_faces, CAST(NULL AS ARRAY<STRING>) AS allowed_pets, CAST(NULL AS ARRAY<STRING>) AS blocked_paths")
    assert df.select(access.can_see(F.col("path"), F.col("f"))).first()[0] is False


def library(spark, moments):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"p{i:03d}", None if m is None else start + datetime.timedelta(minutes=m), i % 2 == 0) for i, m in enumerate(moments)], "path string, taken_at timestamp_ntz, has_face boolean")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_split_exactly_at_long_gaps(spark, seed):
    rng = random.Random(seed)
    moments, at = [], 0
    for _ in range(120):
        at += rng.choice([0, 30, 360, 361, 700, 4000])
        moments.append(at)
    got = {(r["path"], r["start"]) for r in timeline.sessions(library(spark, [*moments, None]), "6 hours").collect()}
    start, want = moments[0], set()
    base = datetime.datetime(2024, 1, 1)
    for i, m in enumerate(moments):
        if i and m - moments[i - 1] > 360:
            start = m
        want.add((f"p{i:03d}", base + datetime.timedelta(minutes=start)))
    assert got == want


def test_events_keep_three_and_cover_near_the_middle(spark):
    got = timeline.events(library(spark, [0, 10, 20, 30, 2000, 2010, 9000, 9001, 9002]), "6 hours").orderBy("start").collect()
    assert [(r["photo_count"], r["cover"], r["duration_days"]) for r in got] == [(4, "p002", 1), (3, "p006", 1)]


def test_no_photos_no_events(spark):
    assert timeline.events(library(spark, [None]), "6 hours").count() == 0


def test_dbscan_matches_definition(spark):
    rng = random.Random(5)
    points = []
    for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1]):
        points += [[x + rng.uniform(-0.25, 0.25) for x in c] for _ in range(12)]
    points += [[-1, -1, 0.0], [-1, 0, -1.0]]
    unit = [[x / sum(v * v for v in p) ** 0.5 for x in p] for p in points]
    eps, least = 0.05, 3
    near = [[j for j in range(len(unit)) if 1 - sum(a * b for a, b in zip(unit[i], unit[j])) <= eps] for i in range(len(unit))]
    core = [len(n) >= least for n in near]
    label, n = [-1] * len(unit), 0
    for i in range(len(unit)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], n
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = n
                        stack.append(j)
            n += 1
    for i in range(len(unit)):
        if not core[i]:
            label[i] = min([label[j] for j in near[i] if core[j]], default=-1)
    df = spark.createDataFrame(list(enumerate(unit)), "id long, vector array<double>")
    assert {r["id"]: r["cluster"] for r in cluster.dbscan(df, eps, least).collect()} == dict(enumerate(label))


def test_nearest_is_the_same_blockwise(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, vector array<double>")
    targets = spark.createDataFrame(rows[:25], "target long, vector array<double>")
    small = {r["id"]: (r["target"], round(r["similarity"], 9)) for r in cluster.nearest(items, targets).collect()}
    monkeypatch.setattr(cluster, "SMALL_SIDE", 5)
    monkeypatch.setattr(cluster, "BLOCK", 8)
    assert small == {r["id"]: (r["target"], round(r["similarity"], 9)) for r in cluster.nearest(items, targets).collect()}


def test_propagation_thresholds(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.4, 0.0]), (4, [0.0, 1.0])], "id long, vector array<double>")
    seeds = spark.createDataFrame([(1, "x")], "id long, label string")
    got = {r["id"]: (r["label"], r["clustered"], r["is_seed"]) for r in cluster.propagate(items, seeds, 0.5).collect()}
    assert got == {1: ("x", True, True), 2: ("x", True, False), 3: (None, False, False), 4: (None, False, False)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_pages_join_to_the_whole_view(spark):
    view = spark.createDataFrame([(f"c{i:02d}", i % 7, i % 5 == 0) for i in range(30)], "id string, count int, skipped boolean")
    whole = [r["id"] for r in overlay.in_view_order(view, "c03").collect()]
    assert whole[0] == "c03"
    assert [r["id"] for n in range(3) for r in overlay.page(view, n, "c03", 10).collect()] == whole
    assert overlay.page(view, 99, "c03", 20).count() == 10


def test_search_rules(spark):
    face = "array<struct<id:string,name:string,det_score:double>>"
    df = spark.createDataFrame([("/a", [("f1", "Ann", 1.0)], None, 2024, 1, "Sea"), ("/b", [], "1,2", 2024, 2, None)], f"path string, faces {face}, location string, year int, month int, label string")
    find = lambda **w: [(r["path"], r["score"]) for r in search.search_index(df.withColumn("location_name", F.lit(None).cast("string")), search.Filters(**w), 5).collect()]
    assert find(query="sea") == [("/a", 1.0), ("/b", 0.0)]
    assert find(location="1,") == [("/b", 0.5)] and find(year=0, month=0) == [("/a", 0.0), ("/b", 0.0)]
    assert find(face="Ann") == find(faces=["f1"]) == [("/a", 1.0)]
    assert search.top_k(df.withColumn("score", F.lit(1)), 0).count() == 0


def test_labels_record_errors_and_go_on(spark):
    def call(path, content):
        if path == "bad":
            raise ValueError("no")
        return {"bytes": len(content), "response": "{}", "text": path.upper()}

    df = spark.createDataFrame([("a", b"xy"), ("bad", b""), ("c", b"z")], "path string, content binary")
    got = {r["path"]: (r["bytes"], r["text"], r["error"]) for r in labels.label_images(df, call).collect()}
    assert got == {"a": (2, "A", None), "bad": (None, None, "ValueError: no"), "c": (1, "C", None)}


def test_success_outlives_a_later_failure(spark):
    log = spark.createDataFrame([("a", "one", None, 1), ("a", None, "x", 2), ("b", None, "x", 3)], "path string, text string, error string, seq long")
    assert [tuple(r) for r in labels.latest_success(log).collect()] == [("a", "one", 1)]


def test_scan_and_bundle(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", ".c.jpg", "d.txt", "@eaDir/e.jpg", "x/f.webp", ".h/g.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\x01\x02")
    found = images.scan(spark, str(tmp_path))
    assert sorted(r["path"].removeprefix(str(tmp_path)) for r in found.select("path").collect()) == ["/a.jpg", "/b.PNG", "/x/f.webp"]
    vectors = images.embed(found, lambda batch: [[3.0, 4.0]] * len(batch), 2)
    exif = spark.createDataFrame([], tables.BUNDLE).select("exif", "model")
    rows = vectors.select("path", "vector", F.lit(None).cast(exif.schema["exif"].dataType).alias("exif"), F.lit("m").alias("model"), "dim")
    bundle = str(tmp_path / "bundle")
    assert tables.read_bundle(spark, bundle).count() == 0
    assert tables.append_new(rows.limit(2), bundle).count() == 2 and tables.append_new(rows, bundle).count() == 3
    assert images.exif(found).count() == 3
    markers = images.detect(found, lambda c: [{"bbox": [0.0, 0.0, 1.0, 1.0], "score": 0.5, "vector": [1.0]}]).collect()
    assert {m["outcome"] for m in markers} == {"found"}


def test_label_files_in_order_last_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"path": "p", "text": "old"}, {"path": "q", "error": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"path": "p", "text": "new"}]}))
    (tmp_path / ".c.json").write_text("{}")
    rows = tables.read_label_files(spark, [str(tmp_path)])
    assert [tuple(r) for r in index.captions(rows).collect()] == [("p", "new")]
    with pytest.raises(FileNotFoundError):
        tables.read_label_files(spark, [str(tmp_path / "none")])


def test_broken_log_lines_are_dropped(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"path":"a","cluster":1}\nnot json\n{"path":"b","cluster":2}\n')
    assert tables.read_log(spark, str(tmp_path / "log.jsonl"), "path string, cluster int").count() == 2
    assert tables.read_overlay(spark, str(tmp_path / "absent"), "id string").count() == 0


def test_metadata_root_order(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("PHOTO_METADATA_DIR", raising=False)
    env = tmp_path / ".env"
    assert tables.metadata_root(spark, str(env)) == "metadata"
    env.write_text('PHOTO_METADATA_DIR="/from/file"\n')
    assert tables.metadata_root(spark, str(env)) == "/from/file"
    monkeypatch.setenv("PHOTO_METADATA_DIR", "/from/env")
    assert tables.metadata_root(spark, str(env)) == "/from/env"


def test_draining_twice_adds_nothing(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a",), ("b",), ("a",)], "path string").write.parquet(source)
    run = lambda: logs.drain(spark, source, "path string", target, state, lambda b: b.withColumn("done", F.lit(True)), files_per_batch=1)
    assert run().count() == 2
    spark.createDataFrame([("b",), ("c",)], "path string").write.mode("append").parquet(source)
    assert sorted(r["path"] for r in run().collect()) == ["a", "b", "c"]


def test_year_folders_prune(spark, tmp_path):
    df = spark.createDataFrame([("/a", 2023), ("/b", 2024)], "path string, year int")
    tables.write_index(df, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).where("year = 2024").count() == 1


def test_far_points_still_find_a_city(spark):
    cities = spark.createDataFrame([(10.0, 10.0, "Near", "n"), (60.0, 100.0, "Far", "f")], "lat double, lng double, city string, cc string")
    points = spark.createDataFrame([(10.2, 10.1), (55.0, 80.0)], "lat double, lng double")
    assert {r["city"] for r in geocode.nearest_city(points, cities).collect()} == {"Near", "Far"}


def test_picks_depend_on_the_seed_only(spark):
    cards = spark.createDataFrame([("place", f"c{i}", "t", i) for i in range(9)] + [("trip", f"t{i}", "t", i) for i in range(9)], "kind string, card_id string, title string, n int")
    one, two = (memories.pick(cards, "s").collect() for _ in range(2))
    assert one == two and sorted(r["kind"] for r in one) == ["place", "trip", "trip", "trip"]


def test_people_fall_back_when_nobody_is_known(spark):
    rows = [(f"p{i}", 2024, 1, ["f1"]) for i in range(9)]
    photos = spark.createDataFrame(rows, "path string, year int, month int, face_ids array<string>")
    names = spark.createDataFrame([("f1",)], "id string")
    assert memories.people(photos, names, ["f9"]).count() == 1


def test_long_chains_and_tails_of_cycles_end(spark):
    n = 3000
    rows = [(f"c{i}", f"c{i + 1}") for i in range(n)] + [("p", "q"), ("q", "r"), ("r", "p")] + [(f"t{i}", f"t{i + 1}" if i < 40 else "q") for i in range(41)]
    got = {r["src"]: r["dst"] for r in overlay.merge_closure(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert all(got[f"c{i}"] == f"c{n}" for i in range(n)) and {got[x] for x in "pqr"} == set("pqr") and all(got[x] == x for x in "pqr")
    assert all(got[f"t{i}"] == "q" for i in range(41))


def test_overlay_writers_keep_their_guards(spark, tmp_path):
    log = str(tmp_path / "log")
    used = spark.createDataFrame([("face_u1",)], "id string")
    overlay.append_events(overlay.move_events(["/a", "/b"], "face_1", "__new__", used, 1, name=" New "), log)
    overlay.append_events(overlay.move_events(["/a"], "face_1", "face_1", used, 9), log)
    overlay.append_events(overlay.name_events(spark, {"face_2": "Bo", "face_3": " "}, 10), log)
    skipped = spark.createDataFrame([("face_4",)], "id string")
    overlay.append_events(overlay.skip_events(skipped, ["face_4", "face_5", "face_5"], 20), log)
    overlay.append_events(overlay.remove_events(spark, "face_6", ["/c", ""], 30), log)
    overlay.append_events(overlay.clear_events(spark, "move", ["face_1"], 40, "/b"), log)
    events = overlay.read_events(spark, log)
    state = lambda entry: {tuple(r) for r in overlay.log_state(events, entry).drop("seq").collect()}
    assert state("move") == {("face_1", "/a", "face_u2")} and state("skip") == {("face_5", None, "1")} and state("remove") == {("face_6", "/c", "1")}
    assert {(i, v) for i, _, v in state("name")} == {("face_u2", "New"), ("face_2", "Bo")}
    assert [r.value for r in overlay.skip_toggle(skipped, "face_4", 1).collect()] == [None] and overlay.skip_toggle(skipped, "face_9", 1).first().value == "1"
    perms = lambda admin, who: spark.createDataFrame([(admin, who, [])], "is_admin boolean, identity string, allowed_faces array<string>")
    assert [overlay.thumbnail_event(perms(*p), "face_1", "/a", 1).count() for p in ((True, ""), (False, "face_1"), (False, "face_2"), (False, ""))] == [1, 1, 0, 0]
    assert overlay.read_events(spark, str(tmp_path / "absent")).count() == 0


def test_the_last_admin_stays(spark):
    users = spark.createDataFrame([("ann", "admin", "", ["g"]), ("bob", "viewer", "", [])], "name string, role string, identity string, groups array<string>")
    for write in (lambda: access.drop_user(users, "ann"), lambda: access.put_user(users, "ann", "viewer", []), lambda: access.put_user(users, " ", "viewer", []), lambda: access.put_user(users, "x", "king", [])):
        with pytest.raises(access.Refused):
            write()
    two = access.put_user(users, "cid", "admin", ["g"])
    assert {r["name"] for r in access.drop_user(two, "ann").collect()} == {"bob", "cid"} and access.drop_user(users, "bob").count() == 1
    groups = access.put_group(spark.createDataFrame([], "name string, allowed_faces array<string>, allowed_pets array<string>, blocked_paths array<string>"), "g", ["f", " f ", ""], [], ["/x"])
    assert [tuple(r) for r in groups.collect()] == [("g", ["f"], [], ["/x"])]


def test_a_saved_graph_is_clean(spark, tmp_path):
    nodes = spark.createDataFrame([("a ",), ("b",), ("",), ("b",)], "id string")
    edges = spark.createDataFrame([(1, " a", "b ", "父 ", " Pa ", ""), (2, "a", " a", "父", "", ""), (3, "a", "b", " ", "", ""), (4, None, "b", "父", "", "")], "seq long, src string, dst string, type string, alias_from string, alias_to string")
    positions = spark.createDataFrame([("a", 1.0, 2.0), ("c", 1.0, 2.0), ("b", None, 2.0)], "id string, x double, y double")
    assert tuple(access.save_graph(nodes, edges, positions, (), str(tmp_path)).first()) == (2, 1, 2)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/aliases").collect()} == {("a", "b", "Pa"), ("b", "a", "爸爸")}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/positions").collect()] == [("a", 1.0, 2.0)]


def test_a_corrupt_overlay_reads_as_empty(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"id": "a"}\n{"id": \n')
    (tmp_path / "good.json").write_text('{"id": "a"}\n')
    assert [tables.read_overlay(spark, str(tmp_path / f), "id string").count() for f in ("bad.json", "good.json")] == [0, 1]


def test_kmeans_takes_the_best_of_its_starts(spark):
    rng = random.Random(5)
    corners = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in corners[i % 6]]) for i in range(120)]
    got = cluster.kmeans(spark.createDataFrame(rows, "id long, vector array<double>"), 6).collect()
    assert {len({r["cluster"] for r in got if r["id"] % 6 == j}) for j in range(6)} == {1} and len({r["cluster"] for r in got}) == 6
    assert cluster.usual_k(200) == 10 and cluster.usual_k(1) == 2


def test_face_phases_resume_where_they_stopped(spark):
    from shoebox.operators import faces

    rng = random.Random(2)
    rows = [(i, f"/p/{i:03d}", "d", [1.0 + rng.gauss(0, 0.01), rng.gauss(0, 0.01)] if i % 2 else [rng.gauss(0, 0.01), 1.0]) for i in range(40)]
    found = spark.createDataFrame(rows, "id long, path string, stratum string, vector array<double>")
    first = faces.three_phases(found, "s", most=15)
    assert sorted(r["path"] for r in first.collect()) == [f"/p/{i:03d}" for i in range(15)]
    rest = faces.three_phases(found, "s", done=first.select("path")).collect()
    assert len(rest) == 25 and len({r["face_id"] for r in rest if r["id"] % 2}) == 1 and len({r["face_id"] for r in rest}) == 2
    assert {r["face_id"] for r in faces.assign_faces(found, found.select(F.lit(0).alias("cluster"), "vector").limit(0)).collect()} == {"unknown"}


def test_no_row_holds_an_event(spark):
    """An event's text in pieces, its digest, positions and cover without any row that grows with the event."""
    import hashlib

    photos = library(spark, [i // 3 for i in range(2000)] + [9000, 9001, 9002, 20000])
    found = timeline.members(photos, "10 minutes")
    whole = {r["id"]: r for r in timeline.events(photos, "10 minutes").collect()}
    assert [r["photo_count"] for r in sorted(whole.values(), key=lambda r: r["start"])] == [2000, 3]
    assert {(r["id"], r["pos"]): r["path"] for r in found.collect()} == {(i, k): p for i, r in whole.items() for k, p in enumerate(r["photos"])}
    assert timeline.pieces(found).agg(F.max(F.size(F.split("text", ",")))).first()[0] == timeline.PIECE
    assert {r["id"]: r["photos_md5"] for r in timeline.digests(found).collect()} == {i: hashlib.md5(",".join(r["photos"]).encode()).hexdigest() for i, r in whole.items()}
    same = ["id", "start", "end", "duration_days", "photo_count"]
    assert {tuple(r) for r in timeline.heads(found).select(*same, "cover").collect()} == {tuple(r[c] for c in [*same, "cover"]) for r in whole.values()}
    assert {tuple(r) for r in timeline.spans(photos, "10 minutes").select(*same).collect()} == {tuple(r[c] for c in same) for r in whole.values()}
