"""Single-document files: shapes as people and other programs write them, corruption, replacement."""

import json

import pytest

from shoebox.sources import documents, tables

NAMES = {"face_1": "Ann \"A\"", "face_2": "阿明", "x/y": ""}
MOVES = [{"path": "/a.jpg", "from": "face_1", "to": "face_u1"}, {"path": "/b.jpg", "from": "face_2", "to": "face_1"}]


def save(path, data):
    path.write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_curated(spark, tmp_path):
    read = lambda kind, data: [tuple(r) for r in documents.read_curated(spark, save(tmp_path / f"{kind}.json", data), kind).collect()]
    assert dict(read("names", NAMES)) == NAMES
    assert read("moves", MOVES) == [("/a.jpg", "face_1", "face_u1", 0), ("/b.jpg", "face_2", "face_1", 1)]
    assert sorted(read("removed", {"f": ["/a", "/b"], "g": []})) == [("f", "/a"), ("f", "/b")]
    assert read("skipped", ["b", "a"]) == [("b",), ("a",)]
    assert read("names", ["of", "another", "shape"]) == [] and read("moves", []) == []


@pytest.mark.parametrize("text", ['{"a": "b"', '{"a": "b"} trailing', '{"a": "b"}\n{"c": "d"}', '1],["x"', "{} , {}"])
def test_corrupt(spark, tmp_path, text):
    path = tmp_path / "names.json"
    path.write_text(text)
    assert documents.document_state(spark, str(path)) == "corrupt"
    assert documents.read_curated(spark, str(path), "names").count() == 0


def test_absent_and_sound(spark, tmp_path):
    assert documents.document_state(spark, str(tmp_path / "none.json")) == "absent"
    assert documents.document_state(spark, save(tmp_path / "n.json", NAMES)) == "sound"


def test_overlay_over_lines(spark, tmp_path):
    rows = [{"id": "a", "name": "A\nB"}, {"id": "b", "name": None}]
    read = lambda path: sorted(map(tuple, tables.read_overlay(spark, path, "id string, name string").collect()))
    want = [("a", "A\nB"), ("b", None)]
    assert read(save(tmp_path / "list.json", rows)) == want
    assert read(save(tmp_path / "one.json", rows[0])) == want[:1]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    assert read(str(tmp_path / "lines.json")) == want
    (tmp_path / "cut.json").write_text(json.dumps(rows, indent=2)[:-3])
    assert read(str(tmp_path / "cut.json")) == [] and read(str(tmp_path / "absent")) == []


@pytest.mark.parametrize("parts", [1, 5])
def test_written_documents(spark, tmp_path, parts):
    path = str(tmp_path / "out.json")
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in NAMES.items()], "key string, value string").repartitionByRange(parts, "key").sortWithinPartitions("key")
    documents.write_document(rows, path)
    documents.write_document(rows, path)
    text = (tmp_path / "out.json").read_text(encoding="utf-8")
    assert text == json.dumps(dict(sorted(NAMES.items())), indent=2, ensure_ascii=False)
    documents.write_document(rows, path, "map", "images", {"total_images": 3, "built_at": "t"})
    assert (tmp_path / "out.json").read_text(encoding="utf-8") == json.dumps({"total_images": 3, "built_at": "t", "images": dict(sorted(NAMES.items()))}, indent=2, ensure_ascii=False)
    documents.write_document(rows.limit(0), path, "list", "events", {"n": 0})
    assert json.loads((tmp_path / "out.json").read_text()) == {"n": 0, "events": []}
    assert [p.name for p in tmp_path.iterdir()] == ["out.json"]


def test_failed_write_keeps_the_old_document(spark, tmp_path):
    path = save(tmp_path / "kept.json", NAMES)
    bad = spark.createDataFrame([("a", "1"), ("b", "no json")], "key string, value string").repartition(2)
    with pytest.raises(Exception, match="no json|JSONDecodeError|Expecting"):
        documents.write_document(bad, path)
    assert json.loads((tmp_path / "kept.json").read_text(encoding="utf-8")) == NAMES and [p.name for p in tmp_path.iterdir()] == ["kept.json"]


def test_large_documents_are_read_by_lines(spark, tmp_path, monkeypatch):
    """The same entries by lines as whole; a document with one broken entry, or one comma too few, reads as empty."""
    images = {f"/p \"{i}\" {{.jpg": {"n": i, "faces": [f"f{k}" for k in range(i % 3)], "at": None if i % 2 else "2024: ["} for i in range(300)}
    events = [{"id": f"e{i}", "photos": [f"/p{i},{k}]" for k in range(3 + 90 * (i % 2))], "cover": f"c{i}"} for i in range(9)]
    index, told = {"built_at": "t", "images": images}, {"built_at": "t", "events": events}
    paths = save(tmp_path / "index.json", index), save(tmp_path / "timeline.json", told)
    monkeypatch.setattr(documents, "WHOLE_BYTES", 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    whole = []
    keep = documents.read_part
    monkeypatch.setattr(documents, "read_part", lambda *a: whole.append(a) or keep(*a))
    try:
        shape = "struct<n:long,faces:array<string>,at:string>"
        got = {r["path"]: {"n": r["n"], "faces": r["faces"], "at": r["at"]} for r in documents.read_index(spark, paths[0], shape).collect()}
        assert got == images and not whole
        heads, photos = documents.read_timeline_rows(spark, paths[1], "struct<id:string,photos:array<string>,cover:string>")
        heads = heads.orderBy("seq").collect()
        assert [(r["id"], r["cover"]) for r in heads] == [(e["id"], e["cover"]) for e in events] and not whole
        name = {r["seq"]: r["id"] for r in heads}
        assert sorted((name[r["seq"]], r["photo"]) for r in photos.collect()) == sorted((e["id"], p) for e in events for p in e["photos"])
        for broken in (lambda t: t.replace('"n": 7,', '"n": 7'), lambda t: t.replace("    },\n", "    }\n", 1), lambda t: t.replace('"f1"\n', '"f1\n', 1)):
            (tmp_path / "cut.json").write_text(broken((tmp_path / "index.json").read_text(encoding="utf-8")), encoding="utf-8")
            assert documents.read_index(spark, str(tmp_path / "cut.json"), shape).count() == 0
        del index["images"]["/p \"0\" {.jpg"]
        assert documents.read_index(spark, save(tmp_path / "index.json", {"more": {"a": [1]}} | index), shape).count() == 299 and whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_timeline_document_of_pieces(spark, tmp_path):
    photos = [(f"e{i}", f"t{i}", k, f"/p\"{i} {k}\\") for i in range(3) for k in range(70 * i + 3)]
    events = [(f"e{i}", f"t{i}", None if i == 1 else f"c{i}") for i in range(3)]
    rows = spark.createDataFrame(photos, "id string, start string, pos long, path string").repartition(3)
    documents.write_timeline_document(spark.createDataFrame(events, "id string, start string, cover string"), rows, str(tmp_path / "t.json"), "b", 0.5, 3)
    want = [{"id": e, "start": s, "photos": [p[3] for p in photos if p[0] == e], "cover": c} for e, s, c in events[::-1]]
    assert (tmp_path / "t.json").read_text(encoding="utf-8") == json.dumps({"built_at": "b", "gap_hours": 0.5, "min_photos": 3, "total_events": 3, "events": want}, indent=2, ensure_ascii=False)
