"""Column functions at their edges."""

import struct

import pytest
from pyspark.sql import functions as F

from shoebox.functions import boxes, geo, paths, places, text, times, vectors
from shoebox.operators import geocode, search
from shoebox.sources import images


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column.alias("v")).collect()]


def test_file_names_give_times(spark):
    names = ["/a/IMG_20230815_101112.jpg", "IMG-20230815-WA0001.jpg", "2023-08-15 10.11.12.png", "20231399.jpg", "20230230_101010.jpg", "cat.jpg", None]
    got = values(spark, F.date_format(times.filename_time(F.col("x")), "yyyy-MM-dd HH:mm:ss"), names)
    assert got == ["2023-08-15 10:11:12", "2023-08-15 12:00:00", "2023-08-15 10:11:12", None, None, None, None]


def test_strata(spark):
    assert values(spark, times.stratum_date(F.col("x")), ["/p/IMG_20230815_1.jpg", "/p/2019/a.jpg", "/p/1850/a.jpg", "/p/IMG_20239915_1.jpg", "a.jpg"]) == ["2023-08-15", "2019", "unknown", "unknown", "unknown"]
    assert values(spark, times.compact_date(F.col("x")), ["a20240522b.jpg", "120240522.jpg"]) == ["2024-05-22", None]


def test_exif_times_accept_both_forms_and_reject_others(spark):
    got = values(spark, F.date_format(times.exif_time(F.col("x")), "yyyy-MM-dd HH:mm:ss"), ["2024:1:2 3:04:05", "2024-01-02 03:04:05", "2024:02:30 00:00:00", "", None])
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", None, None, None]


def test_date_bounds_are_midnights(spark):
    keep = search.between_dates(F.col("x"), "2024:01:01".replace(":", "-"), "2024-01-02")
    assert values(spark, keep, ["2024:01:02 00:00:00", "2024:01:02 00:00:01", "2023:12:31 23:59:59", "bad", None]) == [True, False, False, False, False]


@pytest.mark.parametrize("keys", [("1", "2", "3", "4"), ("GPSLatitudeRef", "GPSLatitude", "GPSLongitudeRef", "GPSLongitude")])
def test_positions_from_either_key_spelling(spark, keys):
    gps = dict(zip(keys, ["S", "[25.0, 2.0, 30.0]", "E", "121.5"]))
    row = spark.createDataFrame([(gps,)], "g map<string,string>").select(geo.position_of_map(F.col("g")).alias("p")).first()["p"]
    assert row.lat == pytest.approx(-25.041666, abs=1e-5) and row.lng == 121.5


def test_no_position_at_zero_or_out_of_range(spark):
    rows = [({"2": "0", "4": "0"},), ({"2": "91", "4": "0"},), ({"2": "x", "4": "1"},), ({},), (None,)]
    assert all(r["p"] is None for r in spark.createDataFrame(rows, "g map<string,string>").select(geo.position_of_map(F.col("g")).alias("p")).collect())


def test_coordinates_round_half_even(spark):
    assert values(spark, geo.rounded(F.col("x")), [2.00005, 2.00015], "x double") == [2.0, 2.0002]


def test_skipped_paths(spark):
    names = ["/a/b.jpg", "", None, "/a/.thumbnails/b.jpg", "/A/@EADIR/b.jpg", "/a/./b.jpg", "/a/../b.jpg", "/a/.b.jpg", "\\a\\.cache\\b.jpg"]
    assert values(spark, paths.is_skipped(F.col("x")), names) == [False, True, True, True, True, False, False, True, True]
    assert values(spark, paths.url_path(F.col("x")), ["a+b%20c//d", "/x"]) == ["/a+b c/d", "/x"]


def test_topics_count_distinct_leftmost_words(spark):
    hits = text.distinct_hits(F.col("x"), ["生日蛋糕", "蛋糕", "慶祝"], ["上海"])
    assert values(spark, hits, ["生日蛋糕", "生日蛋糕和蛋糕", "慶祝慶祝", "上海慶祝蛋糕", "", None]) == [1, 2, 1, 0, 0, 0]


def test_fixed_topics_are_searchable(spark):
    icon, include, exclude = text.TOPICS["海景"]
    assert values(spark, text.distinct_hits(F.col("x"), include, exclude), ["海邊的沙灘", "上海的海邊沙灘"]) == [2, 0]


def test_small_text_rules(spark):
    assert values(spark, text.has_cjk(F.col("x")), ["abc", "a海", None]) == [False, True, False]
    assert values(spark, text.split_list(F.col("x")), [" a, ,b ", None]) == [["a", "b"], []]
    assert values(spark, text.preview(F.col("x"), 3), ["abcd", "abc"]) == ["abc...", "abc"]


def test_unit_vectors_and_automatic_k(spark):
    assert values(spark, vectors.unit(F.col("x")), [[3.0, 4.0], [0.0, 0.0]], "x array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    assert [vectors.automatic_k(n) for n in (0, 1, 2, 8, 50, 200)] == [1, 1, 2, 2, 5, 10]


def test_boxes(spark):
    whole = lambda c: values(spark, c, [[10.0, 10.0, 20.0, 30.0], [5.0, 9.0, 10.0, 9.0]], "x array<double>")
    assert whole(boxes.face_crop(F.col("x"), F.lit(25), F.lit(100))) == [[7, 4, 23, 36], None]
    assert whole(boxes.padded(F.col("x"), F.lit(0.5), F.lit(100), F.lit(100))) == [[19, 18, 41, 62], None]
    got = values(spark, boxes.resized(F.col("x"), F.lit(10), 1000), [4000, 500, 1], "x int")
    assert [tuple(r) for r in got] == [(1000, 2), (500, 10), (1, 10)]


def tiff(entries, order="<"):
    """A TIFF block with one directory of (tag, kind, values) entries and a nested GPS directory."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    at, body, tail = 8 + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, raw in entries:
        count = len(raw) // {2: 1, 3: 2, 4: 4, 5: 8}[kind]
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(tail))
        tail += raw if len(raw) > 4 else b""
        body += struct.pack(order + "HHI", tag, kind, count) + value
    return head + struct.pack(order + "H", len(entries)) + body + bytes(4) + tail


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_is_read_by_name(order):
    data = tiff([(0x010F, 2, b"Maker\0"), (0x829D, 5, struct.pack(order + "II", 28, 10)), (0x0112, 3, struct.pack(order + "H", 6)), (0x9999, 2, b"x\0")], order)
    found = images.parse_exif(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + data)
    assert found == {"Make": "Maker", "FNumber": 2.8, "Orientation": 6.0}


def test_broken_exif_is_empty():
    assert images.parse_exif(b"") == images.parse_exif(b"II*\0\xff\xff\xff\x7f") == images.parse_exif(b"Exif\0\0MM") == {}


def test_shipped_place_names_yield_to_own_ones(spark):
    own = spark.createDataFrame([("Taipei", "T")], "word string, translation string")
    names = spark.createDataFrame([("Taipei, TW",), ("Tainan",), ("Nowhere, XX",), (None,)], "name string")
    got = {r["name"]: r["shown"] for r in geocode.translate(names, places.place_words(spark, own)).collect()}
    assert got == {"Taipei, TW": "T", "Tainan": "台南", "Nowhere, XX": "Nowhere, XX", None: None}


def test_dates_out_of_range_are_none(spark):
    assert values(spark, times.compact_date(F.col("x")), ["20239999.jpg", "18991231.jpg", "20240229.jpg"]) == [None, None, "2024-02-29"]


def test_stray_percent_signs_stay(spark):
    assert values(spark, paths.url_path(F.col("x")), ["/a/100%zz.jpg", "50%", "%e6%b5%b7%2", "%41%"]) == ["/a/100%zz.jpg", "/50%", "/海%2", "/A%"]


def test_answers_by_their_json_type(spark):
    said = lambda content: '{"choices":[{"message":{"content":%s}}]}' % content
    given = ['"[photo] a cat"', '[{"type":"text","text":"a"},7,{"type":"image"},{"type":"text"},{"type":"text","text":"[b"}]', "null", "5", '{"text":"x"}', '""']
    assert values(spark, text.response_text(F.col("x")), [*map(said, given), "no json", '{"choices":[]}']) == ["[photo] a cat", "a[b", "", "", "", "", "", ""]
