"""Thumbnails are converted once, again after a change, and never wider or narrower than allowed."""

import datetime

from shoebox.sources import thumbnails


def test_refresh(spark, tmp_path):
    folder, cache = tmp_path / "images", str(tmp_path / "cache")
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.jpg").write_bytes(b"image %d" % i)
    (folder / "bad.jpg").write_bytes(b"broken")

    def convert(content, width):
        if content == b"broken":
            raise ValueError("no image")
        return b"%d:%s" % (width, content)

    def images(touched=()):
        day = datetime.datetime(2024, 1, 1)
        rows = [(str(p), day + datetime.timedelta(days=p.name in touched)) for p in sorted(folder.iterdir())]
        return spark.createDataFrame([*rows, (str(folder / "gone.jpg"), day)], "path string, modified timestamp")

    run = lambda width, **more: thumbnails.refresh(images(**more), cache, width, convert)
    assert run(320) == 6 and run(320) == 0
    assert run(10) == 6 and run(64) == 0 and run(5000) == 6 and run(1024) == 0  # clamped widths share their thumbnails
    (folder / "3.jpg").write_bytes(b"changed")
    assert run(320, touched=("3.jpg",)) == 1 and run(320, touched=("3.jpg",)) == 0 and run(320) == 0
    found = {(r["path"].rsplit("/", 1)[1], r["width"]): bytes(r["content"]) for r in thumbnails.thumbnails(spark, cache).collect()}
    assert len(found) == 18 and found["3.jpg", 320] == b"320:changed" and found["3.jpg", 64] == b"64:image 3" and found["0.jpg", 1024] == b"1024:image 0"
    assert thumbnails.compact(spark, cache, str(tmp_path / "compact")).count() == 18


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "path string, modified timestamp")
    assert thumbnails.refresh(none, str(tmp_path / "c"), 100, lambda c, w: c) == 0 and thumbnails.thumbnails(spark, str(tmp_path / "absent")).count() == 0
