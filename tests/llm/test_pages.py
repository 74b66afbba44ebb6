"""WARC archives, URL rules and media archives."""

import gzip
import hashlib
import io
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shoebox.llm import media, storage, urlfilter, warc

WORDS = ["a", "bb", "ccc"]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def test_records_come_back(spark):
    big = "<p>é" * 100
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (2, None, big), (None, "u", big)]
    manifest = warc.write_warc(pages(spark, rows), storage.scratch(spark, "t"))
    got = warc.read_warc(spark, manifest).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
    assert sorted((r["record_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [(0, "revisit", 1), (1, "response", 0), (2, "revisit", 1), (2, "revisit", 1), (3, "response", 0), (4, "response", 0), (5, "response", 0), (6, "response", 0)]
    for r in got:
        want = dict((k or 0, (h or "").encode()) for k, _, h in rows)[r["record_id"] or 0]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(want), hashlib.sha256(want).hexdigest())
        assert r["payload"] == (None if r["record_type"] == "revisit" else want)


def test_no_pages(spark):
    assert warc.read_warc(spark, warc.write_warc(pages(spark, []), storage.scratch(spark, "t"))).count() == 0


def archive(n, plain=()):
    parts = []
    for i in range(n):
        body = (f"page {i} " * (40 + i)).encode()
        data = warc.record_bytes(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest())
        parts.append(zlib.decompress(data, 31) if i in plain else data)
    return parts


def salvage(data):
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    at = 0
    for x in found:  # every byte is accounted for once
        assert x["offset"] == at or not x["length"]
        at += x["length"]
    assert at == len(data)
    return [warc._number(x["headers"]["warc-record-id"]) for x in found if x["kind"] == "record"], [x for x in found if x["kind"] == "gap"]


def test_whole_archive_has_no_gap():
    assert salvage(b"".join(archive(6, plain=(2, 3)))) == (list(range(6)), [])
    assert salvage(b"") == ([], [])


@pytest.mark.parametrize("plain", [(), (2,), (3,), (2, 3, 4)])
def test_damage_costs_only_its_record(plain):
    parts = archive(6, plain)
    middle = bytearray(parts[3])
    middle[-30 if 3 in plain else len(middle) // 2] ^= 0xFF
    records, gaps = salvage(b"".join([*parts[:3], bytes(middle), *parts[4:]]))
    assert records == [0, 1, 2, 4, 5] and len(gaps) == 1
    assert (gaps[0]["offset"], gaps[0]["length"]) == (sum(map(len, parts[:3])), len(parts[3]))


def test_junk_between_records_and_a_cut_end():
    parts = archive(4)
    records, gaps = salvage(b"junk\x1f\x8b\x08more" + parts[0] + b"WARC/9" * 9 + b"".join(parts[1:3]) + parts[3][:-20])
    assert records == [0, 1, 2] and len(gaps) == 3


def test_random_damage_never_breaks_the_reader():
    rng = random.Random(4)
    for _ in range(30):
        data = bytearray(b"".join(archive(5, plain=(1,))))
        for _ in range(rng.randrange(1, 5)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        salvage(bytes(data))  # accounts for every byte


RULES = urlfilter.parse_rules(["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/", "block a.org", "allow a.org/x", "block a.org/x", "allow b.a.org/"])


def by_scan(host, path):
    fits = [r for r in RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host), len(r.path), r.verdict == "block"), default=None)


def urls():
    rng = random.Random(2)
    hosts = ["example.com", "EXAMPLE.com", "www.example.net", "xexample.net", "a.org", "b.a.org", "c.b.a.org", "org", "com:80", "", ".com", "com."]
    tails = ["", "/", "/en", "/en/", "/en/7", "/en/71?x#y", "/de/8#z", "/es/1", "/x", "/xy", "?/en/", "#a", "/en//7"]
    made = [f"http://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(400)]
    return [*made, None, "", "com/en/7", "x://y://com/en/", "://com/en/", "http://" + "a/" * 5000]


def test_rules_match_a_scan_and_the_join(spark):
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls())], "page_id long, url string, host string, path string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df, RULES).collect()}
    for i, u in enumerate(urls()):
        host, path = urlfilter.split_url(u)
        rule = by_scan(host, path)
        assert got[i] == (host, path, rule.text if rule else None, rule.verdict if rule else "allow"), u
    assert got == {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df, RULES, broadcast_bytes=0).collect()}
    assert urlfilter.filter_urls(df.limit(0), RULES).count() == 0


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        urlfilter.parse_rules(["maybe com/"])


def test_media_round_trip(spark, odd_docs):
    folder = storage.scratch(spark, "m")
    media.write_images(odd_docs, folder)
    got = media.digests(media.media_features(media.read_media(spark, folder, 2048))).collect()
    want = sorted((d["doc_id"] or 0, (d["text"] or "").encode()) for d in odd_docs.collect())
    assert len(got) == len(want)
    for r, (key, raw) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0)), want):
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"]) == (key, len(raw), len(padded))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got}) == len({raw for _, raw in want})


def test_no_media(spark, no_docs):
    folder = storage.scratch(spark, "m")
    media.write_images(no_docs, folder)
    assert media.media_features(media.read_media(spark, folder)).count() == 0


def test_a_broken_member_stands_alone(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(20)], "doc_id long, text string").coalesce(1)
    folder = storage.scratch(spark, "m")
    archive_path = media.write_images(df, folder).first()["archive"]
    _, local = storage.open_fs(archive_path)
    offsets, _ = media.member_offsets(archive_path)
    with open(local, "r+b") as file:
        file.seek(int(offsets[7]) + 600)
        file.write(b"\0\0\0\0")
        file.seek(int(offsets[11]) + 148)
        file.write(b"!!!!!!!!")
    rows = media.media_features(media.read_media(spark, folder, 1000)).collect()
    assert len(rows) == 20 and sum(r["error"] is not None for r in rows) == 2
    assert {r["doc_id"] for r in rows if r["error"] is None} == {str(i) for i in range(20)} - {"7", "11"}
    with pytest.raises(Exception, match="stored member"):
        media.digests(media.media_features(media.read_media(spark, folder))).collect()


def test_offsets_without_a_sidecar(spark):
    import os

    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "doc_id long, text string").coalesce(1)
    path = media.write_images(df, storage.scratch(spark, "m")).select(F.first("archive")).first()[0]
    with_sidecar = media.member_offsets(path)[0].tolist()
    os.remove(storage.open_fs(path)[1] + ".offsets")
    assert media.member_offsets(path)[0].tolist() == with_sidecar


@pytest.mark.parametrize("cut", [None, 0, 48, 41])
def test_nothing_is_lost_behind_a_damaged_header_or_sidecar(spark, monkeypatch, cut):
    """No sidecar, or a shortened one, and a damaged header: nine members and a gap."""
    import os

    monkeypatch.setattr(media, "WAIT_S", 0)
    df = spark.createDataFrame([(i, f"text {i} " * 60) for i in range(10)], "doc_id long, text string").coalesce(1)
    folder = storage.scratch(spark, "m")
    path = media.write_images(df, folder).first()["archive"]
    local = storage.open_fs(path)[1]
    offsets, _ = media.member_offsets(path)
    if cut is None:
        os.remove(local + ".offsets")
    else:
        with open(local + ".offsets", "r+b") as file:
            file.truncate(cut)
    with open(local, "r+b") as file:
        file.seek(int(offsets[4]) + 148)
        file.write(b"!!!!!!!!")
    rows = media.media_features(media.read_media(spark, folder, 1500)).collect()
    assert {r["doc_id"] for r in rows if r["error"] is None} == {str(i) for i in range(10) if i != 4}
    assert [r["error"] for r in rows if r["error"]] == [f"{int(offsets[5] - offsets[4])} bytes without a valid member header"]


def test_ids_of_any_length_and_leftovers_of_failed_attempts(spark):
    ids = ["x" * 300, "null", None, "none", "a/b.png", "é日"]
    df = spark.createDataFrame([(i, "same text") for i in ids], "doc_id string, text string")
    folder = storage.scratch(spark, "m")
    path = storage.open_fs(media.write_images(df, folder).where("members > 0").first()["archive"])[1]
    with open(path, "rb") as old, open(path.replace("images-", "images-9"), "wb") as new:
        new.write(old.read())
    rows = media.media_features(media.read_media(spark, folder)).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids)) and {r["error"] for r in rows} == {None}
    assert len({(r["media"], r["feature"]) for r in rows}) == 1


def foreign(kind, body, extra=(), length=None):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:0a>", *extra, b"Content-Length: " + (str(len(body)).encode() if length is None else length)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_odd_headers_are_gaps_and_foreign_digests_are_checked():
    import base64
    import gzip

    sha1 = b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"body").digest())
    good = foreign(b"resource", b"body", [sha1])
    bad = [
        foreign(b"resource", b"body", length="\u00b2".encode("latin-1")), foreign(b"resource", b"body", length=b"9" * 30), foreign(b"resource", b"bodY", [sha1]),
        foreign(b"revisit", b"", [b"X-Payload-Length: many"]),
    ]
    for one in bad:
        data = gzip.compress(good) + gzip.compress(one) + gzip.compress(good)
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        assert [x["kind"] for x in found] == ["record", "gap", "record"] and sum(x["length"] for x in found) == len(data)


def test_a_member_of_several_records_gives_them_all():
    import gzip

    good = foreign(b"resource", b"body")
    data = gzip.compress(good + good + b"WARC/1.0\r\nbroken\r\n\r\n" + good + b"rest")
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [x["kind"] for x in found] == ["record", "record", "gap", "record", "gap"] and sum(x["length"] for x in found) == len(data)


def test_foreign_names_and_revisits_without_a_response(spark):
    import gzip

    folder = storage.scratch(spark, "w")
    storage.publish(f"{folder}/a.warc.gz", lambda out: out.write(gzip.compress(foreign(b"resource", b"x")) + gzip.compress(foreign(b"revisit", b"", [b"WARC-Refers-To: <urn:uuid:0b>"]))))
    got = warc.read_warc(spark, spark.createDataFrame([(f"{folder}/a.warc.gz",)], "path string"))
    rows = got.orderBy("offset").collect()
    assert [(r["record_id"], r["record_uri"], r["refers_to_uri"]) for r in rows] == [(None, "urn:uuid:0a", None), (None, "urn:uuid:0a", "urn:uuid:0b")]
    assert warc.orphan_revisits(got).count() == 1
    pages_ = spark.createDataFrame([(i, "http://a/", "same text " * 20) for i in range(4)], "page_id long, url string, html string")
    assert warc.orphan_revisits(warc.read_warc(spark, warc.write_warc(pages_, storage.scratch(spark, "w")))).count() == 0


def joined(n, digests=True, size=400):
    """``n`` records in one gzip stream."""
    rng = random.Random(n)
    plain = []
    for i in range(n):
        text = "".join(rng.choice("abcdefgh \n") for _ in range(size)).encode()
        record = zlib.decompress(warc.record_bytes(i, "http://a/", text, hashlib.sha256(text).hexdigest(), None), 31)
        plain.append(record if digests else re.sub(rb"(?im)^warc-(payload|block)-digest:.*\r\n", b"", record))
    return gzip.compress(b"".join(plain))


@pytest.mark.parametrize("whole", [warc.WHOLE_BYTES, 1000])
def test_member_of_many_records(monkeypatch, whole):
    """Intact, cut and flipped at nine tenths: what comes before the damage is kept, and every byte is accounted for."""
    monkeypatch.setattr(warc, "WHOLE_BYTES", whole)
    for digests in (True, False):
        data, after = joined(200, digests), joined(1)
        assert salvage(data + after) == ([*range(200), 0], [])
        at = len(data) * 9 // 10
        records, gaps = salvage(data[:at] + after)
        assert records[-1] == 0 and records[:-1] == list(range(len(records) - 1)) and len(records) > 175
        assert len(gaps) == 1 and gaps[0]["length"] == at
        records, gaps = salvage(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1:] + after)
        assert records[-1] == 0 and records[:176] == list(range(176)) and sum(g["length"] for g in gaps) == len(data)


def test_record_without_end_in_a_long_member(monkeypatch):
    """A content length beyond the member is a gap, and the records behind it are found."""
    monkeypatch.setattr(warc, "WHOLE_BYTES", 1000)
    plain = zlib.decompress(joined(20), 31)
    third = [m.start() for m in re.finditer(rb"WARC/1\.[01]\r\n", plain)][2]
    broken = plain[:third] + re.sub(rb"(?i)content-length: *\d+", b"Content-Length: 99999999999", plain[third:], count=1)
    records, gaps = salvage(gzip.compress(broken))
    assert records == [0, 1, *range(3, 20)] and len(gaps) == 1 and gaps[0]["length"] == 0
