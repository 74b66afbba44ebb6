"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Every record is its own gzip member; the reader takes members of several records as well.  It
checks each record (gzip trailer, version line, block length, SHA-256 and SHA-1 digests of block and
payload; other digests are not checked).  Where a check fails it looks for the next valid gzip
member or version line, goes on from there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import slices
from .storage import materialize, open_fs, publish

#: Shorter payloads are written out again instead of being revisited.
REVISIT_BYTES = 100
#: Compressed bytes after which a task starts another file.
FILE_BYTES = 32 << 20
READ_BYTES = 256 << 10
#: Unpacked members of up to so many bytes are parsed at once, longer ones record by record.
WHOLE_BYTES = 8 << 20
#: Bytes of an uncompressed record that are searched for the end of its header.
HEADER_BYTES = 64 << 20
#: Records of one Arrow batch, in payload bytes.
BATCH_BYTES = 8 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_URN = "urn:shoebox:record:"


class Damaged(ValueError):
    """A record failed a check."""


def _clean(value: str) -> str:
    """Header values hold no line breaks or other control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One gzip member; a revisit, without payload, if ``refers_to`` is given."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit")]
    head.append(("WARC-Record-ID", f"<{_URN}{'' if record_id is None else record_id}>"))
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", f"<{_URN}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{_URN}(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _name(urn: str | None) -> str | None:
    return urn.removeprefix("<").removesuffix(">") if urn else None


def _whole_number(text: str) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", text):
        raise Damaged(f"{text[:20]!r} is no length")
    return int(text)


def _check_digest(claimed: str, data: bytes, what: str) -> None:
    """``algorithm:value`` with the value in hexadecimal or Base32; unknown algorithms pass."""
    algorithm, _, value = claimed.strip().partition(":")
    if algorithm.lower() not in ("sha1", "sha256"):
        return
    digest = hashlib.new(algorithm.lower(), data)
    if value.lower() != digest.hexdigest() and value.upper().rstrip("=") != base64.b32encode(digest.digest()).decode().rstrip("="):
        raise Damaged(f"{what} digest differs")


def _parse(data: bytes, at: int = 0) -> tuple[dict, bytes, bytes, int]:
    """(headers by lower-case name, block, payload, end) of the record at ``at``; raises Damaged."""
    version = _VERSION.match(data, at)
    end = data.find(b"\r\n\r\n", at)
    if not version or end < 0:
        raise Damaged("no version line or header end")
    headers = {}
    for line in data[version.end():end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("broken header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = _whole_number(headers.get("content-length", ""))
    block = data[end + 4:end + 4 + length]
    if len(block) != length or data[end + 4 + length:end + 8 + length] != b"\r\n\r\n":
        raise Damaged("block shorter or longer than its content length")
    _check_digest(headers.get("warc-block-digest", ""), block, "block")
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    if headers.get("warc-type") == "revisit":
        _whole_number(headers.get("x-payload-length", "0"))  # the payload is elsewhere
    else:
        _check_digest(headers.get("warc-payload-digest", ""), payload, "payload")
    return headers, block, payload, end + 8 + length


def _records(data: bytes) -> Iterator[tuple]:
    """Records of a member's content, and the reasons for bytes of it that are none."""
    at = 0
    while at < len(data):
        try:
            headers, _, payload, end = _parse(data, at)
            yield headers, payload
        except Damaged as error:
            if at == 0:
                raise
            found = _VERSION.search(data, at + 1)
            end = found.start() if found else len(data)
            yield None, f"{end - at} unpacked bytes of a member: {error}"
        at = end


class _File:
    """Random access with a known size."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size

    def at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(max(0, min(n, self.size - offset)))


def _unpacked(file: _File, offset: int) -> Generator[bytes, None, int]:
    """Content of the gzip member at ``offset`` in bounded pieces; returns its end.

    A damaged member gives all content before the damage, then raises.
    """
    unpack, at, raw = zlib.decompressobj(31), offset, b""
    while not unpack.eof:
        if not raw:
            raw = file.at(at, READ_BYTES)
            at += len(raw)
            if not raw:
                raise Damaged("gzip member ends early")
        before = unpack.copy()
        try:
            data = unpack.decompress(raw, READ_BYTES)
        except zlib.error as error:
            # the failing call keeps back what it had unpacked: once more, byte by byte
            with contextlib.suppress(zlib.error):
                for i in range(len(raw)):
                    if data := before.decompress(raw[i:i + 1]):
                        yield data
            raise Damaged(f"gzip: {error}") from None
        raw = unpack.unconsumed_tail
        if data:
            yield data
    return at - len(unpack.unused_data)


def _measured(file: _File, offset: int) -> tuple[bytes | None, int, int, Damaged | None]:
    """(content if it is small, its size, end, damage) of the gzip member at ``offset``."""
    kept, size, pieces = [], 0, _unpacked(file, offset)
    while True:
        try:
            piece = next(pieces)
        except StopIteration as end:
            return b"".join(kept) if size <= WHOLE_BYTES else None, size, end.value, None
        except Damaged as error:
            return None, size, offset, error
        size += len(piece)
        if size <= WHOLE_BYTES:
            kept.append(piece)
        else:
            kept.clear()


def _streamed(file: _File, offset: int, size: int, sound: bool) -> Iterator[tuple]:
    """As :func:`_records`, of a member of ``size`` unpacked bytes, holding one record at a time.

    Of a damaged member (not ``sound``) a record counts if its digests, where it has any, are right and
    another record's version line follows it; what is no such record is left out.
    """
    pieces, data, left = _unpacked(file, offset), bytearray(), size

    def hold(n: int) -> bool:
        nonlocal left
        while len(data) < n and left > 0:
            try:
                piece = next(pieces)
            except (StopIteration, Damaged):
                left = 0
                break
            data.extend(piece)
            left -= len(piece)
        return len(data) >= n

    while hold(1):
        reason = None
        while (end := data.find(b"\r\n\r\n")) < 0 and hold(len(data) + 1):
            pass
        length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})\s*$", data[:end + 4]) if end >= 0 else None
        total = end + 8 + int(length[1]) if length else 0
        try:
            if not length or total > len(data) + max(left, 0) or not hold(total):
                raise Damaged("no header end, or a block shorter than its content length")
            headers, _, payload, end = _parse(bytes(data[:total]))
            if not sound and not (hold(total + 8) and data.startswith(b"WARC/1.", total)):
                raise Damaged("no record follows before the damage")
            yield headers, payload
        except Damaged as error:
            reason, skipped = error, 0
            while not (found := _VERSION.search(data, 1)) and hold(len(data) + 1):
                skipped += max(0, len(data) - 16)
                del data[:-16]
            end = found.start() if found else len(data)
            if sound:
                yield None, f"{skipped + end} unpacked bytes of a member: {reason}"
        del data[:end]


def _plain(file: _File, offset: int) -> tuple[bytes, int]:
    """(content, end) of the uncompressed record at ``offset``."""
    data = b""
    while b"\r\n\r\n" not in data:
        more = file.at(offset + len(data), READ_BYTES)
        if not more or len(data) > HEADER_BYTES:
            raise Damaged("no header end")
        data += more
    end = data.index(b"\r\n\r\n") + 4
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)\s*$", data[:end])
    if not length:
        raise Damaged("no content length")
    total = end + int(length[1]) + 4
    if offset + total > file.size:
        raise Damaged("record ends early")
    return (data + file.at(offset + len(data), total - len(data)))[:total], offset + total


def _next_start(file: _File, offset: int) -> int:
    """The next offset where a member opens on a version line or a version line stands."""
    while offset < file.size:
        data = file.at(offset, READ_BYTES)
        for found in _START.finditer(data):
            at = offset + found.start()
            if found[0][:1] == b"W":
                return at
            try:
                if _VERSION.match(next(_unpacked(file, at), b"")):
                    return at
            except Damaged:
                pass
        offset += max(1, len(data) - 16) if offset + len(data) < file.size else len(data)
    return file.size


def salvage(stream, size: int) -> Iterator[dict]:
    """Records and gaps of one archive in file order.

    A record has ``kind='record'``, offset, length, headers, payload; a gap has ``kind='gap'``,
    offset, length and the reason of the failed check.  Every byte is in exactly one of them.  Of a
    member with several records the first has the member's bytes; the others, and damaged parts of
    its content, have length 0.  Of a member that is itself damaged, the records before the damage
    have length 0 and a gap holds its bytes.  One record is held at a time, and a small member whole.
    """
    file, offset = _File(stream, size), 0
    while offset < size:
        try:
            start = file.at(offset, 3)
            broken, data = None, None
            if start == b"\x1f\x8b\x08":
                data, unpacked, end, broken = _measured(file, offset)
            elif start == b"WAR":
                data, end = _plain(file, offset)
            else:
                raise Damaged("neither a gzip member nor a version line")
            if data == b"":
                raise Damaged("empty member")
            length = 0 if broken else end - offset
            for headers, payload in _records(data) if data is not None else _streamed(file, offset, unpacked, not broken):
                if headers is None:
                    yield {"kind": "gap", "offset": offset, "length": 0, "reason": payload}
                    continue
                digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") if headers.get("warc-type") == "revisit" else hashlib.sha256(payload).hexdigest()
                yield {"kind": "record", "offset": offset, "length": length, "headers": headers, "payload": payload, "digest": digest}
                length = 0
            if broken:
                raise broken
            if length:
                raise Damaged("a member without any record")
        except Damaged as error:
            end = _next_start(file, offset + 1)
            yield {"kind": "gap", "offset": offset, "length": end - offset, "reason": str(error)}
        offset = end


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row below ``folder``; returns the manifest ``(path, records, bytes)``.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes, those with the smallest id are
    responses and the others revisit it.  A null payload is empty, a null url is left out, a row
    with a null id is a response unless an equal payload has an id.  Repeated rows are all written.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    source = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("payload"))
    source = source.select("id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    # only digests that recur; small against the pages, and broadcast only if its files are small
    first = materialize(
        source.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"),
        "firsts",
    )

    def write(batches):
        # names are an attempt's own; the manifest holds those of the attempt that was committed
        label, n = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0
        parts, size = [], 0

        def flush():
            nonlocal n, parts, size
            path = f"{folder}/pages-{label}-{n:04d}.warc.gz"
            publish(path, lambda out: [out.write(p) for p in parts])
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(parts)], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])
            n, parts, size = n + 1, [], 0
            return row

        for whole in batches:
            for batch in slices(whole, "payload"):
                for key, url, text, digest, target in zip(*(c.to_pylist() for c in batch.columns)):
                    member = record_bytes(key, url, text.encode("utf-8", "surrogatepass"), digest, target if target != key else None)
                    parts.append(member)
                    size += len(member)
                    if size >= FILE_BYTES:
                        yield flush()
        if parts:
            yield flush()

    rows = source.join(first, "digest", "left").select("id", "url", "payload", "digest", "first")
    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


ROW = "path string, kind string, offset long, length long, record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, reason string, record_uri string, refers_to_uri string"


def read_warc(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives in ``archives(path)``.

    Columns: see ``ROW``.  ``kind`` is 'record' or 'gap'; a gap has only path, offset, length and
    reason.  ``payload`` is null for revisits and without ``with_payload``.  ``record_id`` and
    ``refers_to`` are the numbers of this writer's records, null for others, whose names are in the
    ``_uri`` columns.  A revisit's digest is what it claims; see :func:`orphan_revisits`.  Files are
    read by one task each, in blocks; only one record is held whole.
    """
    names = [part.split()[0] for part in ROW.split(", ")]

    def read(batches):
        held, size = [], 0

        def flush():
            nonlocal held, size
            columns = list(zip(*held))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesystem, local = open_fs(path)
                with filesystem.open_input_file(local) as stream:
                    for x in salvage(stream, stream.size()):
                        if x["kind"] == "gap":
                            held.append((path, "gap", x["offset"], x["length"], None, None, None, None, None, None, None, x["reason"], None, None))
                        else:
                            h = x["headers"]
                            again = h.get("warc-type") == "revisit"
                            n = int(h.get("x-payload-length", "0")) if again else len(x["payload"])
                            held.append((path, "record", x["offset"], x["length"], _number(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), _number(h.get("warc-refers-to")), n, x["digest"], x["payload"] if with_payload and not again else None, None, _name(h.get("warc-record-id")), _name(h.get("warc-refers-to"))))
                            size += len(x["payload"]) if with_payload else 200
                        if size >= BATCH_BYTES:
                            yield flush()
        if held:
            yield flush()

    files = archives.select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, ROW)


def orphan_revisits(records: DataFrame) -> DataFrame:
    """The revisits among ``records`` whose response is not there, or has another digest."""
    revisits = records.where("kind = 'record' and record_type = 'revisit'")
    responses = records.where("kind = 'record' and record_type = 'response'").select(F.col("record_uri").alias("refers_to_uri"), "payload_digest")
    return revisits.join(responses, ["refers_to_uri", "payload_digest"], "left_anti").select(*records.columns)
