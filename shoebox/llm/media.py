"""Media columns: archives of images, read by a custom Spark data source.

``write_images`` stores payloads losslessly as 8-bit grey PNG images in tar archives, each with a
sidecar of member offsets, and a manifest of the archives that belong to the folder.  The
``media_archive`` source plans byte ranges over them; a member belongs to the range that holds its
first byte.  Members are read by offset and verified, each with its own retries, and come out as
Arrow batches; one that cannot be read is a row with ``error`` set and does not disturb its
neighbours.  Without a sound sidecar the headers are walked; where one is damaged the walk goes on
at the next valid one and the bytes between are a row with ``error`` set.
"""

from __future__ import annotations

import struct
import tarfile
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .batches import bound_batches, slices, text_column
from .storage import open_fs, publish

WIDTH = 192
#: Archive bytes after which a task starts another file, and bytes of one planned range.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS, WAIT_S = 3, 0.2
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


class BadMember(ValueError):
    """A stored member does not verify."""


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, note: str = "", width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG, ``width`` samples a row; ``note`` goes into a text chunk."""
    height = len(samples) // width
    if height < 1 or height * width != len(samples):
        raise ValueError(f"{len(samples)} samples do not fill rows of {width}")
    rows = np.zeros((height, width + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(height, width)
    body = zlib.compress(rows.tobytes(), 1)
    parts = [_SIGNATURE, _png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    if note:
        parts.append(_png_chunk(b"tEXt", b"Comment\x00" + note.encode("latin-1")))
    parts += [_png_chunk(b"IDAT", body[i:i + (1 << 30)]) for i in range(0, len(body), 1 << 30)]
    return b"".join([*parts, _png_chunk(b"IEND", b"")])


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of an image's chunks up to its end; raises BadMember where a checksum is wrong."""
    if data[:8] != _SIGNATURE:
        raise BadMember("no image signature")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise BadMember("image ends early")
        (size,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4:at + 8], data[at + 8:at + 8 + size]
        if len(part) != size or data[at + 8 + size:at + 12 + size] != struct.pack(">I", zlib.crc32(part, zlib.crc32(kind))):
            raise BadMember("image chunk fails its checksum")
        at += 12 + size
        yield kind, part


def decode_png(data: bytes) -> tuple[np.ndarray, str]:
    """(samples as rows x width, note) of an image of ``encode_png``'s kind; checks every chunk."""
    width, height, note, body = 0, 0, "", []
    for kind, part in png_chunks(data):
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", part)
            if form != [8, 0, 0, 0, 0]:
                raise BadMember("not an 8-bit grey image")
        elif kind == b"tEXt":
            note = part.partition(b"\x00")[2].decode("latin-1")
        elif kind == b"IDAT":
            body.append(part)
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if rows.size != height * (width + 1):
        raise BadMember("image has the wrong number of samples")
    rows = rows.reshape(height, width + 1)
    if rows[:, 0].any():
        raise BadMember("image rows are filtered")
    return rows[:, 1:], note


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation and an 8x8 average hash of an image; equal images, equal strings."""
    height, width = samples.shape
    edges_y = np.linspace(0, height, 9).astype(int)[:-1]
    columns = np.add.reduceat(samples, np.linspace(0, width, 9).astype(int)[:-1], axis=1, dtype=np.int64)
    cells = np.add.reduceat(columns, edges_y, axis=0)  # a short image repeats rows here
    bits = (cells * cells.size > cells.sum()).ravel()
    ahash = int("".join("1" if b else "0" for b in bits), 2)
    total = int(samples.sum(dtype=np.int64))
    square = int(np.bincount(samples.ravel(), minlength=256) @ (np.arange(256, dtype=np.int64) ** 2))
    mean = total / samples.size
    deviation = max(0.0, square / samples.size - mean * mean) ** 0.5
    return f"{width}x{height} mean={mean:.4f} dev={deviation:.4f} ahash={ahash:016x}"


def write_images(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as one image below ``folder``; returns ``(archive, members, bytes)``.

    A payload is the UTF-8 text (null: empty) padded with blanks to a positive multiple of
    ``WIDTH`` bytes; the unpadded length is the image's note, the id, of any length, the member's name.
    Archives of an attempt that failed are in the folder, but not in the manifest, so are not read.
    """
    bound_batches(docs.sparkSession)

    def write(batches):
        # names are an attempt's own, and the manifest holds those of the attempt that was committed
        context, n, parts, offsets, size = TaskContext.get(), 0, [], [], 0
        label = f"{context.partitionId():06d}-{context.taskAttemptId()}"

        def flush():
            nonlocal n, parts, offsets, size
            path = f"{folder}/images-{label}-{n:04d}.tar"
            publish(path + ".offsets", lambda out: out.write(sidecar(offsets)))
            publish(path, lambda out: ([out.write(p) for p in parts], out.write(bytes(1024))))
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(offsets)], pa.int64()), pa.array([size], pa.int64())], names=["archive", "members", "bytes"])
            n, parts, offsets, size = n + 1, [], [], 0
            return row

        for whole in batches:
            for batch in slices(whole, "text"):
                for key, text in zip(batch.column("id").to_pylist(), text_column(batch, "text").to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    padded = raw + b" " * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))
                    image = encode_png(padded, str(len(raw)))
                    info = tarfile.TarInfo(member_name(key))
                    info.size = len(image)
                    offsets.append(size)
                    parts += [info.tobuf(tarfile.GNU_FORMAT), image, bytes(-len(image) % 512)]
                    size += sum(map(len, parts[-3:]))
                    if size >= ARCHIVE_BYTES:
                        yield flush()
        if offsets:
            yield flush()

    source = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    source.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


MANIFEST = "archive string, members long, bytes long"


def member_name(key: str | None) -> str:
    """The name of a member: any id in ASCII; a null id has a name of its own."""
    return "none.png" if key is None else f"id-{quote(key, safe='', errors='surrogatepass')}.png"


def member_id(name: str) -> str | None:
    if name == "none.png":
        return None
    if not (name.startswith("id-") and name.endswith(".png")):
        raise BadMember(f"{name} is no member name")
    return unquote(name[3:-4], errors="surrogatepass")


def sidecar(offsets: list[int]) -> bytes:
    """Offsets, their number and a checksum, as 64-bit words."""
    body = np.asarray([*offsets, len(offsets)], dtype="<u8").tobytes()
    return body + struct.pack("<Q", zlib.crc32(body))


def parse_sidecar(data: bytes) -> np.ndarray | None:
    """The offsets, or None if bytes are missing or wrong."""
    if len(data) < 16 or len(data) % 8:
        return None
    body, words = data[:-8], np.frombuffer(data, dtype="<u8").astype(np.int64)
    return words[:-2] if words[-1] == zlib.crc32(body) and words[-2] == len(words) - 2 else None


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


SCHEMA = "archive string, offset long, name string, media binary, error string"


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def archives(self) -> list[tuple[str, int]]:
        """(URI, bytes) of the manifest's archives; without a manifest, of all there are."""
        from pyarrow import dataset, fs

        filesystem, path = open_fs(self.folder)
        prefix = self.folder.removesuffix("/")
        if filesystem.get_file_info(f"{path}/manifest").type == fs.FileType.Directory:
            rows = dataset.dataset(f"{path}/manifest", filesystem=filesystem, format="parquet").to_table(["archive", "bytes"]).to_pylist()
            return sorted((r["archive"], r["bytes"]) for r in rows)
        found = filesystem.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted((prefix + f.path[len(path.rstrip("/")):], f.size) for f in found if f.is_file and f.path.endswith(".tar"))

    def partitions(self) -> list[ByteRange]:
        ranges = [ByteRange(uri, at, min(at + self.range_bytes, size)) for uri, size in retried(self.archives) for at in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in read_range(part.archive, part.start, part.end):
            held.append(row)
            size += len(row[3] or b"")
            if size >= BATCH_BYTES:
                yield as_batch(held)
                held, size = [], 0
        if held:
            yield as_batch(held)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    archive, offset, name, media, error = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(archive, pa.string()), pa.array(offset, pa.int64()), pa.array(name, pa.string()), pa.array(media, pa.binary()), pa.array(error, pa.string()),
    ], names=["archive", "offset", "name", "media", "error"])


def retried(call, *args):
    """``call(*args)``, tried ATTEMPTS times with growing pauses."""
    for attempt in range(ATTEMPTS):
        try:
            return call(*args)
        except FileNotFoundError:
            raise
        except (OSError, BadMember):
            if attempt + 1 == ATTEMPTS:
                raise
            time.sleep(WAIT_S * 2 ** attempt)


def _header(file, at: int) -> tuple[str, int, int] | None:
    """(name, where the content begins, its bytes) of the member at ``at``; None if there is no valid header."""
    file.seek(at)
    try:
        info = tarfile.TarInfo.frombuf(file.read(512), "utf-8", "replace")
        name = info.name
        if info.type == tarfile.GNUTYPE_LONGNAME:
            name = file.read(info.size).rstrip(b"\0").decode("utf-8", "replace")
            at += 512 + info.size + -info.size % 512
            file.seek(at)
            info = tarfile.TarInfo.frombuf(file.read(512), "utf-8", "replace")
    except tarfile.HeaderError:
        return None
    return name, at + 512, info.size


def _walk(archive: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    filesystem, path = open_fs(archive)
    found, gaps, at = [], [], 0
    with filesystem.open_input_file(path) as file:
        size = file.size()
        while at < size:
            head = _header(file, at)
            if head is not None:
                found.append(at)
                at = head[1] + head[2] + -head[2] % 512
                continue
            begun = at
            while at < size and _header(file, at) is None:
                at += 512
            at = min(at, size)
            file.seek(begun)
            if any(any(file.read(min(1 << 20, at - low))) for low in range(begun, at, 1 << 20)):  # blank blocks end an archive
                gaps.append((begun, at - begun))
    return np.asarray(found, dtype=np.int64), gaps


def member_offsets(archive: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(offsets of all members, gaps as (offset, bytes)): from the sidecar, or by walking the headers."""

    def read():
        filesystem, path = open_fs(archive)
        with filesystem.open_input_file(path + ".offsets") as file:
            return file.read()

    try:
        offsets = parse_sidecar(retried(read))
    except OSError:
        offsets = None
    return (offsets, []) if offsets is not None else retried(_walk, archive)


def read_member(archive: str, offset: int) -> tuple[str, bytes]:
    filesystem, path = open_fs(archive)
    with filesystem.open_input_file(path) as file:
        head = _header(file, offset)
        if head is None:
            raise BadMember("damaged member header")
        name, at, size = head
        file.seek(at)
        data = file.read(size)
    if len(data) != size:
        raise BadMember("archive ends inside the member")
    if data[:8] == _SIGNATURE:
        for _ in png_chunks(data):  # its checksums, so that a bad read is tried again
            pass
    return name, data


def read_range(archive: str, start: int, end: int) -> Iterator[tuple]:
    """Rows of the members, and of the gaps, that begin in [start, end)."""
    if not archive:
        return
    try:
        offsets, gaps = member_offsets(archive)
    except (OSError, BadMember) as error:
        yield archive, start, None, None, f"{type(error).__name__}: {error}"
        return
    for offset, size in gaps:
        if start <= offset < end:
            yield archive, offset, None, None, f"{size} bytes without a valid member header"
    for offset in offsets[(offsets >= start) & (offsets < end)].tolist():
        try:
            name, media = retried(read_member, archive, offset)
            yield archive, offset, name, media, None
        except (OSError, BadMember) as error:
            yield archive, offset, None, None, f"{type(error).__name__}: {error}"


class MediaArchive(DataSource):
    """``spark.read.format('media_archive').load(folder)``; option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(archive, offset, name, media, error)`` of every member below ``folder``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(folder)


FEATURES = "doc_id string, payload binary, n_bytes long, media binary, feature string, error string"


def media_features(media: DataFrame) -> DataFrame:
    """Decode stored images: ``(doc_id string, payload, n_bytes, media, feature, error)``.

    A member that does not verify keeps its row, with ``error`` set and the rest null.
    """

    def decode(batches):
        for whole in batches:
            for batch in slices(whole, "media"):
                rows = []
                for name, data, error in zip(*(batch.column(c).to_pylist() for c in ("name", "media", "error"))):
                    try:
                        if error is not None:
                            raise BadMember(error)
                        samples, note = decode_png(data)
                        rows.append((member_id(name), samples.tobytes(), int(note), data, features(samples), None))
                    except (BadMember, zlib.error, ValueError) as problem:
                        rows.append((None, None, None, data, None, str(problem)))
                columns = list(zip(*rows))
                kinds = [pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "payload", "n_bytes", "media", "feature", "error"])

    return media.select("name", "media", "error").mapInArrow(decode, FEATURES)


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of decoded members; fails on a member with an error."""
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("stored member: "), "error"))).otherwise(F.col("n_bytes"))
    return decoded.select(
        F.col("doc_id").cast("long").alias("doc_id"), sound.cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
