"""Image files: recursive scan, metadata, and stages that wrap models as plain callables."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths

EXIF_SCHEMA = (
    "path string, DateTimeOriginal string, DateTimeDigitized string, DateTime string, Make string, Model string, LensModel string, "
    "ISOSpeedRatings double, FocalLength double, ExposureTime double, FNumber double, ImageWidth double, ImageLength double, "
    "PixelXDimension double, PixelYDimension double, Orientation double, GPSInfo map<string,string>"
)

#: Numbers of the tags that are kept, and of the two nested directories.
TAGS = {
    0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "DateTime", 0x0100: "ImageWidth", 0x0101: "ImageLength",
    0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x8827: "ISOSpeedRatings", 0x920A: "FocalLength", 0x829A: "ExposureTime",
    0x829D: "FNumber", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA434: "LensModel",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude"}
EXIF_DIRECTORY, GPS_DIRECTORY = 0x8769, 0x8825
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of image files below ``root``.

    Hidden files and hidden, cache and trash folders are left out; ``content`` is read only if used.
    Unreadable files and folders are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    prefix = len(root.rstrip("/").removeprefix("file:").replace("//", "/"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    below = F.substring(plain, prefix + 1, 1 << 20)  # folders above the root do not count
    return files.withColumn("path", plain).where(paths.is_image(F.col("path")) & ~paths.is_hidden_file(F.col("path")) & ~paths.in_skipped_folder(below))


def _values(data: bytes, order: str, kind: int, count: int, at: int):
    size = _SIZES.get(kind, 0) * count
    if not size:
        return None
    if size > 4:
        (at,) = struct.unpack_from(order + "I", data, at)
    raw = data[at:at + size]
    if kind in (2, 7):
        return raw.decode("utf-8", "replace").strip("\x00")
    if kind in (5, 10):
        flat = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
        found = [a / b if b else float(a) for a, b in zip(flat[::2], flat[1::2])]
    else:
        found = [float(v) for v in struct.unpack(order + {1: "B", 3: "H", 4: "I", 9: "i"}[kind] * count, raw)]
    return found[0] if count == 1 else found


def _directory(data: bytes, order: str, at: int) -> dict[int, object]:
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        found[tag] = _values(data, order, kind, count, at + 10 + 12 * i)
    return found


def parse_exif(content: bytes) -> dict:
    """Kept tags of a JPEG or bare TIFF block by name; empty where there are none or they are broken."""
    try:
        start = content.find(b"Exif\x00\x00")
        data = content[start + 6:] if start >= 0 else content
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None:
            return {}
        top = _directory(data, order, struct.unpack_from(order + "I", data, 4)[0])
        nested = _directory(data, order, int(top[EXIF_DIRECTORY])) if EXIF_DIRECTORY in top else {}
        found = {TAGS[t]: v for t, v in {**top, **nested}.items() if t in TAGS and v is not None}
        if GPS_DIRECTORY in top:
            gps = _directory(data, order, int(top[GPS_DIRECTORY]))
            found["GPSInfo"] = {GPS_TAGS[t]: str(v) for t, v in gps.items() if t in GPS_TAGS and v is not None}
        return found
    except (struct.error, IndexError, KeyError, TypeError, ValueError):
        return {}


def exif(images: DataFrame, parse: Callable[[bytes], dict] = parse_exif) -> DataFrame:
    """EXIF columns of ``images(path, content)`` by name; GPS values as text, lists as JSON."""
    names = [c.strip().split(" ")[0] for c in EXIF_SCHEMA.split(", ")]
    texts = {"path", "DateTimeOriginal", "DateTimeDigitized", "DateTime", "Make", "Model", "LensModel"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p} | parse(c) for p, c in zip(frame["path"], frame["content"])]
            out = pd.DataFrame(rows, columns=names)
            for c in names:
                if c not in texts and c != "GPSInfo":
                    out[c] = pd.to_numeric(out[c], errors="coerce")
            yield out.astype({c: object for c in names if c in texts or c == "GPSInfo"}).where(lambda f: f.notna(), None)

    return images.select("path", "content").mapInPandas(run, EXIF_SCHEMA)


def embed(images: DataFrame, encoder: Callable[[list[bytes]], list[list[float]]], dim: int, batch: int = 64) -> DataFrame:
    """``(path, vector, dim)`` with unit vectors from ``encoder``, called on batches of contents."""
    import numpy as np

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), batch):
                part = frame.iloc[low:low + batch]
                x = np.asarray(encoder(list(part["content"])), dtype=np.float32).reshape(len(part), dim)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"path": part["path"], "vector": list(x / np.where(size > 0, size, 1)), "dim": dim})

    return images.select("path", "content").mapInPandas(run, "path string, vector array<float>, dim int")


def detect(images: DataFrame, detector: Callable[[bytes], list[dict]]) -> DataFrame:
    """One row per detection, or one marker row: outcome ``found``, ``none`` or ``error``.

    ``detector(content)`` returns dicts with ``bbox``, ``score`` and ``vector``.
    """
    columns = ["path", "outcome", "seq", "bbox", "score", "vector", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    found = detector(content)
                except Exception as error:  # recorded per image
                    rows.append((path, "error", 0, None, None, None, f"{type(error).__name__}: {error}"))
                    continue
                rows += [(path, "found", i, d["bbox"], d["score"], d["vector"], None) for i, d in enumerate(found)] or [(path, "none", 0, None, None, None, None)]
            yield pd.DataFrame(rows, columns=columns)

    return images.select("path", "content").mapInPandas(run, "path string, outcome string, seq int, bbox array<double>, score double, vector array<float>, error string")


def transform_pixels(images: DataFrame, convert: Callable[[bytes], bytes]) -> DataFrame:
    """``(path, content)`` after ``convert`` (re-encoding, thumbnails); null where it fails."""

    def safe(content: bytes) -> bytes | None:
        try:
            return convert(content)
        except Exception:  # an unreadable image has no output
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=[safe(c) for c in frame["content"]])

    return images.select("path", "content").mapInPandas(run, "path string, content binary")


def thumbnail_key(path, width):
    """Cache name of a thumbnail: hash of the path and the width, clamped to 64..1024."""
    return F.concat(F.md5(path), F.lit("_"), F.greatest(F.lit(64), F.least(F.lit(1024), width)).cast("string"), F.lit(".jpg"))
