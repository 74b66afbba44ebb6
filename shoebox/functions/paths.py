"""Predicates and parts of slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Image suffixes, folders never scanned, and path fragments never shown.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
SKIPPED_FOLDERS = (".thumbnails", ".trash", ".trashes", ".spotlight-v100", ".fseventsd", ".temporaryitems", "__macosx", "@eadir", ".cache")
SKIPPED_FRAGMENTS = ("/.thumbnails/", "/.trash/", "/.trashes/", "/.cache/", "/@eadir/", "/__macosx/", "/.spotlight-v100/", "/.fseventsd/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_image(path: Column) -> Column:
    name = F.lower(file_name(path))
    found = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        found = found | name.endswith(suffix)
    return found


def is_hidden_file(path: Column) -> Column:
    return file_name(path).startswith(".")


def in_skipped_folder(path: Column) -> Column:
    """True if a folder on the path is hidden or a known cache or trash folder."""
    parts = F.split(F.lower(path), "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith(".") | p.isin(*SKIPPED_FOLDERS))


def is_skipped(path: Column) -> Column:
    """True for null or empty paths, skipped fragments, and dot segments other than . and .."""
    flat = F.regexp_replace(F.lower(path), r"\\", "/")
    fragment = F.lit(False)
    for part in SKIPPED_FRAGMENTS:
        fragment = fragment | flat.contains(part)
    dotted = F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))
    return F.coalesce((path == "") | fragment | dotted, F.lit(True))


def blocked(path: Column, prefixes: Column) -> Column:
    """True if any prefix starts the path; plain string prefixes, not folders."""
    return F.exists(F.coalesce(prefixes, F.array().cast("array<string>")), lambda b: F.startswith(path, b))


def top_folder(path: Column, depth: int = 6) -> Column:
    """The first ``depth`` parts with a closing slash; null if nothing lies below them."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.concat(F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/")))


def url_path(text: Column) -> Column:
    """Percent-decoded, with single slashes and a leading one; a plus, and a percent sign that begins no escape, stay."""
    escaped = F.regexp_replace(F.regexp_replace(text, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.url_decode(escaped)
    return F.regexp_replace(F.concat(F.lit("/"), decoded), "/+", "/")
