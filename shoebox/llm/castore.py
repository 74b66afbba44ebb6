"""Content-addressed store for token-id streams.

Layout below one folder::

    packs/pack-<task>-<n>.cas   header, then chunk payloads end to end
    recipes/                    Parquet, one row per document in ascending doc_id order
    index/                      Parquet, digest -> pack, offset, n_ids: one row per stored chunk
    manifest/                   Parquet, one row per pack and one per bucket of recipes: rows, ids, Merkle root
    seal/                       Parquet, one row: numbers of both kinds and of ids, and a hash over all roots

An id stream is cut where a rolling hash over its last ``WINDOW`` ids falls on a mask, so equal
passages give equal chunks wherever they stand.  A chunk's name is the SHA-256 of its payload.
A document's recipe lists its chunk names and their Merkle root.  Reading verifies the seal against
the manifest, the manifest against index and recipes, every document against its root and every
chunk against its name, so a lost or altered row or file of any part raises.

Writing is in two steps.  Tasks write what they have seen, each chunk once per task, in stream
order (neighbours in a text stay neighbours on disk).  Then the copy in the smallest pack becomes
the owner and packs are rewritten with owned chunks only: each is stored once.
"""

from __future__ import annotations

import hashlib
import struct
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import bound_batches, slices, text_column
from .bpe_words import with_end, word_encoder
from .storage import delete_tree, open_fs, publish

WINDOW, LEAST, MOST = 16, 64, 8192
#: One id in 2**CUT_BITS ends a chunk, on average.
CUT_BITS = 9
#: Bytes of payload after which a task starts another pack.
PACK_BYTES = 32 << 20
#: Chunk names that a task remembers to write each only once; older ones may be written again
#: and are then dropped by the second step.
SEEN = 400_000
MAGIC = b"SBCAS\x00\x01"
HEADER = struct.Struct("<7sB")

_MIX = np.uint64(0x9E3779B97F4A7C15)


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW ids that end at each position (fewer at the start)."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    width, factor = 1, _MIX
    while width < WINDOW:
        moved = h[:-width] * factor
        h = h.copy()
        h[width:] += moved
        factor = np.uint64(int(factor) * int(factor) & 0xFFFFFFFFFFFFFFFF)
        width *= 2
    return h


def cut_points(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """For each document the ends of its chunks, relative to its start; the last is its length.

    Depends on a document's own ids only.
    """
    marks = np.flatnonzero((rolling_hash(ids) >> np.uint64(64 - CUT_BITS)) == 0) + 1
    ends = np.cumsum(counts)
    starts = ends - counts
    low, high = np.searchsorted(marks, starts, side="right"), np.searchsorted(marks, ends, side="left")
    out = []
    for start, n, a, b in zip(starts.tolist(), counts.tolist(), low.tolist(), high.tolist()):
        cuts, last = [], 0
        for mark in (marks[a:b] - start).tolist() + [n]:
            while mark - last > MOST:
                last += MOST
                cuts.append(last)
            if mark - last >= LEAST or (mark == n and mark > last):
                cuts.append(mark)
                last = mark
        out.append(cuts)
    return out


def merkle_root(names: list[bytes]) -> bytes:
    """Root of the binary hash tree over chunk names; an odd last node moves up unchanged."""
    level = [hashlib.sha256(b"\x00" + n).digest() for n in names] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2:]
    return level[0]


def _header(width: int) -> bytes:
    return HEADER.pack(MAGIC, width)


def _width(data: bytes, pack: str) -> int:
    magic, width = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError(f"{pack} is not a chunk pack")
    return width


def _dtype(width: int):
    return np.dtype("<u2" if width == 2 else "<u4")


class _Packs:
    """Writes chunks to packs of bounded size; offsets count from the file's start."""

    def __init__(self, folder: str, label: str, width: int):
        self.folder, self.label, self.width = folder, label, width
        self.n, self.parts, self.size = 0, [], HEADER.size

    @property
    def name(self) -> str:
        return f"pack-{self.label}-{self.n:05d}.cas"

    def add(self, payload: bytes) -> tuple[str, int]:
        if self.size >= PACK_BYTES:
            self.flush()
        at = self.size
        self.parts.append(payload)
        self.size += len(payload)
        return self.name, at

    def flush(self) -> None:
        if self.parts:
            parts = self.parts
            publish(f"{self.folder}/{self.name}", lambda out: (out.write(HEADER.pack(MAGIC, self.width)), [out.write(p) for p in parts]))
        self.n, self.parts, self.size = self.n + 1, [], HEADER.size


RECIPE = "doc_id long, n_tokens long, root binary, names array<binary>, sizes array<int>, packs array<string>, offsets array<long>"


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write the store under ``folder``.

    Null texts are empty, so hold the end id alone.  Rows with a null id are not stored.  Repeated
    ids give repeated recipes that follow one another.  An empty table gives an empty store.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession

    def cut(batches):
        encoder = word_encoder(tokenizer)
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        packs = _Packs(f"{folder}/staging", f"{TaskContext.get().partitionId():06d}", width)
        seen: dict[bytes, tuple[str, int]] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, counts = with_end(*encoder.encode(text_column(batch, "text")), end_id)
                stream, ends, rows = ids.astype(_dtype(width)), np.cumsum(counts), []
                for doc, start, n, cuts in zip(batch.column("id").to_pylist(), (ends - counts).tolist(), counts.tolist(), cut_points(ids, counts)):
                    names, sizes, places, last = [], [], [], 0
                    for end in cuts:
                        payload = stream[start + last:start + end].tobytes()
                        name = hashlib.sha256(payload).digest()
                        place = seen.get(name)
                        if place is None:
                            if len(seen) >= SEEN:
                                seen.clear()
                            place = seen[name] = packs.add(payload)
                        names.append(name)
                        sizes.append(end - last)
                        places.append(place)
                        last = end
                    rows.append((doc, n, merkle_root(names), names, sizes, [p for p, _ in places], [o for _, o in places]))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=RECIPE_NAMES)
        packs.flush()

    source = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    source.mapInArrow(cut, RECIPE).write.parquet(f"{folder}/staged")
    staged = spark.read.parquet(f"{folder}/staged")
    chunks = staged.select(F.explode(F.arrays_zip("names", "sizes", "packs", "offsets")).alias("c")).select(
        F.col("c.names").alias("name"), F.col("c.sizes").alias("n_ids"), F.col("c.packs").alias("pack"), F.col("c.offsets").alias("offset")
    )
    owners = chunks.groupBy("name").agg(F.min(F.struct("pack", "offset", "n_ids")).alias("at")).select("name", "at.*")
    # one pack's owned chunks come together, in stream order; a pack is bounded by PACK_BYTES
    owners.repartition("pack").sortWithinPartitions("pack", "offset").mapInArrow(_compact(folder), "name binary, pack string, offset long, n_ids int, width int").write.parquet(f"{folder}/index")
    staged.select("doc_id", "n_tokens", "root", "names", "sizes").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root").write.parquet(f"{folder}/recipes")
    buckets = max(1, staged.count() // BUCKET_ROWS)
    _roots_of(spark, folder, buckets).write.parquet(f"{folder}/manifest")
    _seal(spark.read.parquet(f"{folder}/manifest")).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/seal")
    delete_tree(spark, f"{folder}/staging")
    delete_tree(spark, f"{folder}/staged")


#: Recipes under one root of the manifest, about.
BUCKET_ROWS = 4096


def _roots_of(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """``(kind, part, rows, ids, root)`` of the packs in the index and of the buckets of recipes."""
    packs = spark.read.parquet(f"{folder}/index").select(F.lit("pack").alias("kind"), F.col("pack").alias("part"), F.col("offset").alias("at"), F.col("n_ids").cast("long").alias("ids"), F.col("name").alias("leaf"))
    recipes = spark.read.parquet(f"{folder}/recipes").select(
        F.lit("recipes").alias("kind"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("string").alias("part"), F.col("doc_id").alias("at"), F.col("n_tokens").alias("ids"),
        F.unhex(F.sha2(F.concat(F.col("root"), F.encode(F.concat_ws(" ", "doc_id", "n_tokens"), "utf-8")), 256)).alias("leaf"),
    )
    rows = packs.unionByName(recipes).repartition("kind", "part").sortWithinPartitions("kind", "part", "at", "leaf")
    return rows.mapInArrow(_roots, "kind string, part string, rows long, ids long, root binary")


def _seal(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy().agg(
        F.count_if(F.col("kind") == "pack").alias("packs"), F.count_if(F.col("kind") == "recipes").alias("recipes"),
        F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.coalesce(F.sum(F.xxhash64("kind", "part", "rows", "ids", "root").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash"),
    )


def verify_store(spark: SparkSession, folder: str) -> None:
    """Raise :class:`CorruptChunk` if seal, manifest, index and recipes do not agree."""
    seal = spark.read.parquet(f"{folder}/seal").collect()  # one row
    manifest = spark.read.parquet(f"{folder}/manifest")
    if len(seal) != 1 or seal[0].asDict() != {**_seal(manifest).first().asDict(), "buckets": seal[0]["buckets"]}:
        raise CorruptChunk("the manifest does not match its seal")
    columns = ("kind", "part", "rows", "ids", "root")
    now = _roots_of(spark, folder, seal[0]["buckets"])
    wrong = now.select(*columns, F.lit(1).alias("n")).unionByName(manifest.select(*columns, F.lit(-1).alias("n"))).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0").first()
    if wrong:
        raise CorruptChunk(f"{wrong['kind']} {wrong['part']} does not match the manifest")


RECIPE_NAMES = ["doc_id", "n_tokens", "root", "names", "sizes", "packs", "offsets"]


def _runs(batches, columns, keys: int = 1):
    """Rows sorted by their first ``keys`` columns, one dict of lists per run of equal keys."""
    held, last = {c: [] for c in columns}, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[:keys] != last and last is not None:
                yield held
                held = {c: [] for c in columns}
            last = row[:keys]
            for c, v in zip(columns, row):
                held[c].append(v)
    if last is not None:
        yield held


def _compact(folder):
    def run(batches):
        for own in _runs(batches, ["pack", "offset", "n_ids", "name"]):
            pack = own["pack"][0]
            filesystem, path = open_fs(f"{folder}/staging/{pack}")
            with filesystem.open_input_file(path) as file:
                data = file.read()
            width = _width(data, pack)
            parts = [data[o:o + n * width] for o, n in zip(own["offset"], own["n_ids"])]
            offsets = np.cumsum([len(_header(width)), *map(len, parts)])[:-1]
            publish(f"{folder}/packs/{pack}", lambda out: (out.write(_header(width)), out.write(b"".join(parts))))
            n = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.array(own["name"], pa.binary()), pa.array([pack] * n), pa.array(offsets.astype(np.int64)),
                pa.array(own["n_ids"], pa.int32()), pa.array([width] * n, pa.int32()),
            ], names=["name", "pack", "offset", "n_ids", "width"])

    return run


def _roots(batches):
    for own in _runs(batches, ["part", "kind", "ids", "leaf"], 2):
        yield pa.RecordBatch.from_arrays([
            pa.array([own["kind"][0]]), pa.array([own["part"][0]]), pa.array([len(own["leaf"])], pa.int64()), pa.array([sum(own["ids"])], pa.int64()), pa.array([merkle_root(own["leaf"])], pa.binary()),
        ], names=["kind", "part", "rows", "ids", "root"])


class CorruptChunk(ValueError):
    """A stored chunk or document does not match its name."""


#: Gaps up to this many bytes between chunks of a pack are read through in one request.
JOIN_BYTES = 64 << 10
#: Ids that one reading step holds.
READ_IDS = 1 << 20


def _fetch(folder: str, wanted: dict[str, dict[int, int]]) -> dict[tuple[str, int], bytes]:
    """Payloads by (pack, offset); near ranges of a pack are read together."""
    out = {}
    for pack, ranges in wanted.items():
        filesystem, path = open_fs(f"{folder}/packs/{pack}")
        spans: list[list] = []
        for at, size in sorted(ranges.items()):
            if spans and at - spans[-1][1] <= JOIN_BYTES and at + size - spans[-1][0] <= PACK_BYTES:
                spans[-1][1] = max(spans[-1][1], at + size)
                spans[-1][2].append((at, size))
            else:
                spans.append([at, at + size, [(at, size)]])
        with filesystem.open_input_file(path) as file:
            for low, high, parts in spans:
                file.seek(low)
                data = file.read(high - low)
                for at, size in parts:
                    out[pack, at] = data[at - low:at - low + size]
    return out


def _rebuild(folder):
    def docs_of(rows):
        wanted: dict[str, dict[int, int]] = {}
        for r in rows:
            if None in r["packs"] or sum(r["sizes"]) != r["n_tokens"]:
                raise CorruptChunk(f"document {r['doc_id']}: a chunk is not in the index, or its chunks do not add up")
            for pack, at, n, width in zip(r["packs"], r["offsets"], r["sizes"], r["widths"], strict=True):
                wanted.setdefault(pack, {})[at] = n * width
        data, checked = _fetch(folder, wanted), {}
        blobs = []
        for r in rows:
            parts = []
            for name, pack, at, width in zip(r["names"], r["packs"], r["offsets"], r["widths"], strict=True):
                part = checked.get(name)
                if part is None:
                    raw = data[pack, at]
                    if hashlib.sha256(raw).digest() != name:
                        raise CorruptChunk(f"{pack} at {at} does not match its name")
                    part = checked[name] = np.frombuffer(raw, dtype=_dtype(width)).astype("<u4").tobytes()
                parts.append(part)
            if merkle_root(r["names"]) != r["root"]:
                raise CorruptChunk(f"document {r['doc_id']} does not match its root")
            blobs.append(b"".join(parts))
        return pa.RecordBatch.from_arrays([
            pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["n_tokens"] for r in rows], pa.int64()),
            pa.array([r["start"] for r in rows], pa.int64()), pa.array(blobs, pa.binary()),
        ], names=["doc_id", "n_tokens", "start", "ids"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += row["n_tokens"]
                if size >= READ_IDS:
                    yield docs_of(held)
                    held, size = [], 0
        if held:
            yield docs_of(held)

    return run


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary little-endian uint32)`` rebuilt from the files.

    ``start`` counts the ids of all documents before it in ascending doc_id order.  Raises
    :class:`CorruptChunk` if the store's parts do not agree (at once), or a chunk or a document does
    not verify (where it is read).
    """
    from pyspark.sql import Window

    verify_store(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    # recipe files are id ranges: a running sum inside each, plus the total of the files before it
    filed = recipes.withColumn("file", F.input_file_name())
    totals = filed.groupBy("file").agg(F.sum("n_tokens").alias("ids"), F.min("doc_id").alias("low")).collect()  # one row a file
    base, before = 0, []
    for row in sorted(totals, key=lambda r: (r["low"], PurePosixPath(r["file"]).name)):
        before.append((row["file"], base))
        base += row["ids"]
    offsets = spark.createDataFrame(before, "file string, base long")
    in_file = Window.partitionBy("file").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    started = filed.select("doc_id", "n_tokens", "root", "names", "sizes", "file", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)).alias("within"))
    started = started.join(F.broadcast(offsets), "file").select("doc_id", "n_tokens", "root", "names", "sizes", (F.col("base") + F.col("within")).alias("start"))
    index = spark.read.parquet(f"{folder}/index").select("name", "pack", "offset", "width")
    placed = (
        started.select("start", F.posexplode("names").alias("pos", "name"))
        .join(index, "name", "left")
        .groupBy("start")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "pack", "offset", "width"))).alias("c"))
    )
    rows = started.join(placed, "start").select(
        "doc_id", "n_tokens", "root", "names", "sizes", "start", F.col("c.pack").alias("packs"), F.col("c.offset").alias("offsets"), F.col("c.width").alias("widths")
    )
    return rows.repartitionByRange("start").sortWithinPartitions("start").mapInArrow(_rebuild(folder), "doc_id long, n_tokens long, start long, ids binary").select("doc_id", "start", "n_tokens", "ids")
