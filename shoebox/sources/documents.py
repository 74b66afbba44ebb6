"""Files that are one JSON document: overlays, the photo index, the timeline.

They are read whole and told apart: absent, corrupt, or sound.  Large ones that are laid out over
lines, two blanks a level, are read by lines in parallel and checked entry by entry.  Writing goes through a data source
with two-phase commit: each task writes its entries as a part, and the commit, once all tasks have
succeeded, streams the parts between the document's head and tail into a private file and renames
it.  Readers see the old document or the new one, never a piece.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators import graph, timeline

#: Bytes that the commit holds at a time.
CHUNK = 8 << 20
#: Bytes up to which a document is read as one text; larger ones are read by lines.
WHOLE_BYTES = 16 << 20
#: Overlay files by their content: a map of texts, a map of lists, a list of texts, a list of objects.
SHAPES = {
    "names": "map<string,string>", "merges": "map<string,string>", "thumb_overrides": "map<string,string>", "removed": "map<string,array<string>>",
    "skipped": "array<string>", "moves": "array<struct<path:string,`from`:string,to:string>>",
}


def is_document(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; the parsers alone stop behind the first one."""
    closed = F.concat(F.lit("["), text, F.lit(',"end"]'))
    parts = F.from_json(closed, "array<string>")
    return F.coalesce(F.try_parse_json(closed).isNotNull() & (F.size(parts) == 2) & (F.get(parts, F.lit(1)) == "end"), F.lit(False))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """``(text)``: one row a file; none if nothing is there."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    except AnalysisException:
        return spark.createDataFrame([], "text string")


def document_state(spark: SparkSession, path: str) -> str:
    """``absent``, ``corrupt`` or ``sound``; an empty file holds nothing and counts as absent."""
    found = read_whole(spark, path).agg(F.count("*").alias("n"), F.count_if(~is_document(F.col("text"))).alias("bad")).first()
    return "absent" if not found["n"] else "corrupt" if found["bad"] else "sound"


def _entries(spark: SparkSession, path: str, shape: str, value: Column) -> DataFrame:
    sound = read_whole(spark, path).where(is_document(F.col("text")))
    # a sound document of another shape reads as empty too
    return sound.select(F.from_json(value, shape).alias("d"))


def read_map(spark: SparkSession, path: str, value: str = "string", key: str = "id", name: str = "name") -> DataFrame:
    """Entries of ``{key: value}``; of lists as values, one row an element.  Absent or corrupt reads as empty."""
    many = value.startswith("array<")
    rows = _entries(spark, path, f"map<string,{value}>", F.col("text")).select(F.explode("d").alias(key, name))
    return rows.withColumn(name, F.explode(name)) if many else rows


def read_list(spark: SparkSession, path: str, element: str = "string", name: str = "id") -> DataFrame:
    """Elements of ``[...]`` in order with ``seq``; objects become columns.  Absent or corrupt reads as empty."""
    rows = _entries(spark, path, f"array<{element}>", F.col("text")).select(F.posexplode("d").alias("seq", name))
    return rows.select("seq", f"{name}.*") if element.startswith("struct<") else rows


def read_curated(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A curated overlay by its kind, with the columns that the overlay operators take.

    names ``(id, name)``, merges ``(src, dst)``, thumb_overrides ``(id, path)``, removed ``(id, path)``,
    skipped ``(id)``, moves ``(path, src, dst, seq)``.
    """
    if kind == "moves":
        return read_list(spark, path, SHAPES[kind][6:-1]).select("path", F.col("from").alias("src"), F.col("to").alias("dst"), F.col("seq").cast("long").alias("seq"))
    if kind == "skipped":
        return read_list(spark, path).select("id")
    names = {"names": ("id", "name"), "merges": ("src", "dst"), "thumb_overrides": ("id", "path"), "removed": ("id", "path")}[kind]
    return read_map(spark, path, SHAPES[kind][len("map<string,"):-1], *names)


def read_index(spark: SparkSession, path: str, image: str) -> DataFrame:
    """The ``images`` of an index document: ``path`` and the fields of ``image``, a struct type."""
    lines = _lines(spark, path, "images", {})
    if lines is None:
        return read_part(spark, path, "images", f"map<string,{image}>").select(F.explode("d").alias("path", "image")).select("path", "image.*")
    shape = f"map<string,{image}>"
    found = graph.materialize(_entries_of(lines, 1, "{", "}").select("whole", F.from_json("text", shape).alias("d")))
    return _if_all(found, "whole").select(F.explode("d").alias("path", "image")).select("path", "image.*")


def read_timeline(spark: SparkSession, path: str, event: str) -> DataFrame:
    """The ``events`` of a timeline document: the fields of ``event``, a struct type, in order with ``seq``."""
    return read_part(spark, path, "events", f"array<{event}>").select(F.posexplode("d").alias("seq", "event")).select("seq", "event.*")


def read_timeline_rows(spark: SparkSession, path: str, event: str, photo: str = "string") -> tuple[DataFrame, DataFrame]:
    """(events, photos) of a timeline document: ``seq`` and the fields of ``event`` but ``photos``; and ``(seq, photo)``.

    ``seq`` goes up in the document's order.  No row holds an event's photos unless the document is small.
    """
    lines = _lines(spark, path, "events", [], "photos")
    if lines is None:
        whole = read_part(spark, path, "events", f"array<{event}>").select(F.posexplode("d").alias("seq", "event")).withColumn("seq", F.col("seq").cast("long"))
        return whole.select("seq", "event.*").drop("photos"), whole.select("seq", F.explode("event.photos").alias("photo"))
    # an event without the members of its lists, and those members, each by itself
    events = graph.materialize(_entries_of(lines.where("level < 4"), 1, "[", "]").select("whole", F.col("at1").alias("seq"), F.get(F.from_json("text", f"array<{event}>"), F.lit(0)).alias("event")))
    photos = graph.materialize(_entries_of(lines.where("level >= 4"), 2, "[", "]").select("whole", F.col("at1").alias("seq"), F.get(F.from_json("text", f"array<{photo}>"), F.lit(0)).alias("photo")))
    sound = events.select("whole").union(photos.select("whole"))
    return _if_all(events, "whole", sound).select("seq", "event.*").drop("photos"), _if_all(photos, "whole", sound).select("seq", "photo")


def _if_all(rows: DataFrame, flag: str, among: DataFrame | None = None) -> DataFrame:
    """The rows if the flag holds in all of them, else none: a document with one broken entry is corrupt."""
    bad = (rows if among is None else among).where(~F.col(flag)).limit(1).count()
    return rows.limit(0) if bad else rows


def _lines(spark: SparkSession, path: str, field: str, empty: dict | list, members: str = "") -> DataFrame | None:
    """Lines of the entries under ``field`` of a large document: ``value, at, level, at1``, with ``members`` also ``at2``.

    ``at`` goes up with the lines, ``level`` counts indents, ``at1`` is the line that opens the entry, and
    ``at2`` the one that opens the member of an entry's list ``members``.  None if the document is to be
    read whole: it is small or absent, or laid out otherwise, or holds more lists and objects than these.
    """
    try:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    except AnalysisException:
        return None
    if not size or size <= WHOLE_BYTES:
        return None
    level = F.floor((F.length("value") - F.length(F.ltrim("value"))) / 2)
    read = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), level.alias("level"))
    read = read.where(F.trim("value") != "")
    outer = read.where("level < 2")
    if (outer.agg(F.sum(F.length("value"))).first()[0] or 0) > OUTER_CHARS:
        return None
    try:
        shape = json.loads("\n".join(r["value"] for r in outer.orderBy("block", "line").collect()), object_pairs_hook=list)  # the document without its entries
    except ValueError:
        return None
    fields = [k for k, v in shape if isinstance(v, list)] if isinstance(shape, list) and all(isinstance(p, tuple) for p in shape) else []
    opens_as = "{" if empty == {} else "["
    if fields != [field] or not outer.where(F.trim("value") == f'"{field}": {opens_as}').limit(1).count():
        return None
    lines = graph.materialize(read.where("level >= 2"))
    # a line has a byte at least, so a block's offset and the lines before it in the block make a place
    firsts = F.broadcast(lines.groupBy("block").agg(F.min("line").alias("low")))  # one row a block
    lines = lines.join(firsts, "block").select("block", (F.col("block") + F.col("line") - F.col("low")).alias("at"), "level", "value")
    closes = F.ltrim("value").substr(1, 1).isin("]", "}")
    opens = {"at1": F.when((F.col("level") == 2) & ~closes, F.col("at"))}
    if members:
        opens |= {"at2": F.when((F.col("level") == 4) & ~closes, F.col("at")), "list": F.when((F.col("level") == 3) & ~closes, F.col("at") * 2 + (F.trim("value") == f'"{members}": [').cast("int"))}
    within = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    over_blocks = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    last = lines.groupBy("block").agg(*[F.max(c).alias(n) for n, c in opens.items()]).select("block", *[F.max(n).over(over_blocks).alias(f"{n}_before") for n in opens])
    lines = lines.join(F.broadcast(last), "block").select("at", "level", "value", *[F.coalesce(F.max(c).over(within), f"{n}_before").alias(n) for n, c in opens.items()])
    if not members:
        return lines
    lines = graph.materialize(lines)
    return None if lines.where("level >= 4 and coalesce(list % 2, 0) = 0").limit(1).count() else lines.drop("list")


#: Characters of levels 0 and 1 that are read at most; more of them are no frame of a document.
OUTER_CHARS = 1 << 20


def _entries_of(lines: DataFrame, depth: int, opening: str, closing: str) -> DataFrame:
    """``(at1, .., text, whole)``: entries in brackets of their own, and whether they are sound and stand between commas.

    Every entry but the last of its list ends in a comma.
    """
    keys = [f"at{n}" for n in range(1, depth + 1)]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"]), "\n")
    found = lines.groupBy(*keys).agg(text.alias("text")).withColumn("comma", F.rtrim("text").endswith(","))
    bare = F.when(F.col("comma"), F.rtrim("text").substr(F.lit(1), F.length(F.rtrim("text")) - 1)).otherwise(F.col("text"))
    found = found.withColumn("text", F.concat(F.lit(opening), bare, F.lit(closing)))
    lists = keys[:-1]
    ends = found.groupBy(*lists).agg(F.max(keys[-1]).alias("end"))
    found = found.join(F.broadcast(ends) if not lists else ends, lists) if lists else found.crossJoin(F.broadcast(ends))  # one row
    return found.withColumn("whole", F.coalesce(is_document(F.col("text")) & (F.col("comma") == (F.col(keys[-1]) < F.col("end"))), F.lit(False)))


def read_part(spark: SparkSession, path: str, field: str, shape: str) -> DataFrame:
    """``(d)``: one field of a document's object."""
    sound = read_whole(spark, path).where(is_document(F.col("text")))
    return sound.select(F.from_json("text", f"struct<{field}:{shape}>")[field].alias("d"))


def _files(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


@dataclass
class Part(WriterCommitMessage):
    place: int
    name: str
    entries: int
    between: str = ","


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.field = options["path"], options.get("field", "")
        self.head, self.as_map = json.loads(options.get("head", "{}")), options.get("kind", "map") == "map"
        self.laid_out = options.get("laid_out", "") == "true"
        self.depth = 4 if self.field else 2
        self.folder = f"{self.path}.{options['token']}.parts"

    def _text(self, row) -> str:
        value = json.dumps(json.loads(row[1]), indent=2, ensure_ascii=False).replace("\n", "\n" + " " * self.depth)
        return " " * self.depth + (f"{json.dumps(row[0], ensure_ascii=False)}: {value}" if self.as_map else value)

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        files, folder = _files(self.folder)
        files.create_dir(folder, recursive=True)
        name, entries, place, first = f"{folder}/{uuid.uuid4().hex}", 0, TaskContext.get().partitionId(), ","
        with files.open_output_stream(name) as out:
            for row in iterator:
                between, text = (row[0], row[1]) if self.laid_out else (",", self._text(row))
                first = first if entries else between
                out.write(((between + "\n" if entries else "") + text).encode())
                entries += 1
        return Part(place, name, entries, first)

    def commit(self, messages) -> None:
        files, path = _files(self.path)
        parts = [m for m in sorted((m for m in messages if m), key=lambda m: m.place) if m.entries]
        opening, closing = "{}" if self.as_map else "[]"
        head = "{\n" + "".join(f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)},\n" for k, v in self.head.items()) + f"  {json.dumps(self.field)}: " if self.field else ""
        private = f"{path}.{uuid.uuid4().hex}.writing"
        with files.open_output_stream(private) as out:
            out.write((head + opening + ("\n" if parts else "")).encode())
            for i, part in enumerate(parts):
                out.write((part.between + "\n").encode() if i else b"")
                with files.open_input_stream(part.name) as source:
                    while chunk := source.read(CHUNK):
                        out.write(chunk)
            out.write((("\n" + " " * (self.depth - 2) if parts else "") + closing + ("\n}" if self.field else "")).encode())
        files.move(private, path)
        self._clear(files)

    def _clear(self, files) -> None:
        _, folder = _files(self.folder)
        if files.get_file_info(folder).type.name == "Directory":
            files.delete_dir(folder)

    def abort(self, messages) -> None:
        self._clear(_files(self.folder)[0])


class JsonDocument(DataSource):
    """Writes ``(key, value)`` rows, values as JSON texts, into one document."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "key string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def write_document(rows: DataFrame, path: str, kind: str = "map", field: str = "", head: dict | None = None, laid_out: bool = False) -> None:
    """``rows(key, value)`` as ``{key: value}``, or as ``[value]`` with ``kind='list'``, in the rows' order.

    With ``field`` the entries stand under it, behind the fields of ``head``.  Text is indented by
    two and not escaped, as people edit these files.  An earlier document is replaced at the commit.
    With ``laid_out`` values are pieces of the document's text and keys what stands between a piece
    and the line before it, so that an entry may be made of many rows.
    """
    rows.sparkSession.dataSource.register(JsonDocument)
    slim = rows.select("key" if kind == "map" or laid_out else F.lit("").alias("key"), "value")
    slim.write.format("json_document").mode("append").option("kind", kind).option("field", field).option("head", json.dumps(head or {})).option("laid_out", str(laid_out).lower()).option("token", uuid.uuid4().hex).save(path)


def as_json(*columns: str | Column) -> Column:
    """The columns as one JSON object, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_index_document(index: DataFrame, path: str, built_at: str) -> None:
    """The photo index as one document: ``total_images, built_at, images: {path: {...}}`` in path order."""
    fields = [c for c in index.columns if c != "path"]
    rows = index.select(F.col("path").alias("key"), as_json(*fields).alias("value")).orderBy("key")
    write_document(rows, path, "map", "images", {"total_images": index.count(), "built_at": built_at})


def write_timeline_document(events: DataFrame, photos: DataFrame, path: str, built_at: str, gap_hours: float, min_photos: int) -> None:
    """Timeline events as one document, newest first; ``photos(id, start, pos, path)`` stand in each event before its last field."""
    quoted = lambda c: F.to_json(F.array(c), {"ignoreNullFields": "false"}).substr(F.lit(2), F.length(F.to_json(F.array(c), {"ignoreNullFields": "false"})) - 2)
    line = lambda name: F.concat(F.lit(f"      {json.dumps(name)}: "), F.coalesce(quoted(F.col(name)), F.lit("null")))
    *first, last = events.columns
    opening = F.concat(F.lit("    {\n"), *[F.concat(line(c), F.lit(",\n")) for c in first], F.lit('      "photos": ['))
    closing = F.concat(F.lit("      ],\n"), line(last), F.lit("\n    }"))
    listed = timeline.pieces(photos, ("start", "id"), ",\n        ", quoted(F.col("path")))
    between = F.when(F.col("piece") == 0, "").otherwise(",")
    rows = events.select("start", "id", F.lit(-1).cast("long").alias("piece"), F.lit(",").alias("key"), opening.alias("value"))
    rows = rows.union(listed.select("start", "id", "piece", between, F.concat(F.lit("        "), "text")))
    rows = rows.union(events.select("start", "id", F.lit((1 << 63) - 1), F.lit(""), closing))
    head = {"built_at": built_at, "gap_hours": gap_hours, "min_photos": min_photos, "total_events": events.count()}
    write_document(rows.orderBy(F.desc("start"), "id", "piece"), path, "list", "events", head, laid_out=True)
