"""Embedding bundles, label files, append logs, overlays, and the index tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.labels import pending
from .documents import is_document, read_whole

BUNDLE = "path string, vector array<float>, exif struct<DateTimeOriginal:string,DateTime:string,Make:string,Model:string,GPSInfo:map<string,string>>, model string, dim int"
LABELS = "path string, bytes long, response string, text string, error string"


def metadata_root(spark: SparkSession, env_file: str = ".env", default: str = "metadata", key: str = "PHOTO_METADATA_DIR") -> str:
    """Root of all metadata: session setting ``shoebox.metadata.root``, environment, env file, default."""
    found = spark.conf.get("shoebox.metadata.root", None) or os.environ.get(key)
    if not found and Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            name, _, value = line.partition("=")
            if name.strip() == key and value.strip():
                found = value.strip().strip("\"'")
    return found or default


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Embedding rows; an absent bundle reads as an empty one."""
    return read_parquet(spark, path, BUNDLE)


def append_new(scanned: DataFrame, bundle: str) -> DataFrame:
    """Rows of ``scanned`` whose path the bundle lacks; appended to it and returned from it."""
    spark = scanned.sparkSession
    pending(scanned, read_bundle(spark, bundle)).write.mode("append").parquet(bundle)
    return read_bundle(spark, bundle)


def read_label_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Label results of files and folders: ``path, bytes, response, text, error, file_no, seq``.

    A file is ``{"results": [...]}``.  ``file_no`` is the file's place in the list (folders by name),
    ``seq`` the row's place in the file.  Hidden files are ignored; no file at all is an error.
    """
    paths = [str(p) for f in files for p in (sorted(Path(f).glob("*.json")) if Path(f).is_dir() else [Path(f)]) if Path(p).is_file() and not Path(p).name.startswith(".")]
    if not paths:
        raise FileNotFoundError(f"no label files in {files}")
    order = spark.createDataFrame([(Path(p).name, p, i) for i, p in enumerate(paths)], "name string, full string, file_no int")
    rows = spark.read.schema(f"results array<struct<{', '.join(c.replace(' ', ':') for c in LABELS.split(', '))}>>").option("multiLine", "true").json(paths)
    listed = rows.select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("full"), F.posexplode("results").alias("seq", "r"))
    return listed.join(F.broadcast(order.select("full", "file_no")), "full").select("r.*", "file_no", "seq")  # one row a file


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append log of JSON lines; lines that are no objects of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_overlay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An overlay table; absent or corrupt reads as empty.

    A file is one JSON document, an object or a list of them over any number of lines, or one object a
    line.  Overlays are curated by hand and small; they are read once more to see that all is sound.
    """
    texts = read_whole(spark, path)
    rows = F.when(is_document(F.col("text")), F.array("text")).otherwise(F.filter(F.split("text", "\n"), lambda line: F.trim(line) != ""))
    pieces = texts.select(F.explode(rows).alias("text"))
    if pieces.agg(F.count_if(~is_document(F.col("text"))).alias("n")).first()["n"]:
        return spark.createDataFrame([], schema)
    return pieces.select(F.explode(F.from_json("text", f"array<struct<{_fields(schema)}>>")).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table; an absent one reads as empty."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """The index, partitioned by year so that year filters read only their folders."""
    index.write.mode("overwrite").partitionBy("year").parquet(path)


#: Bytes of a row group of a lookup table, about what one lookup reads.
LOOKUP_BYTES = 1 << 20


def write_lookup(rows: DataFrame, path: str, key: str = "path") -> None:
    """A table for looking up single keys: sorted by key, small row groups, a bloom filter in each."""
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key)
    ranged.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", LOOKUP_BYTES).parquet(path)


def look_up(spark: SparkSession, path: str, keys: list[str], key: str = "path") -> DataFrame:
    """Rows of a few keys.  Only files and row groups whose range and bloom filter admit a key are read."""
    return spark.read.parquet(path).where(F.col(key).isin(keys))


def write_timeline(events: DataFrame, photos: DataFrame, path: str) -> None:
    """Timeline events under ``events``, their ``photos(id, start, pos, path)`` under ``photos``, both partitioned by the year the event begins in."""
    for name, rows in (("events", events), ("photos", photos)):
        rows.withColumn("year", F.year("start")).write.mode("overwrite").partitionBy("year").parquet(f"{path}/{name}")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
