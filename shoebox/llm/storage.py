"""Shared scratch space, file access from executors, and lineage cuts.

Scratch tables live under ``spark.checkpoint.dir``, the one folder that the driver and all
executors share.  If the session leaves it unset and runs on this machine alone (tests, a laptop) a
temporary folder is created once and recorded in the session under the same key; on a cluster that
is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shoebox-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new, so far absent folder below the shared root; every call gives another one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_root(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def delete_tree(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """(filesystem, path) for a URI, usable on the driver and on executors.

    ``pyarrow.fs`` resolves local, HDFS and object-store URIs alike; a bare path is local.
    """
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, writer) -> int:
    """Write a file under a private name, then rename it; returns its size.

    A retried or speculative task replaces the file of the same name whole, so readers see
    either no file or a complete one.
    """
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}.writing"
    with filesystem.open_output_stream(private) as out:
        writer(out)
        size = out.tell()
    filesystem.move(private, path)
    return size
