"""The overlay log with optimistic commits and snapshots.

A commit is one numbered file, put only if its number is still free.  Whoever finds it taken reads the
state again, works its edit out anew and tries the next number, so two writers never share a place in
the order, and an edit that another one has made pointless is refused.  Edits made by hand travel
inside their commit; edits made by a job are a Parquet part that the commit names.  A snapshot holds
the state up to one commit, so that reading costs the snapshot and the commits behind it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.overlay import _KEYS, log_state

EVENTS = "seq long, entry string, id string, path string, value string"
#: Places that a commit has for its edits in the order of all edits.
PLACES = 1 << 32
#: Commits behind a snapshot before :meth:`OverlayLog.commit` takes another one.
SNAPSHOT_EVERY = 50


class OverlayLog:
    """The log below ``root``, a folder of a file system whose renames are atomic and refuse to replace."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.root, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        there = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []

    def latest(self) -> int:
        """The number of the last commit; 0 without any."""
        return max((int(n[:-5]) for n in self._names("commits") if n.endswith(".json")), default=0)

    def _snapshots(self) -> list[int]:
        return sorted(int(n) for n in self._names("snapshots") if n.isdigit() and self._fs.exists(self._path("snapshots", n, "_SUCCESS")))

    def _put(self, version: int, content: dict) -> bool:
        """Whether the commit of this number is ours."""
        name, private = f"{version:020d}.json", f".{uuid.uuid4().hex}.writing"
        self._fs.mkdirs(self._path("commits"))
        out = self._fs.create(self._path("commits", private), False)
        out.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":
            # a local rename replaces, a link does not
            folder = self._fs.makeQualified(self._path("commits")).toUri().getPath()
            try:
                os.link(f"{folder}/{private}", f"{folder}/{name}")
                won = True
            except FileExistsError:
                won = False
        else:
            won = self._fs.rename(self._path("commits", private), self._path("commits", name))
        self._fs.delete(self._path("commits", private), False)
        return won

    def read(self, upto: int | None = None) -> DataFrame:
        """Events ``(seq, entry, id, path, value)`` of the state at commit ``upto`` (the last one): snapshot and tail."""
        last = self.latest() if upto is None else upto
        base = max((v for v in self._snapshots() if v <= last), default=0)
        found = self.spark.read.schema(EVENTS).parquet(f"{self.root}/snapshots/{base}") if base else self.spark.createDataFrame([], EVENTS)
        if base == last:
            return found
        files = [f"{self.root}/commits/{v:020d}.json" for v in range(base + 1, last + 1)]
        shape = "version long, data string, rows array<struct<entry:string,id:string,path:string,value:string>>"
        tail = self.spark.read.schema(shape).json(files)
        rows = tail.select("version", F.posexplode("rows").alias("place", "r")).select((F.col("version") * PLACES + F.col("place")).alias("seq"), "r.*")
        found = found.unionByName(rows)
        for r in tail.where("data is not null").select("version", "data").collect():  # one row a commit, SNAPSHOT_EVERY at most
            part = self.spark.read.schema("place long, entry string, id string, path string, value string").parquet(f"{self.root}/{r['data']}")
            found = found.unionByName(part.select((F.lit(r["version"]) * PLACES + F.col("place")).alias("seq"), "entry", "id", "path", "value"))
        return found

    def state(self, entry: str, upto: int | None = None) -> DataFrame:
        """Current rows of one kind of entry, as :func:`overlay.log_state` gives them."""
        return log_state(self.read(upto), entry)

    def commit(self, edit: Callable[[DataFrame], DataFrame], tries: int = 20) -> int | None:
        """Commit what ``edit(events)`` returns; its number, or None if there was nothing to do.

        ``edit`` sees the state that its commit will follow and returns events ``(seq, entry, id, path,
        value)``, a few rows whose ``seq`` orders them, as the overlay operators make them.
        """
        for _ in range(tries):
            last = self.latest()
            rows = [{c: r[c] for c in ("entry", "id", "path", "value")} for r in edit(self.read(last)).orderBy("seq").collect()]
            if not rows:
                return None
            if self._put(last + 1, {"version": last + 1, "rows": rows}):
                return self._done(last + 1)
        raise RuntimeError(f"{tries} other writers were faster")

    def commit_table(self, events: DataFrame, tries: int = 20) -> int:
        """Commit the events of a job, any number of them; ``seq`` orders them among each other."""
        name = f"data/{uuid.uuid4().hex}"
        events.select(F.col("seq").alias("place"), "entry", "id", "path", "value").write.parquet(f"{self.root}/{name}")
        for _ in range(tries):
            last = self.latest()
            if self._put(last + 1, {"version": last + 1, "data": name, "rows": []}):
                return self._done(last + 1)
        raise RuntimeError(f"{tries} other writers were faster")

    def _done(self, version: int) -> int:
        if version - max(self._snapshots(), default=0) >= SNAPSHOT_EVERY:
            self.snapshot(version)
        return version

    def snapshot(self, version: int | None = None) -> int:
        """Write the state at a commit; cleared entries are left out.  Writing it twice does no harm."""
        version = self.latest() if version is None else version
        if version and version not in self._snapshots():
            events = self.read(version)
            parts = [log_state(events, entry).select("seq", F.lit(entry).alias("entry"), "id", "path", "value") for entry in _KEYS]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            whole.write.mode("overwrite").parquet(f"{self.root}/snapshots/{version}")
        return version
