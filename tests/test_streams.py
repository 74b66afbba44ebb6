"""Streams with restarts: the timeline in append mode, and work done once a path."""

import datetime

import pandas as pd
import pytest

from shoebox.operators import timeline
from shoebox.streaming import logs, timeline as live, visited

SCHEMA = "path string, taken_at timestamp_ntz, has_face boolean"


def feed(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_append_equals_batch_with_sentinel(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    times = [start + datetime.timedelta(hours=20 * (i // 5), minutes=30 * (i % 5)) for i in range(60)]
    photos = [(f"/p{i:03d}", t, i % 3 == 0) for i, t in enumerate(times)]
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    for i in range(0, 60, 30):
        feed(spark, folder, photos[i:i + 30][::-1])
        stopped = []

        def kill(batch):
            stopped.append(batch)
            raise RuntimeError("killed behind the batch, before its commit")

        with pytest.raises(Exception, match="killed"):
            live.run_events(source(spark, folder), work, "6 hours", "2 days", stop=kill)
        found, late = live.run_events(source(spark, folder), work, "6 hours", "2 days")
    assert late.count() == 0
    whole = timeline.events(spark.createDataFrame(photos, SCHEMA), "6 hours")
    shown = lambda df: sorted((r["id"], r["end"], r["photo_count"], tuple(r["photos"]), r["cover"]) for r in df.collect())
    open_ = set(shown(whole)) - set(shown(found))
    assert set(shown(found)) <= set(shown(whole)) and open_
    late_row = ("/late", start - datetime.timedelta(days=9), False)
    feed(spark, folder, [late_row])
    feed(spark, folder, [(None, datetime.datetime.fromisoformat(live.SENTINEL), None)])
    found, late = live.run_events(source(spark, folder), work, "6 hours", "2 days")
    assert shown(found) == shown(whole) and [tuple(r) for r in late.collect()] == [late_row]


def test_each_path_once(spark, tmp_path):
    schema, folder = "path string, part long", str(tmp_path / "in")
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(broken):
        def work(rows: pd.DataFrame) -> pd.DataFrame:
            if rows["path"].iloc[0] in broken:
                raise ValueError("no decoder")
            return pd.DataFrame({"path": rows["path"], "part": rows["part"], "twice": rows["part"] * 2})

        stream = visited.visit(source(spark, folder, schema), work, "path string, part long, twice long")
        return visited.drain(stream, target, checkpoint)

    feed(spark, folder, [("a", 1), ("a", 2), ("b", 3)], schema)
    log = run({"b"})
    assert sorted((r["path"], r["part"], r["twice"]) for r in visited.finished(log).collect()) == [("a", 1, 2), ("a", 2, 4)]
    assert [(r["path"], r["error"]) for r in visited.open_failures(log).collect()] == [("b", "ValueError: no decoder")]
    feed(spark, folder, [("a", 9), ("b", 3), ("c", 4)], schema)  # a was visited; b is tried again, with its row once
    log = run({"c"})
    assert [(r["path"], r["tries"]) for r in visited.open_failures(log).collect()] == [("c", 1)]
    feed(spark, folder, [("b", 3), ("c", 5)], schema)
    log = run(set())
    want = [("a", 1, 2), ("a", 2, 4), ("b", 3, 6), ("c", 4, 8), ("c", 5, 10)]
    assert sorted((r["path"], r["part"], r["twice"]) for r in visited.finished(log).collect()) == want
    assert visited.open_failures(log).count() == 0


def test_sessions_fold_late_rows_without_the_driver(spark, tmp_path):
    """Rows in any order over several batches; no table of the session's memory is made."""
    start = datetime.datetime(2024, 1, 1)
    at = [0, 360, 721, 5000, 5300, 9000, 800, 4700, 360]  # minutes; 800 and 4700 are late, 360 comes twice
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    before = {t.name for t in spark.catalog.listTables()}
    for i in range(0, 9, 3):
        rows = [(u, start + datetime.timedelta(minutes=m)) for m in at[i:i + 3] for u in (1, 2)]
        feed(spark, folder, [*rows, (3, None)], "user long, ts timestamp_ntz")
        found = logs.fold_sessions(source(spark, folder, "user long, ts timestamp_ntz"), "user", "ts", "6 hours", work)
    minutes = lambda t: (t - start).total_seconds() / 60
    got = sorted((r["user"], minutes(r["start"]), minutes(r["end"]), r["n"]) for r in found.collect())
    assert got == [(u, *s) for u in (1, 2) for s in ((0, 360, 3), (721, 800, 2), (4700, 5300, 3), (9000, 9000, 1))]
    assert {t.name for t in spark.catalog.listTables()} == before
