"""Optimistic commits of overlay edits, and snapshots."""

import threading

import pytest

from shoebox.operators import overlay
from shoebox.sources import commits


def shown(rows):
    return sorted((r["id"], r["path"], r["value"]) for r in rows.collect())


def named(spark, who, name):
    return lambda events: overlay.name_events(spark, {who: name}, 0)


def merging(sources, target):
    def edit(events):
        merges = overlay.log_state(events, "merge").selectExpr("id as src", "value as dst")
        return overlay.merge_events(merges, overlay.log_state(events, "name").selectExpr("id", "value as name"), sources, target, 0)
    return edit


def test_conflicts(spark, tmp_path):
    """A writer that is overtaken works its edit out anew; a merge that became a circle is refused."""
    log = commits.OverlayLog(spark, str(tmp_path / "log"))
    met = []

    def overtaken(events):
        if not met:
            met.append(commits.OverlayLog(spark, str(tmp_path / "log")).commit(merging(["b"], "a")))
        return merging(["a"], "b")(events)

    assert log.commit(overtaken) is None and met == [1]
    assert shown(log.state("merge")) == [("b", None, "a")]
    met.clear()

    def both(events):
        if not met:
            met.append(log.commit(named(spark, "a", "Ann")))
        return merging(["c"], "b")(events)

    assert log.commit(both) == 3 and met == [2]
    assert shown(log.state("merge")) == [("b", None, "a"), ("c", None, "a")]
    assert shown(log.state("name")) == [("a", None, "Ann"), ("c", None, "Ann")]  # the source takes the end's name
    assert shown(log.state("name", upto=1)) == [] and log.commit(named(spark, "", "x")) is None


def test_writers_at_once(spark, tmp_path):
    root, failed = str(tmp_path / "log"), []

    def write(i):
        try:
            commits.OverlayLog(spark, root).commit(named(spark, f"face_{i}", f"N{i}"))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = commits.OverlayLog(spark, root)
    assert not failed and log.latest() == 5 and [v for _, _, v in shown(log.state("name"))] == [f"N{i}" for i in range(5)]
    assert log._put(5, {}) is False


def test_snapshot_equals_the_whole_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 3)
    log = commits.OverlayLog(spark, str(tmp_path / "log"))
    steps = [named(spark, "a", "A"), named(spark, "b", "B"), named(spark, "a", ""), merging(["x"], "b"), lambda e: overlay.clear_events(spark, "merge", ["x"], 0), named(spark, "c", "C"), named(spark, "b", "B2")]
    for step in steps:
        log.commit(step)
    assert log._snapshots() == [3, 6]
    table = spark.createDataFrame([(i, "remove", f"face_{i % 3}", f"/p{i}", "1" if i % 2 else None) for i in range(50)], commits.EVENTS)
    assert log.commit_table(table) == 8
    with_snapshots = {e: shown(log.state(e)) for e in ("name", "merge", "remove")}
    monkeypatch.setattr(commits.OverlayLog, "_snapshots", lambda self: [])
    assert with_snapshots == {e: shown(log.state(e)) for e in ("name", "merge", "remove")}
    assert with_snapshots["name"] == [("b", None, "B2"), ("c", None, "C"), ("x", None, "B")] and with_snapshots["merge"] == [] and len(with_snapshots["remove"]) == 25


def test_empty_log(spark, tmp_path):
    log = commits.OverlayLog(spark, str(tmp_path / "none"))
    assert log.latest() == 0 and log.read().count() == 0 and log.snapshot() == 0
    with pytest.raises(RuntimeError):
        monkey = iter(range(100))
        log._put = lambda *_: next(monkey) < 0
        log.commit(named(spark, "a", "A"), tries=2)
