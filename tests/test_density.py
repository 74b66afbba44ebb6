"""Neighbours and density clusters against all pairs."""

import numpy as np
import pandas as pd
import pytest

from shoebox.operators import cluster, density, graph


def tight(groups, each, dims, spread, seed=0):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(groups, dims)), each, axis=0) + spread * rng.normal(size=(groups * each, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, ids, x, more=()):
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x)] + list(more)
    return spark.createDataFrame(rows, f"id {'string' if isinstance(ids[0], str) else 'long'}, vector array<double>").repartition(5)


def plain_dbscan(ids, x, eps, least):
    """Labels by definition: clusters numbered by smallest core id, border points to the lowest number."""
    order = np.argsort(np.asarray(ids), kind="stable")
    ids, near = [ids[i] for i in order], 1 - x[order] @ x[order].T <= eps
    core = near.sum(1) >= least
    label, n = np.full(len(ids), -1), 0
    for i in range(len(ids)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], n
            while stack:
                for k in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[k] = n
                    stack.append(k)
            n += 1
    for i in np.flatnonzero(~core):
        found = label[near[i] & core]
        label[i] = found.min() if len(found) else -1
    return dict(zip(ids, label.tolist()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbours(spark, kind):
    x = tight(30, 40, 24, 0.3)
    ids = [f"p{i:04d}" for i in range(len(x))] if kind == "string" else list(range(len(x)))
    odd = [("none" if kind == "string" else -1, None), ("nan" if kind == "string" else -2, [float("nan")] * 24)]
    meter = spark.sparkContext.accumulator(0)
    found = density.neighbours(frame(spark, ids, x, odd), 0.1, meter).collect()
    i, j = np.nonzero(1 - x @ x.T <= 0.1)
    want = {(ids[a], ids[b]) for a, b in zip(i, j) if a != b}
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want
    assert meter.value < 0.1 * len(x) ** 2  # clustered vectors: below a tenth of all pairs


def test_neighbours_of_longer_vectors_and_none(spark):
    """Vectors that are no unit vectors are compared by 1 - dot product all the same."""
    x = tight(5, 20, 8, 0.3) * np.linspace(0.5, 2.0, 100)[:, None]
    found = {(r["a"], r["b"]) for r in density.neighbours(frame(spark, list(range(100)), x), 0.4).collect()}
    i, j = np.nonzero(1 - x @ x.T <= 0.4)
    assert found == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    empty = spark.createDataFrame([], "id long, vector array<double>")
    assert density.neighbours(empty, 0.4).count() == 0 and density.dbscan(empty, 0.4, 3).count() == 0


@pytest.mark.parametrize(("spread", "eps", "least"), [(0.3, 0.1, 4), (0.5, 0.15, 5), (0.5, 0.12, 1)])
def test_dbscan(spark, spread, eps, least):
    x = tight(12, 25, 16, spread, seed=3)
    x = np.vstack([x, x[:40:4], x[:1]])
    ids = [f"q{(i * 37) % len(x):04d}" for i in range(len(x))]
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(frame(spark, ids, x, [("none", None)]), eps, least).collect()}
    assert got.pop("none") == -1
    assert got == plain_dbscan(ids, x, eps, least)


def test_copies_cost_rows_not_pairs(spark, monkeypatch):
    """20,000 copies of one vector: every table written stays in proportion to the rows."""
    x = tight(4, 60, 16, 0.3)
    x = np.vstack([np.repeat(x[:1], 20_000, axis=0), x[1:]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vector": [v.tolist() for v in x]})).repartition(4)
    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda rows: written.append(keep(rows)) or written[-1])
    got = {r["cluster"]: r["count"] for r in cluster.dbscan(df, 0.1, 4).groupBy("cluster").count().collect()}
    assert got[0] == 20_000 + 59 and sum(got.values()) == len(x)
    assert sum(t.count() for t in written) < len(x)


def test_spanning():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        i, j = rng.integers(0, n, (2, int(rng.integers(0, 50))))
        label = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j):
                label[a] = label[b] = min(label[a], label[b])
        assert density.spanning(n, i, j).tolist() == label.tolist()


def test_vectors_without_structure_meet_in_few_copies(spark, monkeypatch):
    """Random vectors in reach of nearly all cells: no table holds a vector more often than blocks of all pairs need."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, list(range(len(x))), x)
    monkeypatch.setattr(density, "BLOCK", 512)
    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda rows: written.append(keep(rows)) or written[-1])
    near = (1 - x @ x.T <= 0.62) & ~np.eye(len(x), dtype=bool)
    assert {(r["a"], r["b"]) for r in density.neighbours(df, 0.62).collect()} == set(zip(*(k.tolist() for k in np.nonzero(near))))
    assert {r["id"] for r in density.core(df, 0.62, 3).collect()} == set(np.flatnonzero(near.sum(1) + 1 >= 3).tolist())
    assert {r["id"]: r["cluster"] for r in density.dbscan(df, 0.62, 3).collect()} == plain_dbscan(list(range(len(x))), x, 0.62, 3)
    assert max(t.count() for t in written if "vector" in t.columns) <= 2 * len(x)


def test_core_is_core_points(spark):
    x = tight(12, 25, 16, 0.5, seed=3)
    df = frame(spark, list(range(len(x))), x)
    for least in (1, 2, 5):
        want = {r["id"] for r in density.core_points(density.neighbours(df, 0.12), least).collect()}
        assert {r["id"] for r in density.core(df, 0.12, least).collect()} == want
