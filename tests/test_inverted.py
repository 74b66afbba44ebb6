"""Branch and bound over an inverted file against all pairs."""

import numpy as np
import pytest
from test_density import frame, tight

from pyspark.sql import functions as F

from shoebox.operators import cluster, density, graph, inverted


def targets_of(spark, x, kind):
    rows = [(f"t{i:05d}" if kind == "string" else i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (None, None)], f"target {kind}, vector array<double>").repartition(3)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest(spark, kind):
    x = tight(40, 30, 16, 0.2, seed=8)
    x = np.vstack([x, x[:5]])  # ties: the smaller target wins
    q = np.vstack([tight(40, 5, 16, 0.2, seed=8), 3 * x[:4]])
    items = frame(spark, list(range(len(q))), q, [(-1, None)])
    file = inverted.build(targets_of(spark, x, kind))
    meter = spark.sparkContext.accumulator(0)
    got = {r["id"]: (r["target"], round(r["similarity"], 9)) for r in inverted.nearest(items, file, meter).collect()}
    scores = q @ x.T
    want = {i: (int(np.flatnonzero(s >= s.max() - 1e-12)[0]), round(float(s.max()), 9)) for i, s in enumerate(scores)}
    assert got == {i: (f"t{t:05d}" if kind == "string" else t, s) for i, (t, s) in want.items()}
    assert meter.value < 0.5 * len(q) * len(file.centres)  # more than half of the lists stay closed


def test_equal_at_any_size(spark, monkeypatch):
    x = tight(10, 20, 8, 0.6, seed=9)
    items, targets = frame(spark, list(range(60)), tight(6, 10, 8, 0.6, seed=10)), targets_of(spark, x, "long")
    few = sorted(map(tuple, cluster.nearest(items, targets).collect()))
    monkeypatch.setattr(cluster, "SMALL_SIDE", 0)
    many = sorted(map(tuple, cluster.nearest(items, targets).collect()))
    assert [r[:2] for r in few] == [r[:2] for r in many] and np.allclose([r[2] for r in few], [r[2] for r in many])


def test_top_k(spark):
    x = tight(50, 20, 16, 0.2, seed=11)
    file = inverted.build(targets_of(spark, x, "long"))
    scores = x @ x[17]
    for k in (1, 10, 35):
        found, read = inverted.top_k(file, x[17].tolist(), k)
        order = sorted(range(len(x)), key=lambda i: (-scores[i], i))[:k]
        assert [r["target"] for r in found.orderBy(found.similarity.desc(), "target").collect()] == order
        assert read < len(file.centres)
    assert inverted.top_k(file, x[17].tolist(), 5000)[0].count() == int((scores > 0).sum())


def test_no_targets(spark):
    empty = spark.createDataFrame([], "target long, vector array<double>")
    items = frame(spark, [1], np.ones((1, 3)))
    assert inverted.nearest(items, inverted.build(empty)).count() == 0 and cluster.nearest(items, empty).count() == 0
    assert inverted.top_k(inverted.build(empty), [1.0, 0.0, 0.0], 3)[0].count() == 0


def test_blocks_deal_by_a_column(spark):
    """Members without an id are dealt to blocks of bounded size by the column named, and meet each guest once."""
    rows = spark.range(600).select(F.when(F.col("id") < 200, F.col("id")).alias("id"), F.col("id").alias("key"), F.lit(0).alias("cell"), F.lit(0).alias("ring"), (F.col("id") < 200).alias("guest"))
    met = density.blocks(rows, 100, deal="key").groupBy("m", "g").agg(F.count_if("guest").alias("guests"), F.count_if(~F.col("guest")).alias("members")).collect()
    assert len(met) == 8 and max(r["members"] for r in met) < 160 and sum(r["guests"] * r["members"] for r in met) == 200 * 400


def test_items_that_open_many_lists_meet_targets_in_blocks(spark, monkeypatch):
    """Items near a list's centre go by lists, those without structure by blocks; no table holds an item once a list."""
    x = tight(40, 40, 32, 0.1, seed=12)
    rng = np.random.default_rng(13)
    q = np.vstack([x[::40] * 2, rng.normal(size=(500, 32))])
    file = inverted.build(targets_of(spark, x, "string"))
    monkeypatch.setattr(density, "FEW_GUESTS", 4)
    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda rows: written.append(keep(rows)) or written[-1])
    got = {r["id"]: r["target"] for r in inverted.nearest(frame(spark, list(range(len(q))), q, [(-1, None)]), file).collect()}
    assert got == {i: f"t{t:05d}" for i, t in enumerate((q @ x.T).argmax(1))}
    assert max(t.count() for t in written if "vector" in t.columns) <= len(q)


@pytest.mark.parametrize("small", [1 << 30, 0])
def test_copies_of_a_target_tie(spark, monkeypatch, small):
    """The smallest of a target's copies is found wherever a matrix product rounds them."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1009, 64)).astype(np.float32).astype(float)
    x = np.vstack([x, x, x[:501]])
    q = rng.normal(size=(777, 64))
    monkeypatch.setattr(cluster, "SMALL_SIDE", small)
    got = {r["id"]: (r["target"], r["similarity"]) for r in cluster.nearest(frame(spark, list(range(len(q))), q), targets_of(spark, x, "long")).collect()}
    exact = np.zeros((len(q), 1009))
    for d in range(64):
        exact += np.outer(q[:, d], x[:1009, d])
    assert got == {i: (int(s.argmax()), s.max()) for i, s in enumerate(exact)}


def test_winners_hold_few_products(monkeypatch):
    rng = np.random.default_rng(15)
    x, y = rng.normal(size=(50, 8)), rng.normal(size=(300, 8))
    want = inverted.winners(x, y)
    monkeypatch.setattr(inverted, "PRODUCTS", 1000)
    at, score = inverted.winners(x, y)
    assert (at == want[0]).all() and (score == want[1]).all() and (at == (x @ y.T).argmax(1)).all()


@pytest.mark.parametrize("name", ["label_propagation", "propagation_totals"])
def test_query_is_the_same_through_the_inverted_file(spark, monkeypatch, name):
    from shoebox.plans import catalogue

    want = sorted(map(tuple, catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").collect()), key=str)
    monkeypatch.setattr(cluster, "SMALL_SIDE", 0)
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").collect()), key=str) == want
