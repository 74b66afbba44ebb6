"""Selection by rank against sorting, at every border."""

import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators import cluster, ranks


@pytest.mark.parametrize("few", [ranks.FEW, 3])
def test_first_by_digest(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "DIGITS", 1)
    pick = random.Random(1)
    rows = [(i, f"{pick.choice([0, 1, 255, 256, pick.randint(0, 16**4 - 1)]):04x}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, h string").repartition(5)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for k in (0, 1, 2, 57, 150, 399, 400, 500):
        got = ranks.first_by_digest(df, k, F.col("h"), "id").collect()
        assert sorted(map(tuple, got)) == sorted(order[:k]), k


def test_between(spark):
    rows = [(i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(4)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for first, size in [(0, 0), (0, 1), (0, 300), (10, 24), (290, 24), (299, 1), (300, 5), (120, 100)]:
        got = ranks.between(df, [F.desc("v"), F.asc("id")], first, size).collect()
        assert sorted(map(tuple, got)) == sorted(order[first:first + size])


def test_sample_moves_no_rows_to_one_task(spark):
    df = spark.range(50_000).repartition(8)
    sample = cluster.seeded_sample(df, 0.4, "s")
    assert sample.count() == 20_000
    want = {r["id"] for r in df.orderBy(F.md5(F.concat(F.lit("s"), F.col("id").cast("string"))), "id").limit(20_000).collect()}
    assert {r["id"] for r in sample.collect()} == want
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrdered") <= 1 and "SinglePartition" not in plan
    assert cluster.seeded_sample(df.limit(0), 0.4, "s").count() == 0
