"""Exact selection by rank without passing the chosen rows through one task."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import graph

#: Hexadecimal digits by which a histogram is refined: 16**DIGITS counts are collected at most.
DIGITS = 4
#: Rows of one bucket that are few enough to be sorted together.
FEW = 10_000


def first_by_digest(rows: DataFrame, k: int, digest: Column, *ties: str) -> DataFrame:
    """The ``k`` rows with the smallest hexadecimal digest; equal digests go by ``ties``.

    Buckets of leading digits are counted, and the one that holds the k-th row is counted again by
    its next digits, until it is small.  Rows before it are kept by a filter and do not move.
    """
    keyed = rows.withColumn("_digest", digest)
    if k <= 0:
        return rows.limit(0)
    before, prefix, left = [], "", k
    while True:
        width = len(prefix) + DIGITS
        here = keyed.where(F.startswith("_digest", F.lit(prefix))) if prefix else keyed
        counts = here.groupBy(F.substring("_digest", 1, width).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # 16**DIGITS rows at most
        low = prefix
        for r in counts:
            if r["n"] >= left:
                break
            left -= r["n"]
        else:
            # fewer rows than asked for
            before.append(F.startswith("_digest", F.lit(low)))
            left = 0
            break
        before.append((F.substring("_digest", 1, width) < r["p"]) & F.startswith("_digest", F.lit(low)))
        prefix = r["p"]
        if r["n"] == left:
            before.append(F.startswith("_digest", F.lit(prefix)))
            left = 0
            break
        if r["n"] <= FEW or len(prefix) < width:
            break
    kept = keyed.where(functools.reduce(lambda a, b: a | b, before))
    if left:
        kept = kept.unionByName(keyed.where(F.startswith("_digest", F.lit(prefix))).orderBy("_digest", *ties).limit(left))
    return kept.drop("_digest")


def between(rows: DataFrame, order: list[Column], first: int, size: int) -> DataFrame:
    """Rows ``first .. first + size - 1`` in ``order``, which has to be total; as a set.

    Rows are dealt out by ranges and the ranges counted; only the ranges that the first and the last
    row fall into are numbered, each in its own task.
    """
    if size <= 0:
        return rows.limit(0)
    dealt = graph.materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())  # one row a range
    whole, cut, at = [], [], 0
    for part, n in sizes:
        low, high = max(0, first - at), min(n, first + size - at)
        if low == 0 and high == n:
            whole.append(part)
        elif low < high:
            cut.append((part, low, high))
        at += n
    kept = dealt.where(F.col("_part").isin(whole))
    for part, low, high in cut:
        place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
        numbered = dealt.where(F.col("_part") == part).withColumn("_place", place)
        kept = kept.unionByName(numbered.where((F.col("_place") > low) & (F.col("_place") <= high)).drop("_place"))
    return kept.drop("_part")
