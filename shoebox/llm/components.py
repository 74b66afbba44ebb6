"""Connected components of an edge table, as iterated star contractions on the cluster.

The driver sees two numbers a round, never links or components.  Rounds are cut by tables in
the shared folder; a superseded round is deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import discard, materialize


class UnionFind:
    """Components over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def root(self, i: int) -> int:
        parent, top = self.parent, i
        while parent[top] != top:
            top = parent[top]
        while parent[i] != top:
            parent[i], i = top, parent[i]
        return int(top)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up


#: Edges reduced at once by one task.
FOREST_ROWS = 200_000


def _forests(batches):
    """Replace every bounded run of edges by a star forest with the same components."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def reduced():
        table = pa.Table.from_batches(held)
        a, b = (np.asarray(table[c]) for c in ("a", "b"))
        nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = UnionFind(len(nodes))
        left, right = codes[: len(a)].tolist(), codes[len(a):].tolist()
        for i, j in zip(left, right):
            forest.join(i, j)
        root = forest.labels()
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FOREST_ROWS:
            yield reduced()
            held, rows = [], 0
    if rows:
        yield reduced()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` long, any direction, repeats and loops allowed.

    Returns ``(node, component)``: every node with another node in its component, labelled by the
    component's smallest node.  An empty input gives an empty result; null ends are ignored.
    """
    both = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    # a round's tables are small against the documents: as many files as cores write them
    narrow = lambda df: df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    state = materialize(
        narrow(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where(both).mapInArrow(_forests, "a long, b long").distinct()),
        "edges",
    )
    before = _fingerprint(state)
    while before[0]:
        around = state.union(state.select("b", "a"))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = materialize(
            narrow(around.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()),
            "large",
        )
        # after the first half every edge runs from a larger to a smaller node
        least_of = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least_of, "a").select(
            F.inline(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            ))
        )
        after_df = materialize(narrow(small.where(F.col("a") != F.col("b")).distinct()), "edges")
        after = _fingerprint(after_df)
        for done in (state, large):
            discard(done)
        state = after_df
        if after == before:
            break
        before = after
    tops = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
