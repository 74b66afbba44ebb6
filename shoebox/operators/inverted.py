"""Maximum inner product search over a stored inverted file, by branch and bound.

Targets lie in lists around centres, each list with its radius.  A target of a list scores at most
the centre's score plus the query's length times the radius, so lists are opened in the order of that
bound, and those whose bound is below the best score so far are never opened.  Many items are
searched in rounds: each opens its next lists, twice as many as before, and leaves the search once
its next bound cannot win.  Items that so many lists could still win after the first that visits
would be more copies than blocks of all pairs need meet all targets in such blocks.  Results are
exact; ties go to the smaller target, also among copies of one vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import vectors
from . import density, graph

#: Lists at most; their centres and radii are all that a task holds of the targets at once.
LISTS = 2048
#: Rounding margin of a bound.
MARGIN = 1e-9
BLOCK = 2048
#: Products held at a time.
PRODUCTS = 1 << 21


def winners(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``y`` with the highest dot product, that product) for each row of ``x``; the first of equal ones.

    A matrix product rounds by its place, so copies of one vector may differ in the last digits.  Rows
    within that rounding are summed again, component by component, and only those sums are compared.
    """
    at, score = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    longest = np.sqrt((y * y).sum(1).max())
    step = max(1, PRODUCTS // len(y))
    for low in range(0, len(x), step):
        part = x[low:low + step]
        products = part @ y.T
        margin = 4 * x.shape[1] * np.finfo(np.float64).eps * longest * np.sqrt((part * part).sum(1))
        # not below, so that every row keeps one
        i, j = np.nonzero(~(products < (products.max(1) - margin)[:, None]))
        exact = np.zeros(len(i))
        for d in range(x.shape[1]):
            exact += part[i, d] * y[j, d]
        order = np.lexsort((j, -exact, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        at[low:low + step], score[low:low + step] = j[first], exact[first]
    return at, score


@dataclass
class InvertedFile:
    """``rows(list, target, vector, first)`` stored by list, and the lists' centres and radii.

    ``first`` is false for a target with a smaller one of the same vector in its list.
    """

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The most that any target of each list can score, for each query."""
        return x @ self.centres.T + np.sqrt((x * x).sum(1))[:, None] * self.radii[None] + MARGIN


def build(targets: DataFrame, lists: int = LISTS) -> InvertedFile:
    """The inverted file of ``targets(target, vector)``; targets without a sound vector are left out."""
    rows = graph.materialize(density.sound(targets.withColumnRenamed("target", "id")))
    kind = rows.schema["id"].dataType
    centres = density.choose_pivots(rows, 0.0, most=lists)
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("target", kind), T.StructField("vector", rows.schema["vector"].dataType), T.StructField("away", T.DoubleType())])

    def place(batches):
        c = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(low, BLOCK)
                x = density.matrix(batch.column("vector"))
                square = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
                home = square.argmin(1)
                away = np.sqrt(((x - c[home]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), batch.column("id"), batch.column("vector"), pa.array(away)], names=schema.names)

    path = graph.work_folder(rows.sparkSession, "inverted")
    # within the tasks that hold the lists anyway
    same = Window.partitionBy("list", F.xxhash64("vector"), "vector")
    marked = rows.mapInArrow(place, schema).repartition("list").withColumn("first", F.min("target").over(same) == F.col("target"))
    marked.write.partitionBy("list").parquet(path)
    stored = rows.sparkSession.read.schema("target {}, vector array<double>, away double, first boolean, list int".format(kind.simpleString())).parquet(path)
    radii = np.zeros(len(centres))
    for r in stored.groupBy("list").agg(F.max("away").alias("radius")).collect():  # one row a list
        radii[r["list"]] = r["radius"]
    return InvertedFile(stored.select("list", "target", "vector", "first"), centres, radii)


def nearest(items: DataFrame, file: InvertedFile, meter=None) -> DataFrame:
    """``(id, target, similarity)``: the target with the highest dot product; ties to the smaller one.

    Items without a sound vector are left out.  ``meter``, an accumulator, counts the lists opened.
    """
    rows = density.sound(items)
    spark, kind, key = items.sparkSession, rows.schema["id"].dataType, file.rows.schema["target"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("target", key), T.StructField("similarity", T.DoubleType())])
    if not len(file.centres):
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast((file.centres, file.radii))
    visit = T.StructType([T.StructField("id", kind), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType())])

    def opened(first: int, last: int):
        """Visits of the lists at places first..last of each item's order, as far as they can win."""
        def run(batches):
            lists = InvertedFile(None, *shared.value)
            for whole in batches:
                for low in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(low, BLOCK)
                    bound = lists.bounds(density.matrix(batch.column("vector")))
                    best = np.asarray(batch.column("similarity").fill_null(-np.inf))
                    order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    item, place = np.nonzero(np.take_along_axis(bound, order, 1) >= best[:, None])
                    if meter is not None:
                        meter.add(len(item))
                    for start in range(0, len(item), BLOCK):  # a batch that opens many lists leaves in pieces
                        some = slice(start, start + BLOCK)
                        at = pa.array(item[some])
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("vector").take(at), pa.array(order[item[some], place[some]], pa.int32())], names=visit.names)
        return run

    def open_still(batches):
        lists = InvertedFile(None, *shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(low, BLOCK)
                bound = lists.bounds(density.matrix(batch.column("vector")))
                best = np.asarray(batch.column("similarity").fill_null(-np.inf))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((bound >= best[:, None]).sum(1).astype(np.int32))], names=[*batch.schema.names, "lists"])

    def compare(table: pa.Table) -> pa.Table:
        guest = np.asarray(table["guest"].combine_chunks(), dtype=bool)
        guests, members = table.filter(pa.array(guest)), table.filter(pa.array(~guest)).sort_by("target")
        if not guests.num_rows or not members.num_rows:
            return pa.table({"id": guests["id"][:0], "target": members["target"][:0], "similarity": pa.array([], pa.float64())})
        top, score = winners(density.matrix(guests["vector"].combine_chunks()), density.matrix(members["vector"].combine_chunks()))
        return pa.table({"id": guests["id"], "target": members["target"].take(pa.array(top)), "similarity": score})

    def met(guests: DataFrame, members: DataFrame, **how) -> DataFrame:
        return density.blocks(guests.unionByName(members), deal="deal", **how).groupBy(*density.KEY).applyInArrow(compare, out)

    best = F.min_by(F.struct("target", "similarity"), F.struct((-F.col("similarity")).alias("s"), "target")).alias("b")
    side = lambda rows, cell, guest: rows.select(
        (F.col("id") if guest else F.lit(None).cast(kind)).alias("id"), (F.lit(None).cast(key) if guest else F.col("target")).alias("target"), "vector",
        cell.alias("cell"), F.lit(0).alias("ring"), F.lit(guest).alias("guest"), F.xxhash64("id" if guest else "target").alias("deal"),
    )
    targets = file.rows.where("first")
    members = side(targets, F.col("list"), False)
    state = graph.materialize(rows.select("id", "vector", F.lit(None).cast(key).alias("target"), F.lit(None).cast("double").alias("similarity")))
    settled, first, width = None, 0, 1
    while first < len(file.centres):
        visits = graph.materialize(state.select("id", "vector", "similarity").mapInArrow(opened(first, first + width), visit))
        if visits.isEmpty():
            break
        found = met(side(visits, F.col("list"), True), members.join(visits.select(F.col("list").alias("cell")).distinct(), "cell", "left_semi"))
        scored = found.unionByName(state.where("target is not null").select("id", "target", "similarity")).groupBy("id").agg(best).select("id", "b.*")
        after = state.select("id", "vector").join(scored, "id", "left")
        if first == 0:
            # the first lists gave every item a score; where that closes few of the others, all pairs are compared
            after = graph.materialize(after.mapInArrow(open_still, T.StructType([*state.schema, T.StructField("lists", T.IntegerType())])))
            n = targets.count()
            block = density.wide_block(n + state.count())
            few = F.col("lists") <= max(density.FEW_GUESTS, 2 * n / block)
            wide = after.where(~few).select("id", "vector")
            if not wide.isEmpty():
                settled = graph.materialize(met(side(wide, F.lit(0), True), side(targets, F.lit(0), False), block=block, many=False).groupBy("id").agg(best).select("id", "b.*"))
            after = after.where(few).drop("lists")
        else:
            after = graph.materialize(after)
        # who opened no list in this round has no bound left that could win
        done = after.join(visits.select("id").distinct(), "id", "left_anti").select("id", "target", "similarity")
        settled = done if settled is None else settled.unionByName(done)
        state = after.join(visits.select("id").distinct(), "id", "left_semi")
        first, width = first + width, width * 2
    every = state.select("id", "target", "similarity")
    every = every if settled is None else settled.unionByName(every)
    return every.where("target is not null")


def top_k(file: InvertedFile, query: list[float], k: int, least: float = 0.0) -> tuple[DataFrame, int]:
    """``(target, similarity)`` of the ``k`` targets with the highest dot product above ``least``, and the lists read.

    Lists are read in the order of their bounds, twice as many each time, until the k-th score so far
    exceeds the next bound.  Reading a list is reading its folder.  Ties go to the smaller target.
    """
    x = np.asarray(query, dtype=np.float64)
    bound = file.bounds(x[None])[0] if len(file.centres) else np.zeros(0)
    order = np.argsort(-bound, kind="stable")
    score = vectors.dot(F.col("vector"), F.array(*[F.lit(float(v)) for v in x]))
    spark = file.rows.sparkSession
    kept = spark.createDataFrame([], T.StructType([file.rows.schema["target"], T.StructField("similarity", T.DoubleType())]))
    first, width, floor = 0, 1, -np.inf
    while first < len(order) and bound[order[first]] >= floor:
        some = [int(i) for i in order[first:first + width]]
        rows = file.rows.where(F.col("list").isin(some)).select("target", score.alias("similarity"))
        # k rows, however many targets the lists hold
        best = kept.union(rows.where(F.col("similarity") > least)).orderBy(F.desc("similarity"), "target").limit(k).collect()
        kept = spark.createDataFrame(best, kept.schema)
        floor = best[-1]["similarity"] if len(best) == k else max(least, -np.inf)
        first, width = first + width, width * 2
    return kept, min(first, len(order))
