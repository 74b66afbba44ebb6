"""Neighbours within a distance, and density clusters, through an index of pivots.

Vectors go to the cell of their nearest pivot; a cell is cut into rings by the distance to its pivot,
each as wide as the search radius.  By the triangle inequality a vector's neighbours lie in cells
whose border it is near enough to, and there in the three rings around its own distance to that
pivot.  So a vector is a member of one ring and a guest of few, and only guests and members of one
ring are compared, in blocks of bounded size.  Pivots decide how much is compared, never the result.
Where a sample shows that vectors would be guests of most cells, there are no cells: all pairs are
compared, block by block.

Density clusters need no list of pairs: counts are summed by point, links leave a task as spanning
forests, and equal vectors are one point with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import vectors
from . import graph

#: Vectors that pivots are chosen from, and pivots at most.
FIT_ROWS, PIVOTS = 32_768, 2048
#: Members, and guests, of one ring that meet in a task at once.
BLOCK = 2048
#: Without cells: members of a block at most, and the blocks that rows are dealt to while they are smaller.
WIDE_BLOCK, SPREAD = 16_384, 12
#: Guest rows of a vector up to which cells are used, however few the blocks would be.
FEW_GUESTS = 32
#: Products held at a time.
PRODUCTS = 1 << 23
#: What a block is known by.
KEY = ("cell", "ring", "m", "g")


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sound(items: DataFrame) -> DataFrame:
    """``(id, vector)`` without null vectors and vectors with null or NaN components."""
    vector = vectors.doubles(F.col("vector"))
    return items.select("id", vector.alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def choose_pivots(rows: DataFrame, radius: float, fit_rows: int = FIT_ROWS, most: int = PIVOTS) -> np.ndarray:
    """Vectors of a bounded random sample, each the farthest from those before it.

    As many as the root of the rows, or until all of the sample is within half of ``radius``.
    """
    n = rows.count()
    drawn = rows.select("vector", "id").orderBy(F.xxhash64(F.col("id"), F.lit(5)), "id").limit(fit_rows) if n > fit_rows else rows
    x = matrix(drawn.select("vector").toArrow()["vector"].combine_chunks())
    if not len(x):
        return x
    apart = ((x - x.mean(0)) ** 2).sum(1)
    chosen = []
    for _ in range(min(most, len(x), math.isqrt(n) + 1)):
        at = int(apart.argmax())
        if chosen and apart[at] <= (radius / 2) ** 2:
            break
        chosen.append(at)
        near = ((x - x[at]) ** 2).sum(1)
        apart = near if len(chosen) == 1 else np.minimum(apart, near)
    return x[chosen]


def radius_of(rows: DataFrame, eps: float) -> float:
    """The Euclidean distance that no two rows within cosine distance ``eps`` exceed, with a margin for rounding."""
    longest = rows.agg(F.max(vectors.norm(F.col("vector")))).first()[0] or 1.0
    return math.sqrt(max(0.0, 2 * longest * longest - 2 + 2 * eps)) + 1e-6


def wide_block(n: int) -> int:
    """Rows of a block where all pairs of ``n`` rows are compared."""
    return min(WIDE_BLOCK, max(BLOCK, -(-n // SPREAD)))


def useful(drawn: DataFrame, pivots: np.ndarray, radius: float, n: int) -> np.ndarray:
    """The pivots, or none of them where they would make more copies of a vector than blocks of all pairs do."""
    x = matrix(drawn.select("vector").limit(BLOCK).toArrow()["vector"].combine_chunks())
    if not len(x):
        return pivots
    square = np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0)
    home = square.argmin(1)
    between = np.sqrt(np.maximum((pivots * pivots).sum(1)[home][:, None] + (pivots * pivots).sum(1)[None] - 2 * pivots[home] @ pivots.T, 0))
    guests = 3 * (square - square[np.arange(len(x)), home][:, None] <= 2 * between * radius + 1e-9).sum(1).mean()
    return pivots if guests <= max(FEW_GUESTS, 2 * n / wide_block(n)) else pivots[:0]


class Reach:
    """How the rows of one search meet: by the rings of pivots, or all with all in blocks."""

    def __init__(self, rows: DataFrame, eps: float):
        self.eps, self.radius = eps, radius_of(rows, eps)
        pivots = choose_pivots(rows, self.radius)
        self.empty = not len(pivots)
        self.rows = 0 if self.empty else rows.count()
        self.pivots = pivots if self.empty else useful(rows, pivots, self.radius, self.rows)
        self.block = BLOCK if len(self.pivots) else wide_block(self.rows)

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows(id, vector, ...)`` as members and as guests, with ``cell, ring, guest``."""
        if len(self.pivots):
            return placed(rows, self.pivots, self.radius)
        sides = F.explode(F.array(F.lit(False), F.lit(True))).alias("guest")
        return rows.select("*", F.lit(0).alias("cell"), F.lit(0).alias("ring"), sides)

    def blocks(self, rows: DataFrame) -> DataFrame:
        return blocks(rows, self.block, bool(len(self.pivots)))


def placed(rows: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """``rows(id, vector, ...)`` once as a member of its ring and once as a guest of each ring in reach.

    Adds ``cell, ring, guest``.  Other columns are carried along.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    extra = [c for c in rows.columns if c not in ("id", "vector")]
    schema = T.StructType([*[rows.schema[c] for c in ("id", "vector", *extra)], T.StructField("cell", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("guest", T.BooleanType())])

    def run(batches):
        centres = shared.value
        between = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 0)) if len(centres) <= 256 else np.stack([np.sqrt(((centres - c) ** 2).sum(1)) for c in centres])
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(low, BLOCK)
                x = matrix(batch.column("vector"))
                square = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0)
                home = square.argmin(1)
                own, away = np.arange(len(x)), np.sqrt(square)
                # a neighbour in another cell lies behind the border between the two pivots
                reach = square - square[own, home][:, None] <= 2 * between[home] * radius + 1e-9
                reach[own, home] = True
                row, cell = np.nonzero(reach)
                ring = np.floor(away[row, cell] / radius).astype(np.int64)
                takes = np.concatenate([own, np.repeat(row, 3)])
                cells = np.concatenate([home, np.repeat(cell, 3)])
                rings = np.concatenate([np.floor(away[own, home] / radius).astype(np.int64), (ring[:, None] + np.array([-1, 0, 1])[None]).ravel()])
                guest = np.arange(len(takes)) >= len(x)
                keep = np.flatnonzero(rings >= 0)
                for first in range(0, len(keep), BLOCK):  # a batch in reach of many cells leaves in pieces
                    some = keep[first:first + BLOCK]
                    at = pa.array(takes[some])
                    yield pa.RecordBatch.from_arrays([
                        *[batch.column(c).take(at) for c in ("id", "vector", *extra)],
                        pa.array(cells[some], pa.int32()), pa.array(rings[some], pa.int32()), pa.array(guest[some]),
                    ], names=schema.names)

    return rows.select("id", "vector", *extra).mapInArrow(run, schema)


def blocks(rows: DataFrame, block: int = BLOCK, many: bool = True, deal: str = "id") -> DataFrame:
    """Rows of :func:`placed` with ``m`` and ``g``, so that ``(cell, ring, m, g)`` has bounded members and guests.

    A member is repeated for each block of guests of its ring and the reverse; rings without members
    or without guests of other rows are left out.  ``many`` rings have their sizes joined, a single one's are broadcast.
    ``deal`` names the column whose hash deals rows to blocks.
    """
    sizes = rows.groupBy("cell", "ring").agg(F.count_if(~F.col("guest")).alias("members"), F.count_if("guest").alias("guests")).where("members > 0 and guests > 0")
    counted = sizes.select("cell", "ring", F.ceil(F.col("members") / block).cast("int").alias("ms"), F.ceil(F.col("guests") / block).cast("int").alias("gs"))
    dealt = rows.join(counted if many else F.broadcast(counted), ["cell", "ring"])  # one row
    own = F.xxhash64(F.col(deal), F.lit(9))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    m = F.when(F.col("guest"), every("ms")).otherwise(F.array(F.pmod(own, F.col("ms")).cast("int")))
    g = F.when(F.col("guest"), F.array(F.pmod(own, F.col("gs")).cast("int"))).otherwise(every("gs"))
    return dealt.withColumn("m", F.explode(m)).withColumn("g", F.explode(g)).drop("ms", "gs")


def _sides(table: pa.Table, meter=None) -> tuple[pa.Table, pa.Table]:
    """(guests, members) of one block."""
    guest = np.asarray(table["guest"].combine_chunks(), dtype=bool)
    guests, members = table.filter(pa.array(guest)), table.filter(pa.array(~guest))
    if meter is not None:
        meter.add(guests.num_rows * members.num_rows)
    return guests, members


def _pairs(guests: pa.Table, members: pa.Table, eps: float):
    """(guest and member of each pair in reach, distances), a bounded number of products at a time."""
    if not guests.num_rows or not members.num_rows:
        return
    x, y = matrix(guests["vector"].combine_chunks()), matrix(members["vector"].combine_chunks()).T
    step = max(1, PRODUCTS // members.num_rows)
    for low in range(0, len(x), step):
        distance = x[low:low + step] @ y
        np.subtract(1, distance, out=distance)
        at = np.flatnonzero(distance <= eps)
        i, j = np.divmod(at, distance.shape[1])
        yield i + low, j, distance.ravel()[at]


def neighbours(items: DataFrame, eps: float, meter=None) -> DataFrame:
    """``(a, b, distance)`` of different unit vectors within cosine distance ``eps``, both directions.

    Exact, for ids of any type; null vectors have no neighbours.  ``meter``, an accumulator, counts
    the pairs compared.
    """
    rows = sound(items)
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("distance", T.DoubleType())])
    reach = Reach(rows, eps)
    if reach.empty:
        return items.sparkSession.createDataFrame([], out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guests, members = _sides(pa.Table.from_batches(batches), meter)
        a, b = guests["id"].combine_chunks(), members["id"].combine_chunks()
        for i, j, distance in _pairs(guests, members, eps):
            for low in range(0, len(i), 1 << 18):
                some = slice(low, low + (1 << 18))
                yield pa.RecordBatch.from_arrays([a.take(pa.array(i[some])), b.take(pa.array(j[some])), pa.array(distance[some])], names=out.names)

    met = reach.blocks(graph.materialize(reach.placed(rows))).groupBy(*KEY).applyInArrow(compare, out)
    return met.where("a <> b")


def _codes(guests: pa.Table, members: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """(number of each guest's and then each member's id, ids by number)."""
    coded = pa.concat_arrays([guests["id"].combine_chunks(), members["id"].combine_chunks()]).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def _reached(reach: Reach, dealt: DataFrame, own: bool, meter=None) -> DataFrame:
    """``(id, n)``: weights of the members in a guest's reach, with or without those of its own id."""
    kind, eps = dealt.schema["id"].dataType, reach.eps

    def count(table: pa.Table) -> pa.Table:
        guests, members = _sides(table, meter)
        weight, code = np.asarray(members["weight"]), _codes(guests, members)[0]
        n = np.zeros(guests.num_rows, dtype=np.int64)
        for i, j, _ in _pairs(guests, members, eps):
            if not own:
                other = code[i] != code[guests.num_rows + j]
                i, j = i[other], j[other]
            n += np.bincount(i, weights=weight[j], minlength=len(n)).astype(np.int64)
        met = n > 0
        return pa.table({"id": guests["id"].filter(pa.array(met)), "n": n[met]})

    counts = dealt.groupBy(*KEY).applyInArrow(count, T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType())]))
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def core(items: DataFrame, eps: float, least: int, meter=None) -> DataFrame:
    """``(id)``: :func:`core_points` of :func:`neighbours`, with pairs counted where they are found and none written."""
    rows = sound(items).withColumn("weight", F.lit(1).cast("long"))
    reach = Reach(rows, eps)
    if reach.empty:
        return rows.select("id")
    others = _reached(reach, reach.blocks(graph.materialize(reach.placed(rows))), False, meter)
    return others.where(F.col("n") + 1 >= least).select("id")


def core_points(pairs: DataFrame, least: int) -> DataFrame:
    """Ids with at least ``least`` points in reach, themselves included."""
    return pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select("id")


def spanning(n: int, i: np.ndarray, j: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component, for edges between nodes 0..n-1 besides those that gave ``parent``."""
    parent = np.arange(n) if parent is None else parent.copy()
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def folded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, copies): equal vectors as one point ``(id, vector, weight)`` under their smallest id, and ``(id, point)`` of the others.

    Rows are summed before the shuffle; only vectors that recur are joined back.
    """
    keyed = rows.withColumn("h", F.xxhash64("vector"))
    points = graph.materialize(keyed.groupBy("h", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    again = points.where("weight > 1").select("h", "vector", F.col("id").alias("point"))
    return points.select("id", "vector", "weight"), keyed.join(again, ["h", "vector"]).where("id <> point").select("id", "point")


def dbscan(items: DataFrame, eps: float, least: int, meter=None) -> DataFrame:
    """``(id, cluster)``: density clusters by cosine distance, numbered by smallest core id; noise -1.

    A point is core if ``least`` points, itself included, are in reach.  A border point joins the
    lowest-numbered cluster of its core neighbours.  Rows without a sound vector are noise.  No pair
    of points is written: a family of n equal vectors costs n rows.
    """
    points, copies = folded(sound(items))
    reach = Reach(points, eps)
    if reach.empty:
        return items.select("id", F.lit(-1).alias("cluster"))
    kind = points.schema["id"].dataType
    met = graph.materialize(reach.placed(points))
    # a point is a guest of its own ring too, so it counts itself
    core = graph.materialize(_reached(reach, reach.blocks(met), True, meter).where(F.col("n") >= least).select("id"))
    dense = graph.materialize(met.join(core, "id", "left_semi"))

    def forest(table: pa.Table) -> pa.Table:
        guests, members = _sides(table)
        code, ids = _codes(guests, members)
        top = np.arange(len(ids))
        for i, j, _ in _pairs(guests, members, eps):
            top = spanning(len(ids), code[i], code[guests.num_rows + j], top)
        leaf = np.flatnonzero(top != np.arange(len(top)))
        return pa.table({"a": ids.take(pa.array(leaf)), "b": ids.take(pa.array(top[leaf]))})

    links = reach.blocks(dense).groupBy(*KEY).applyInArrow(forest, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    joined = graph.components(links)
    rooted = graph.materialize(core.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("root")))
    edge = met.where("guest").join(core, "id", "left_anti").withColumn("root", F.lit(None).cast(kind))
    near = dense.where("not guest").join(rooted, "id")

    def border(table: pa.Table) -> pa.Table:
        guests, members = _sides(table)
        a, root = guests["id"].combine_chunks(), members["root"].combine_chunks()
        best = pa.table({"id": a.slice(0, 0), "root": root.slice(0, 0)})
        for i, j, _ in _pairs(guests, members, eps):
            found = pa.concat_tables([best, pa.table({"id": a.take(pa.array(i)), "root": root.take(pa.array(j))})])
            best = found.group_by("id").aggregate([("root", "min")]).select(["id", "root_min"]).rename_columns(["id", "root"])
        return best

    out = T.StructType([T.StructField("id", kind), T.StructField("root", kind)])
    edges = reach.blocks(edge.unionByName(near)).groupBy(*KEY).applyInArrow(border, out).groupBy("id").agg(F.min("root").alias("root"))
    placed_ = graph.materialize(rooted.unionByName(edges))
    numbers = graph.ranked(rooted.select("root").distinct(), "root")
    numbered = placed_.join(numbers, "root").select("id", "rank")
    every = numbered.unionByName(copies.join(numbered.withColumnRenamed("id", "point"), "point").select("id", "rank"))
    return items.select("id").join(every, "id", "left").select("id", F.coalesce("rank", F.lit(-1)).cast("int").alias("cluster"))
