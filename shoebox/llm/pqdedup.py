"""Embedding near-duplicates by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centroid, as residual codes of
``PARTS`` subspaces.  A vector probes every list whose border it is close enough to; a pair is met
if either side probes the other's list.  Met pairs are scored by asymmetric table lookups against
codes.  A lookup distance may exceed the true one by no more than the code's own, stored,
error, so this step drops no link.  What is left is verified by exact double-precision cosine.

Probing.  If two vectors at distance r lie in different cells, the sum of their distances to the
border between the cells is at most the part of r across it.  So one of them is within half of
that part, and probing up to r / 2 misses no link; this is the default.  A number as ``spread``
says how many standard deviations of that part (r / sqrt(dimension)) are allowed for.  It probes
less, and loses links whose differences lie along the main directions of the vectors.

Exact copies are folded into one vector with a weight first.  Lists that hold many vectors are
dealt out as pairs of bounded chunks.  Link counts are summed before the shuffle and only a
spanning forest of links leaves a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import UnionFind, connected_components
from .storage import materialize

#: Vectors that the index is fitted on at most (the smallest by hash of the id).
FIT_ROWS = 65_536
#: Lists grow as the root of the number of vectors, so that the lists a vector probes do too: root of
#: the vectors for each list, the least number of lists, and fitted vectors for each list.
LIST_ROOT, LISTS_MIN, LIST_FIT = 4, 8, 4
PARTS, CODES = 8, 256
ROUNDS = 12
#: Vectors of one label and list in one chunk; a task compares two chunks at a time.
CHUNK = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from a fixed random start; an empty centre keeps its place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i:i + 4096], y).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


@dataclass
class Index:
    """A fitted index; its size is bounded by FIT_ROWS, CODES and the dimension."""

    coarse: np.ndarray
    codebooks: list[np.ndarray]
    limit: float
    border: float

    @property
    def splits(self) -> np.ndarray:
        return np.linspace(0, self.coarse.shape[1], len(self.codebooks) + 1).astype(int)

    def home(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.coarse)

    def probes(self, x: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        """Lists within reach of each vector, its own included."""
        d = squared(x, self.coarse)
        apart = np.sqrt(squared(self.coarse, self.coarse))[home]
        gap = d - d[np.arange(len(x)), home][:, None]
        return [np.flatnonzero(row) for row in gap <= 2 * apart * self.border + 1e-9]

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance between each vector and what its codes stand for)."""
        residual, cuts = x - self.coarse[home], self.splits
        codes = np.stack([nearest(residual[:, a:b], book) for a, b, book in zip(cuts, cuts[1:], self.codebooks)], axis=1)
        rebuilt = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.codebooks)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((residual - rebuilt) ** 2).sum(1))

    def lookup(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of queries ``x`` to coded members of list ``which``."""
        residual, cuts = x - self.coarse[which], self.splits
        out = np.zeros((len(x), len(codes)))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out += squared(residual[:, a:b], self.codebooks[i])[:, codes[:, i]]
        return out


def fit(sample: np.ndarray, total: int, threshold: float, spread: float | None) -> Index:
    lists = int(min(max(math.isqrt(total) // LIST_ROOT, LISTS_MIN), max(1, len(sample) // LIST_FIT)))
    coarse = kmeans(sample, lists)
    residual = sample - coarse[nearest(sample, coarse)]
    dim = sample.shape[1]
    cuts = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
    books = [kmeans(residual[:, a:b], min(CODES, len(sample)), seed=11 + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    limit = math.sqrt(max(0.0, 2 - 2 * threshold))
    border = limit / 2 if spread is None else min(limit / 2, spread * limit / math.sqrt(dim) / 2)
    return Index(coarse, books, limit, border)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a double matrix."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def projected(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors cut, or filled with zeros, to the index's dimension.

    Cutting brings vectors nearer, never farther, so what the index promises still holds.
    """
    sizes = np.asarray(pc.list_value_length(column))
    out = np.zeros((len(column), dim))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at, :min(size, dim)] = unit(matrix(column.take(pa.array(at))))[:, :dim]
    return out


KEYED = "label string, dim int, list int, rep long, vec {vec}, query boolean, home int, codes binary, err double, weight long, probed array<int>"


def _spread_out(shared):
    def run(batches):
        index: Index = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                vec = part.column("vec")
                x = projected(vec, index.coarse.shape[1])
                home = index.home(x)
                codes, err = index.code(x, home)
                lists = index.probes(x, home)
                sizes = np.asarray([len(p) for p in lists])
                # one row as a member of its own list, one as a query of each probed list
                row = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), sizes)])
                where = np.concatenate([home, *lists])
                query = np.arange(len(row)) >= len(x)
                take = pa.array(row)
                # only members carry codes and probed lists
                blobs = pa.array([c.tobytes() for c in codes], pa.binary())
                probed = pa.array([p.astype(np.int32) for p in lists], pa.list_(pa.int32()))
                coded = pa.array([*range(len(x)), *[None] * int(sizes.sum())], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column("label").take(take), part.column("dim").take(take), pa.array(where.astype(np.int32)), part.column("rep").take(take), vec.take(take), pa.array(query),
                    pa.array(home[row].astype(np.int32)), blobs.take(coded), pa.array(err[row]), part.column("weight").take(take),
                    probed.take(coded),
                ], names=["label", "dim", "list", "rep", "vec", "query", "home", "codes", "err", "weight", "probed"])

    return run


#: Cells of one block of the table-lookup matrix.
BLOCK_CELLS = 1 << 20
GROUP = ("label", "dim", "list", "qc", "mc")


def _compare(shared, threshold):
    def pairs(index, which, query, member):
        """(i, j, exact cosine) of linked pairs, each found in one list only."""
        step = max(1, BLOCK_CELLS // max(1, len(member["rep"])))
        reach = (index.limit + member["err"] + 1e-6) ** 2
        for low in range(0, len(query["rep"]), step):
            part = slice(low, low + step)
            i, j = np.nonzero(index.lookup(query["x"][part], which, member["codes"]) <= reach[None])
            i = i + low
            # in the other vector's list the pair comes up again if that one probes this one's home
            again = np.fromiter((query["home"][a] in member["probed"][b] for a, b in zip(i.tolist(), j.tolist())), dtype=bool, count=len(i))
            keep = (query["rep"][i] != member["rep"][j]) & ((query["rep"][i] > member["rep"][j]) | ~again)
            i, j = i[keep], j[keep]
            cosine = np.einsum("ij,ij->i", query["raw"][i], member["raw"][j]) / (query["norm"][i] * member["norm"][j])
            sure = cosine >= threshold
            yield i[sure], j[sure]

    def settle(index, table):
        column = {c: table[c].combine_chunks() for c in table.column_names}
        is_query = np.asarray(column["query"])
        sides = []
        for side in (is_query, ~is_query):
            at = np.flatnonzero(side)
            coded = pa.array(at if side is not is_query else at[:0])
            vec = column["vec"].take(pa.array(at))
            raw = matrix(vec)
            take = lambda c: column[c].take(pa.array(at))  # noqa: E731, B023
            sides.append({
                "rep": np.asarray(take("rep")), "raw": raw, "norm": np.sqrt((raw * raw).sum(1)), "x": projected(vec, index.coarse.shape[1]),
                "weight": np.asarray(take("weight")), "home": np.asarray(take("home")), "err": np.asarray(take("err")),
                "codes": np.frombuffer(b"".join(column["codes"].take(coded).to_pylist()), dtype=np.uint8).reshape(len(coded), -1) if len(coded) else None,
                "probed": [set(p) for p in column["probed"].take(coded).to_pylist()],
            })
        query, member = sides
        if not len(query["rep"]) or not len(member["rep"]):
            return None
        nodes = np.unique(np.concatenate([query["rep"], member["rep"]]))
        q, m = np.searchsorted(nodes, query["rep"]), np.searchsorted(nodes, member["rep"])
        links, forest, edges = np.zeros(len(nodes), dtype=np.int64), UnionFind(len(nodes)), []
        for i, j in pairs(index, int(column["list"][0].as_py()), query, member):
            np.add.at(links, q[i], member["weight"][j])
            np.add.at(links, m[j], query["weight"][i])
            label = forest.labels()
            fresh = label[q[i]] != label[m[j]]
            edges += [(a, b) for a, b in zip(q[i[fresh]].tolist(), m[j[fresh]].tolist()) if forest.join(a, b)]
        hit = np.flatnonzero(links)
        a = np.concatenate([nodes[hit], nodes[[e[0] for e in edges]] if edges else np.zeros(0, dtype=np.int64)])
        b = [None] * len(hit) + [int(nodes[e[1]]) for e in edges]
        n = np.concatenate([links[hit], np.zeros(len(edges), dtype=np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(n)], names=["a", "b", "n"])

    def run(batches):
        index: Index = shared.value
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            key = np.stack([np.asarray(table[c].combine_chunks().dictionary_encode().indices) for c in GROUP], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
            for low, high in zip(cuts, cuts[1:]):
                out = settle(index, table.slice(low, high - low))
                if out is not None:
                    yield out
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            out = settle(index, held)
            if out is not None:
                yield out

    return run


def cosine_groups(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", spread: float | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Two rows link if their labels are equal (as text) and not null, their vectors have the same
    dimension, and the double-precision cosine is at least ``threshold``.  ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable, itself included,
    ``kept`` says that it is the row's own.  Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do rows with a null id (component null, not kept) or
    label.  Repeated rows count as copies of each other.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    # float vectors stay so on the way; all arithmetic is double
    stored = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast(stored).alias("vec"))
    finite = F.forall("vec", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite & (square > 0) & (square < float("inf")), F.lit(False))
    rows = rows.withColumn("usable", usable)
    ok = rows.where("usable")
    # folding by value sums before the shuffle, so a vector that fills a third of the table is one row
    folded = materialize(ok.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vectors")
    total = folded.count()
    single = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not total:
        return single
    sample = folded.select("vec", "rep", "label").orderBy(F.xxhash64("rep"), "rep", "label").limit(FIT_ROWS).toArrow()["vec"].combine_chunks()
    # the index works in the most frequent dimension; other vectors are cut or filled up
    dim = int(np.bincount(np.asarray(pc.list_value_length(sample))).argmax())
    fitted = fit(projected(sample, dim), total, threshold, spread)
    shared = spark.sparkContext.broadcast(fitted)  # bounded: FIT_ROWS / LIST_FIT centres and PARTS x CODES codewords
    keyed = materialize(folded.withColumn("dim", F.size("vec")).mapInArrow(_spread_out(shared), KEYED.format(vec=stored)), "probes")
    crowd = keyed.groupBy("label", "dim", "list").agg(F.count_if("query").alias("nq"), F.count_if(~F.col("query")).alias("nm")).where("nq > 0 and nm > 0")
    crowd = crowd.select("label", "dim", "list", F.ceil(F.col("nq") / CHUNK).cast("int").alias("cq"), F.ceil(F.col("nm") / CHUNK).cast("int").alias("cm"))
    crowd = materialize(crowd, "crowds")
    chunk = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = keyed.join(crowd, ["label", "dim", "list"]).select(
        "*", F.explode(F.when(F.col("query"), F.transform(every("cm"), lambda m: F.struct(chunk("cq").alias("qc"), m.alias("mc"))))
                       .otherwise(F.transform(every("cq"), lambda q: F.struct(q.alias("qc"), chunk("cm").alias("mc"))))).alias("at"),
    ).select("label", "dim", "list", "at.qc", "at.mc", "rep", "vec", "query", "home", "codes", "err", "weight", "probed")
    found = materialize(
        dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_compare(shared, threshold), "a long, b long, n long"), "links"
    )
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    reached = connected_components(found.where("b is not null").select("a", "b"))
    classes = materialize(
        folded.join(links, folded["rep"] == links["a"], "left").join(reached, folded["rep"] == reached["node"], "left")
        .select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "classes",
    )
    linked = ok.select("vec_id", "label", "vec").join(classes, ["label", "vec"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )
    apart = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(apart)
