"""SimHash near-duplicates, found through pigeonhole blocks.

Fingerprints that differ in at most ``distance`` bits agree on at least ``blocks - distance``
of ``blocks`` blocks.  Every choice of that many blocks is a join key, so no such pair is missed.
With 6 blocks and distance 3 that is 20 keys of about 32 bits each: a key's chance partners stay
few up to billions of fingerprints.

Keys held by many fingerprints (families of near copies) are split by the same principle once
more, over the bits outside the key: each fingerprint goes to a fixed number of finer keys, which
leave so few bits free that few fingerprints can hold one.  What is still crowded is dealt out as
bounded pairs of chunks.  Groups are verified and reduced to a spanning forest.  So what is dealt
grows with the fingerprints, not with the square of a family.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import bound_batches, slices, text_column
from .components import UnionFind, connected_components
from .storage import materialize
from .worker import let_go

#: Fingerprints of one key that are compared in one place.
CHUNK = 1024
#: Blocks of a crowded key's other bits, beyond the distance; that many have to agree.
FINER = 4
SEED = 42

#: Byte value -> eight counters of eight bits, lowest bit in the lowest byte.
_SPREAD = np.asarray([sum(1 << (8 * bit) for bit in range(8) if value >> bit & 1) for value in range(256)], dtype=np.uint64)
_RUN = 255


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of every run of ``width`` words of the lower-cased text; of all words if fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, SEED)]
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *[e + 1 for e in ends]]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:])]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per run of ``hashes``: the bits set in more than half of them; zero for an empty run."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    size = lengths[full]
    parts = -(-size // _RUN)
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(full)), parts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], first[row] + within * _RUN, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(len(row), 64), np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    bits = counts * 2 > size[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` for every row; null, empty and word-free texts have fingerprint 0.

    ``fp`` holds the 64 bits as a signed long.  Texts are used whole.
    """
    bound_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def sign(batches):
        let_go()
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingle_hashes(t, width) for t in text_column(batch, "text").to_pylist()]
                lengths = np.asarray([len(x) for x in found], dtype=np.int64)
                hashes = np.fromiter((x for one in found for x in one), dtype=np.uint64, count=int(lengths.sum()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(majority_bits(hashes, lengths).view(np.int64))], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(sign, schema)


def _blocks(blocks: int) -> list[tuple[int, int]]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(blocks: int, distance: int) -> list[int]:
    """The bits of each choice of blocks that a linked pair may agree on."""
    spans = _blocks(blocks)
    return [sum(((1 << (hi - lo)) - 1) << lo for lo, hi in chosen) for chosen in combinations(spans, blocks - distance)]


def _finer_masks(mask: int, distance: int) -> list[int]:
    """The same over the bits outside ``mask``; a single empty choice if they are too few to split."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    parts = distance + FINER
    if len(free) < parts:
        return [0]
    runs = [free[len(free) * i // parts:len(free) * (i + 1) // parts] for i in range(parts)]
    return [sum(1 << bit for run in chosen for bit in run) for chosen in combinations(runs, FINER)]


def _keys(fp: F.Column, masks: list[int]) -> F.Column:
    """One struct (which, bits) for each mask."""
    return F.array(*[F.struct(F.lit(which).alias("which"), fp.bitwiseAND(F.lit(_signed(mask))).alias("bits")) for which, mask in enumerate(masks)])


GROUP = ("which", "bits", "sub", "finer", "lo", "hi")


def _verify(distance: int):
    """Rows come sorted by group; groups hold two chunks at most.  Yields a spanning forest."""

    def compare(fp, node, group):
        n = len(fp)
        forest, pairs = UnionFind(n), []
        at, step = np.arange(n - 1), 1
        label = forest.labels()
        while len(at):
            at = at[at + step < n]
            at = at[group[at] == group[at + step]]
            near = at[(np.bitwise_count(fp[at] ^ fp[at + step]) <= distance) & (label[at] != label[at + step])]
            if len(near):
                pairs += [(i, i + step) for i in near.tolist() if forest.join(i, i + step)]
                label = forest.labels()
            step += 1
        left = np.asarray([p[0] for p in pairs], dtype=np.int64)
        right = np.asarray([p[1] for p in pairs], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(node[right])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            # keys are compared as columns; the last group may go on in the next batch
            cols = {c: np.asarray(table[c].combine_chunks()) for c in table.column_names}
            n = table.num_rows
            if n == 0:
                continue
            new = np.ones(n, dtype=bool)
            new[1:] = False
            for c in GROUP:
                new[1:] |= cols[c][1:] != cols[c][:-1]
            group = np.cumsum(new)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield compare(cols["fp"][:last].view(np.uint64), cols["node"][:last], group[:last])
            held = table.slice(last)
        if held is not None and held.num_rows:
            fp, node = (np.asarray(held[c].combine_chunks()) for c in ("fp", "node"))
            yield compare(fp.view(np.uint64), node, np.zeros(len(fp), dtype=np.int64))

    return run


def dealt_groups(fps: DataFrame, blocks: int = 6, distance: int = 3) -> DataFrame:
    """``fps(node long, fp long)``, fingerprints distinct -> rows of the groups to be compared.

    ``GROUP`` names a group; any two fingerprints within ``distance`` share one at least.
    """
    masks = _masks(blocks, distance)
    keyed = fps.select("node", "fp", F.explode(_keys(F.col("fp"), masks)).alias("k")).select("node", "fp", "k.which", "k.bits")
    held = materialize(keyed.groupBy("which", "bits").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    zero = F.lit(0)
    few = keyed.join(held.where(F.col("n") <= CHUNK), ["which", "bits"]).select("which", "bits", F.lit(-1).alias("sub"), zero.cast("long").alias("finer"), zero.alias("lo"), zero.alias("hi"), "fp", "node")
    crowded = held.where(F.col("n") > CHUNK)
    if crowded.isEmpty():
        return few
    # the finer masks of each key are a fixed table
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in _finer_masks(mask, distance)]) for mask in masks])
    finer = keyed.join(crowded, ["which", "bits"]).select("which", "bits", "fp", "node", F.posexplode(F.element_at(table, F.col("which") + 1)).alias("sub", "mask"))
    finer = finer.select("which", "bits", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("finer"), "fp", "node")
    key = ["which", "bits", "sub", "finer"]
    counts = finer.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    together = (
        finer.join(counts, key).select(*key, "fp", "node", chunks.alias("m"), own.alias("own"))
        .select(*key, "fp", "node", "own", F.explode(F.sequence(zero, F.col("m") - 1)).alias("other"))
        .select(*key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "node")
    )
    return few.unionByName(together)


def fingerprint_links(fps: DataFrame, blocks: int = 6, distance: int = 3) -> DataFrame:
    """``fps(node long, fp long)``, fingerprints distinct -> edges ``(a, b)``.

    The edges have the components of the graph that links fingerprints at ``distance`` bits or
    fewer; they are a part of its links, enough for that.
    """
    if not 0 <= distance < blocks <= 64:
        raise ValueError("need 0 <= distance < blocks <= 64")
    dealt = dealt_groups(fps, blocks, distance).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(_verify(distance), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, blocks: int = 6, distance: int = 3) -> DataFrame:
    """``(doc_id long, fingerprint string, component_id long)``, one row per input row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest doc_id reachable
    over fingerprints that differ in ``distance`` bits or fewer, itself included.  Null, empty and
    word-free texts have fingerprint zero and are linked like any other.  Rows with a null id have a
    fingerprint but take part in no group (component null).  Repeated rows give repeated rows; an
    empty table gives none.
    """
    signed = materialize(simhash_fingerprints(docs, id_col, text_col, width).select(F.col("doc_id").cast("long"), "fp"), "simhash")
    nodes = materialize(signed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprints")
    reached = connected_components(fingerprint_links(nodes, blocks, distance))
    of_fp = materialize(
        nodes.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes"
    )
    return signed.join(of_fp, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that represent their group: those whose id is the group's smallest.

    Columns are unchanged.  Of rows that repeat an id the one with the first text by order stays
    (of equal texts any); rows with a null id all stay.
    """
    groups = simhash_groups(docs, id_col, text_col, **options)
    kept = materialize(groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    stay = docs.where(docs[id_col].isNull())
    # the ids kept grow with the documents, so they are never broadcast; hashing them spares a sort of the texts
    chosen = lambda which: kept.where(which).select(F.col("doc_id").alias(id_col)).hint("shuffle_hash")
    known = docs.where(docs[id_col].isNotNull()).join(chosen("n = 1"), id_col, "left_semi").select(*docs.columns)
    if not kept.where("n > 1").isEmpty():
        again = docs.where(docs[id_col].isNotNull()).join(chosen("n > 1"), id_col, "left_semi").select(*docs.columns)
        first = again.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col).isNull(), text_col)).alias("first of the id"))
        known = known.unionByName(first.select("`first of the id`.*"))
    return known.unionByName(stay)
