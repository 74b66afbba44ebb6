"""Near-duplicate groups: SimHash and product quantisation, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shoebox.llm import components, pqdedup, simhash

UPPER = {c: chr(c + 32) for c in range(65, 91)}


def fingerprint(text, width=3):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in (text or "").translate(UPPER)).split(" ") if w]
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, linked):
    label = {n: n for n in nodes}
    while True:
        pairs = [(a, b) for a in nodes for b in nodes if linked(a, b) and label[b] < label[a]]
        if not pairs:
            return label
        for a, b in pairs:
            label[a] = min(label[a], label[b])


def close(a, b):
    return (a ^ b).bit_count() <= 3


def expected_groups(texts):
    prints = {k: fingerprint(t) for k, t in texts.items()}
    roots = smallest_reachable(sorted(texts), lambda a, b: close(prints[a], prints[b]))
    return {k: (f"{prints[k]:016x}", roots[k]) for k in texts}


def test_odd_documents(spark, odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    got = simhash.simhash_groups(odd_docs).collect()
    want = expected_groups(texts)
    assert len(got) == 10
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == (want[r["doc_id"]] if r["doc_id"] is not None else (f"{fingerprint('no id here'):016x}", None))
    assert want[5][1] == want[2][1] == 1  # without words: fingerprint zero, one group
    assert simhash.simhash_groups(no_docs).count() == 0


def family(rng, size, words=60):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        copy[rng.randrange(words)] = f"n{rng.randrange(9999)}"
        yield " ".join(copy)


def test_groups_match_brute_force(spark):
    rng = random.Random(8)
    made = [t for n in (1, 2, 5, 12, 30) for t in family(rng, n)] + ["same text here"] * 6 + [f"alone {i} " + " ".join(f"u{rng.randrange(9**6)}" for _ in range(20)) for i in range(30)]
    rng.shuffle(made)
    texts = dict(enumerate(made))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect()} == expected_groups(texts)


@pytest.mark.parametrize("chunk", [2, 7, 1024])
def test_crowded_keys_are_split_without_loss(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    prints = {0}
    at = 0
    while len(prints) < 120:  # a family along a random walk, and some strangers
        at ^= 1 << rng.randrange(64)
        at ^= 1 << rng.randrange(8)
        prints |= {at, rng.getrandbits(64)} if rng.random() < 0.2 else {at}
    prints = sorted(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "node long, fp long"))
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    want = smallest_reachable(range(len(prints)), lambda a, b: close(prints[a], prints[b]))
    assert {i: got.get(i, i) for i in range(len(prints))} == want


def test_one_document_of_each_group_stays(spark, odd_docs):
    kept = simhash.keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 7, 8, 9]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(8, 60)] + [(1, 1), (5, 6), (6, 5), (5, 6), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {i: 7 for i in range(7, 60)} | {5: 5, 6: 5}
    assert components.connected_components(df.limit(0)).count() == 0


def vectors(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for _ in range(60):
            rows.append((rng.normal(size=dim), label))
        for size in (2, 3, 25):
            base = rng.normal(size=dim)
            rows += [(base + rng.normal(size=dim) * 0.07, label) for _ in range(size)]
        rows += [(rows[-1][0], label)] * 4
    out = [(i, [float(x) for x in v.astype(np.float32)], label) for i, (v, label) in enumerate(rows)]
    n = len(out)
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [None] + [1.0] * (dim - 1)]
    return out + [(n + i, v, 0) for i, v in enumerate(bad)] + [(n + 10, [float(x) * 3 for x in out[0][1]], 0)]


def expected_links(rows, threshold=0.93):
    sound = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ids = [r[0] for r in rows]
    links = {i: set() for i in ids}
    for a, v, x in rows:
        for b, w, y in rows:
            if a != b and x is not None and x == y and sound(v) and sound(w):
                v_, w_ = np.asarray(v, dtype=np.float64), np.asarray(w, dtype=np.float64)
                if v_ @ w_ / (np.sqrt(v_ @ v_) * np.sqrt(w_ @ w_)) >= threshold:
                    links[a].add(b)
    roots = smallest_reachable(ids, lambda a, b: b in links[a])
    return {i: (len(links[i]), roots[i], roots[i] == i) for i in ids}


@pytest.mark.parametrize("chunk,spread", [(2048, None), (5, None), (2048, 4.0)])
def test_vector_groups_match_brute_force(spark, monkeypatch, chunk, spread):
    monkeypatch.setattr(pqdedup, "CHUNK", chunk)
    monkeypatch.setattr(pqdedup, "LIST_ROOT", 1)
    rows = vectors()
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep int, n string").repartition(3)
    got = {r["vec_id"]: tuple(r)[1:] for r in pqdedup.cosine_groups(df, spread=spread).collect()}
    want = expected_links(rows)
    assert len(got) == len(want)
    if spread is None:
        assert got == want
    else:
        found, links = (sum(v[0] for v in x.values()) for x in (got, want))
        assert found >= 0.99 * links and all(got[i][0] <= want[i][0] for i in want)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pqdedup.cosine_groups(df).count() == 0
    lone = spark.createDataFrame([(1, None, 0), (2, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in pqdedup.cosine_groups(lone).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_on_the_stored_vectors(spark):
    """Measured recall of the production settings on the sf0.1 vectors and planted copies."""
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label")
    noisy = base.where("vec_id % 3 = 0").select((F.col("vec_id") + 100_000).alias("vec_id"), F.transform("embedding", lambda x, i: x + 0.035 * F.sin(i * 7.0 + F.col("vec_id"))).alias("embedding"), "label")
    rows = [tuple(r) for r in base.unionByName(noisy).collect()]
    x = np.asarray([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.asarray([r[2] for r in rows])
    links = ((x @ x.T >= 0.93) & (label[:, None] == label[None])).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pqdedup.cosine_groups(base.unionByName(noisy)).collect()}
    found = np.asarray([got[r[0]] for r in rows])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() > 0


@pytest.mark.parametrize("root", [pqdedup.LIST_ROOT, 1])
def test_no_link_along_principal_directions_is_missed(spark, monkeypatch, root):
    """Production settings find every link between stored vectors and copies shifted along their main directions."""
    monkeypatch.setattr(pqdedup, "LIST_ROOT", root)
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(1500).collect()
    x = np.asarray([r["embedding"] for r in base], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    main = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:4]
    copies = x + 0.36 * main[np.arange(len(x)) % 4] * np.where(np.arange(len(x)) % 8 < 4, 1, -1)[:, None]
    rows = np.concatenate([x, copies / np.linalg.norm(copies, axis=1, keepdims=True)])
    links = (rows @ rows.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in pqdedup.cosine_groups(df).collect()}
    assert links.sum() > len(x) and [got[i] for i in range(len(rows))] == links.tolist()


def near_fingerprints(n, seed=5, flips=5):
    """Distinct fingerprints within ``flips`` bits of one."""
    rng = np.random.default_rng(seed)
    centre, found = int(rng.integers(0, 1 << 63)), set()
    while len(found) < n:
        bits = np.uint64(centre) ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, flips)).astype(np.uint64), axis=1)
        found |= set(bits.tolist())
    return np.asarray(sorted(found)[:n], dtype=np.uint64).view(np.int64)


def test_dealt_rows_grow_with_a_family_not_with_its_square(spark):
    dealt = {}
    for n in (20_000, 80_000, 160_000):
        fps = spark.createDataFrame([(i, x) for i, x in enumerate(near_fingerprints(n).tolist())], "node long, fp long")
        dealt[n] = simhash.dealt_groups(fps).count()
    # at most 20 keys x 35 finer ones a fingerprint; pairs of chunks of whole keys would be 20 x n / 1024 (3,125 at the largest)
    assert all(d <= 100 * n for n, d in dealt.items()), dealt


def test_a_crowded_family_loses_no_link(spark):
    fps = near_fingerprints(4000, seed=9, flips=6)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(fps.tolist())], "node long, fp long")
    forest = components.UnionFind(len(fps))
    for a, b in ((r["a"], r["b"]) for r in simhash.fingerprint_links(rows).collect()):
        assert int(fps.view(np.uint64)[a] ^ fps.view(np.uint64)[b]).bit_count() <= 3
        forest.join(a, b)
    whole, bits = components.UnionFind(len(fps)), fps.view(np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1:] ^ bits[i]) <= 3):
            whole.join(i, i + 1 + int(j))
    assert (forest.labels() == whole.labels()).all()


def test_every_dimension_is_compared_and_labels_may_be_text(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for i in range(60):
        dim = (2, 3, 5)[i % 3]
        base = np.eye(dim)[i % dim]
        rows.append((i, [float(x) for x in base + rng.normal(0, 0.01, dim)], "ab"[i % 2]))
    rows += [(None, [1.0, 0.0], "a"), (100, [1.0, 0.0], None), (101, [], "a")]
    cosine = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    for i, x, k in rows[:60]:
        want[i] = sum(j != i and k == m and len(x) == len(y) and cosine(x, y) >= 0.93 for j, y, m in rows[:60])
    for kind in ("double", "float"):
        got = {r["vec_id"]: r for r in pqdedup.cosine_groups(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")).collect()}
        assert {i: got[i]["n_links"] for i in range(60)} == want and min(want.values()) > 0
        assert not got[None]["kept"] and got[None]["component_id"] is None and got[100]["kept"] and got[101]["kept"]
