"""Token counts against the library, vector codes against plain integer rounds."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from shoebox.llm import bpe_words, partialpq, queries, tokencount

PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = bpe_words.load_tokenizer(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_frequencies_of_random_texts(library):
    pick = random.Random(5)
    alphabet = "abcZ 019  \n\t'sst.,!é ÀŽя日 \u0085　\x1c\x1f\x00\U0001F600́ "
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 40))) + pick.choice(["", "<|endoftext|>", " <|endoftext|> x", "<|endoftext"]) for _ in range(8000)]
    splitter = tokencount.PreTokens(PATH)
    text_of, names, count = splitter.frequencies(pa.array(texts, pa.large_string()))
    total = np.zeros(len(texts), dtype=np.int64)
    np.add.at(total, text_of, count * np.asarray([splitter.tokens(t) for t in names.to_pylist()]))
    assert total.tolist() == library(texts)


@pytest.mark.parametrize("frequent", [tokencount.FREQUENT, 7, 0])
def test_counts(spark, odd_docs, library, monkeypatch, frequent):
    """The same counts however many pre-tokens are broadcast."""
    monkeypatch.setattr(tokencount, "FREQUENT", frequent)
    got = collections.Counter(map(tuple, tokencount.count_tokens(odd_docs, PATH, limit=4).collect()))
    rows = odd_docs.collect()
    n = library([r["text"] or "" for r in rows])
    assert got == collections.Counter((r["doc_id"], len((r["text"] or "").encode()), k, k > 4) for r, k in zip(rows, n))


def test_counts_of_nothing_and_other_vocabularies(spark, no_docs):
    assert tokencount.count_tokens(no_docs, PATH).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.PreTokens(queries.tokenizer_path("word_bpe_49k.json"))


def test_counts_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    want = dict(zip(docs, library(list(docs.values()))))
    assert {k: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for k, r in got.items()} == {k: (len(docs[k].encode()), n, n > 1024) for k, n in want.items()}


def rounds(vectors, parts=8, entries=16, times=6):
    """(codes, errors, codebooks) by full distances in Python integers."""
    cut = lambda v: [v[i * len(v) // parts:(i + 1) * len(v) // parts] for i in range(parts)]
    rows = [cut([int(np.floor(4096 * x)) for x in v]) for _, v in sorted(vectors)]
    books = [[r[p] for r in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda s, book: min((far(s, e), k) for k, e in enumerate(book))
    for _ in range(times):
        for p in range(parts):
            codes = [near(r[p], books[p])[1] for r in rows]
            for k in set(codes):
                members = [r[p] for r, c in zip(rows, codes) if c == k]
                books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    found = [[near(r[p], books[p]) for p in range(parts)] for r in rows]
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


def test_nearest_entries():
    rng = np.random.default_rng(1)
    for _ in range(150):
        dims, n = int(rng.integers(1, 9)), int(rng.integers(1, 17))
        x, book = rng.integers(-4, 5, (100, dims)), rng.integers(-4, 5, (n, dims))
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        best, least, taken = partialpq.nearest_entries(x, book)
        assert (best == full.argmin(1)).all() and (least == full.min(1)).all() and taken <= 100 * dims * (n + 1)
    x, book = rng.integers(-2000, 2000, (5000, 8)), rng.integers(-2000, 2000, (16, 8))
    assert partialpq.nearest_entries(x, book)[2] < 0.7 * 5000 * 8 * 16


def test_codes(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, np.round(rng.normal(size=24), 2).tolist()) for i in range(60)] + [(70 + i, [0.5] * 24) for i in range(5)]
    bad = [(100, None), (101, [float("nan")] + [0.0] * 23), (102, [float("inf")] * 24), (103, [None] + [1.0] * 23)]
    rows = [(i, v, None if i % 5 == 0 else i % 3, "x", 1) for i, v in [*vectors, *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, part int").repartition(3)
    coded, books = partialpq.encode_vectors(df)
    got = {r["vec_id"]: r for r in partialpq.with_label_errors(coded).collect()}
    codes, errors, want = rounds(vectors)
    assert books.books.tolist() == want and hashlib.sha256(books.text().encode()).hexdigest() == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()
    assert [got[i]["code"].hex() for i, _ in sorted(vectors)] == codes and [got[i]["error"] for i, _ in sorted(vectors)] == errors and len(got) == len(vectors)
    sums = collections.Counter()
    for (i, _), e in zip(sorted(vectors), errors):
        sums[None if i % 5 == 0 else i % 3] += e
    assert all(r["label_error"] == sums[r["label"]] for r in got.values())


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert partialpq.encode_vectors(spark.createDataFrame([], schema))[0].count() == 0
    assert partialpq.encode_vectors(spark.createDataFrame([(1, None, "a")], schema))[0].count() == 0
    few = spark.createDataFrame([(2, [1.0, 2.0, 3.0], "a"), (1, [1.0], None), (1, [1.0], None), (None, [], "a"), (3, [1e300] * 9, "b")], schema)
    coded, books = partialpq.encode_vectors(few)
    rows = coded.collect()
    assert books.books.shape == (8, 5, 2) and len(rows) == 5 and all(r["error"] >= 0 for r in rows)
