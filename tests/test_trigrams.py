"""Substring search through trigrams against plain search."""

import random

from shoebox.operators import trigrams

SF = "/root/testdata/sf0.001"


def test_terms(spark):
    pick = random.Random(2)
    alphabet = "abcÀé日本語 \n\U0001F600İß"
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)] + [("none", None)], "id string, text string")
    index = trigrams.build(df)
    lowered = {r["id"]: r["text"] for r in index.rows.collect()}
    for term in ["a", "ab", "bc ", "日本", "日本語", "À", "abc", "\U0001F600", " \n", "ba日", "zzz", "zz", "", "AbC", "\0", "語\U0001F600a", "c" * 20]:
        low = term.lower()
        want = {i for i, t in lowered.items() if low in t}
        assert {r["id"] for r in trigrams.search(index, term).collect()} == want, repr(term)


def test_share_verified(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index, total = trigrams.build(docs, "doc_id"), docs.count()
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in docs.collect()}
    for term in ["license", "@", "erethat", "password"]:
        meter = spark.sparkContext.accumulator(0)
        got = {r["id"] for r in trigrams.search(index, term, meter).collect()}
        assert got == {i for i, t in texts.items() if term in t}
        # a term made of frequent trigrams costs more, but never all texts
        assert meter.value <= len(got) + (0.1 if term != "erethat" else 0.5) * total, term


def test_long_text_and_empty_table(spark):
    long = "lorem ipsum " * 50_000 + "needle"
    index = trigrams.build(spark.createDataFrame([(1, long), (2, "short")], "id long, text string"))
    assert [r["id"] for r in trigrams.search(index, "M needle").collect()] == [1]
    assert trigrams.search(trigrams.build(spark.createDataFrame([], "id long, text string")), "abc").count() == 0
