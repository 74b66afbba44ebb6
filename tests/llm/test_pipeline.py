"""Registered queries against SQL, and the pipeline against its stages one by one."""

import collections

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shoebox.llm import langid, pipeline_query, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(f"select {','.join(df.columns)} from ({queries.ORACLES[name]}) o").fetchall()
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(want)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert list(pipeline_query.QUERIES) == ["pipeline"]


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = set(rows)
    model = langid.train_languages(docs)
    accepted = {r["doc_id"] for r in langid.identify_language(docs, model).collect() if r["accepted"]}
    kept &= accepted
    after = docs.where(docs["doc_id"].isin(sorted(kept)))
    machine = toxicity.train_toxicity(after, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in toxicity.score_toxicity(after, machine).collect() if r["score"] < 0.3}
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.simhash_groups(docs.where(docs["doc_id"].isin(sorted(kept)))).collect()}
    label = {k: k for k in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            for b in kept:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    kept = {k for k in kept if label[k] == k}
    pieces = corpus_pipeline.run(spark, SF).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {k: len(tokenizer.encode(rows[k]["text"] or "", add_special_tokens=False).ids) + 1 for k in kept}
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert dict(got) == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_no_documents(name, spark, odd_docs, no_docs):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd_docs, no_docs):
        out = stage(spark, docs, SF)
        assert out.count() >= 0
        if name != "packing":
            assert out.columns == docs.columns
