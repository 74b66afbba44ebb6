"""Language identification and toxicity: models, edges, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shoebox.llm import langid, toxicity

SF = "/root/testdata/sf0.1"


def kn_by_hand(counts, alphabet, history, c, order):
    """Interpolated Kneser-Ney by its definition; ``counts`` are raw n-gram counts."""

    def value(g):
        if len(g) == order or (g.startswith(" ") and g != " "):
            return counts.get(g, 0)
        return len({x[0] for x in counts if len(x) == len(g) + 1 and x[1:] == g})

    grams = [{g: value(g) for g in counts if len(g) == k and value(g)} for k in range(1, order + 1)]

    def p(h, c):
        after = {g[-1]: n for g, n in grams[len(h)].items() if g[:-1] == h}
        lower = p(h[1:], c) if h else 1 / alphabet
        if not after:
            return lower
        n1, n2 = (sum(n == k for n in grams[len(h)].values()) for k in (1, 2))
        d = n1 / max(1, n1 + 2 * n2) if n1 else 0.5
        return max(after.get(c, 0) - d, 0) / sum(after.values()) + d * len(after) / sum(after.values()) * lower

    return p(history, c)


def test_kneser_ney_equals_its_definition():
    words = ["abra", "abab", "cab", "a", "babc", "abra", "ç"]
    counts = {}
    for w in words:
        s = f" {w} "
        for k in range(1, langid.ORDER + 1):
            for i in range(len(s) - k + 1):
                counts[s[i:i + k]] = counts.get(s[i:i + k], 0) + 1
    model = langid.KneserNey.fit(counts, 9)
    assert (np.diff(model.grams.astype(np.float64)) > 0).all() and (np.diff(model.histories.astype(np.float64)) > 0).all()
    for word in ["abra", "cabab", "zz", "a", "bç", "ccccccc"]:
        s = f" {word} "
        want = [math.log(kn_by_hand(counts, 9, s[max(0, i - langid.ORDER + 1):i], s[i], langid.ORDER)) for i in range(1, len(s))]
        got = langid.Identifier(langid.LanguageModel(["x"], [model], None, None, None), np.float64).words([word])[0]
        assert got[0] == pytest.approx(sum(want), abs=1e-6) and got[1] == len(want)


@pytest.fixture(scope="module")
def stored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}


@pytest.fixture(scope="module")
def languages(stored):
    return langid.train_languages(stored[0])


def test_held_out_languages(stored, languages):
    docs, truth = stored
    rows = langid.identify_language(docs, languages).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.99
    assert np.mean([r["accepted"] for r in rows]) >= 0.999 and all(0 <= r["score"] <= 1 for r in rows)


def test_noise_is_rejected_and_clean_text_kept(spark, languages):
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzйцукенгшщ") for _ in range(9)) for _ in range(120)) for _ in range(5)]
    clean = ["Von.", "The of and in that re.", "De la en que.", "x", "Of%%% and### 12 the*** in!"]
    texts = pa.array(noise + clean, pa.large_string())
    accepted = langid.Identifier(languages).predict(texts)[3]
    assert accepted.tolist() == [False] * 5 + [True] * 5


def test_odd_documents_have_defined_languages(spark, odd_docs, no_docs, languages):
    got = {r["doc_id"]: r for r in langid.identify_language(odd_docs, languages).collect()}
    assert {k for k, r in got.items() if r["lang_pred"] == "und"} == {5, 1, 2, 9}
    assert all(got[k]["score"] == 0 and not got[k]["accepted"] for k in (5, 1, 2, 9))
    assert langid.drop_rejected(odd_docs, languages).columns == odd_docs.columns
    model = langid.train_languages(no_docs)
    assert model.languages == [] and {r["lang_pred"] for r in langid.identify_language(odd_docs, model).collect()} == {"und"}
    few = langid.train_languages(odd_docs)
    assert "en" in few.languages and langid.identify_language(odd_docs, few).count() == 10


def test_held_out_toxicity(spark, stored):
    docs, _ = stored
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = toxicity.train_toxicity(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in toxicity.score_toxicity(docs, machine).collect() if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    toxic = [r["predicted"] for r in held if truth[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in held if truth[r["doc_id"]] == 0]
    # about one toxic label in thirteen stands on a text of random noise, without any telling word
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.01


def test_pairs_mean_what_single_terms_do_not():
    rng = np.random.default_rng(3)
    docs, label = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        docs.append(np.asarray(sorted([*([0] if a else []), *([1] if b else []), 2 + rng.integers(5)]), dtype=np.int64))
        label.append(float(a == b))
    machine = toxicity.fit_machine(np.arange(7), docs, np.asarray(label))
    ask = lambda *t: machine.margins(np.zeros(len(t), dtype=int), np.asarray(t, dtype=int), 1)[0]
    assert ask(0, 1, 2) > 0 and ask(2) > 0 and ask(0, 2) < 0 and ask(1, 2) < 0


def test_scores_by_definition():
    machine = toxicity.Machine(np.asarray([11, 22]), -1.0, np.asarray([0.5, 2.0]), np.asarray([[1.0, 0], [0.5, 3]] + []))
    got = machine.margins(np.asarray([0, 0, 1]), np.asarray([0, 1, 1]), 3)
    assert got.tolist() == pytest.approx([-1 + 2.5 + 0.5, 1.0, -1.0])


def test_odd_documents_have_scores(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 0), (7, 1), (8, 0), (8, 1), (None, 1), (9, None), (99, 1)], "doc_id long, toxic int")
    for docs, marks in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        machine = toxicity.train_toxicity(docs, marks)
        rows = toxicity.score_toxicity(docs, machine).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.drop_toxic(odd_docs, toxicity.train_toxicity(odd_docs, labels.limit(0))).columns == odd_docs.columns


def test_words_match_whatever_surrounds_them():
    machine = toxicity.Machine(np.sort(np.asarray([toxicity.word_hash("idiot")])), -5.0, np.asarray([9.0]), np.zeros((1, 4)))
    score = toxicity.Scorer(machine).score(pa.array(["an Idiot!", "IDIOT%%%", "idiotic", "", "x " * 9000 + "(idiot)"], pa.large_string()))
    assert (score > 0.5).tolist() == [True, True, False, False, True]


def test_words_that_mean_something_only_together_pass_the_screen(spark):
    """Neither word deviates enough alone; the pair is toxic, also in rows never learnt from."""
    rng = random.Random(4)
    docs, marks, kind = [], [], {}
    for i in range(4000):
        both, green, river = i % 100 == 0, i % 100 < 15, i % 100 == 0 or 50 <= i % 100 < 64
        docs.append((i, " ".join([f"w{rng.randrange(60)}" for _ in range(6)] + ["green"] * green + ["river"] * river)))
        marks.append((i, int(both or rng.random() < 0.11)))
        kind[i] = green + river
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    machine = toxicity.train_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    held = [r for r in toxicity.score_toxicity(docs, machine).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["predicted"] == (kind[r["doc_id"]] == 2) for r in held) and {kind[r["doc_id"]] for r in held} == {0, 1, 2}


def test_a_label_of_both_or_neither_word_is_learnt(spark):
    """No single word says anything; only the machine's pair can."""
    rng = random.Random(8)
    docs, marks = [], {}
    for i in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append((f"k{i}", " ".join([f"w{rng.randrange(400)}" for _ in range(12)] + ["amber"] * a + ["birch"] * b)))
        marks[f"k{i}"] = int(a == b)
    docs = spark.createDataFrame(docs, "doc_id string, text string")
    machine = toxicity.train_toxicity(docs, spark.createDataFrame(list(marks.items()), "doc_id string, toxic int"))
    held = [r for r in toxicity.score_toxicity(docs, machine).collect() if zlib.crc32(r["doc_id"].encode()) % 4 == 2]
    assert np.mean([(r["score"] >= 0.5) == marks[r["doc_id"]] for r in held]) >= 0.95
