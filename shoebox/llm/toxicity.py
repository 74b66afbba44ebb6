"""Toxicity scores from a factorisation machine over hashed terms.

Score = sigmoid(b + sum w_i + sum over pairs i<j <v_i, v_j>) over the distinct terms of a whole
text.  The pairwise part lets two terms mean together what neither does alone.  Terms are
lower-cased words and their beginnings of PREFIXES characters, under 62-bit hashes, so collisions
do not matter.  The machine is fitted on a bounded sample of labelled rows; terms without a
measurable link to the label, alone or in a pair of words, are screened out first.  Every term
that passes is learnt: a term needs TERM_ROWS rows of the sample, which bounds their number.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import bound_batches, slices, text_column
from .storage import materialize
from .terms import PieceTable, pieces_of
from .worker import hold, let_go

#: Labelled rows used for fitting at most: the smallest by hash of the id.
FIT_ROWS = 16_000
#: Rows that a term must be in, and its deviation from the base rate if it is to pass alone.
TERM_ROWS, TERM_Z = 5, 5.0
#: Rows of the rarer label that a word of the pair screen must be in, pairs let through by chance, words compared at a time.
PAIR_ROWS, PAIR_CHANCE, PAIR_BLOCK = 10, 0.01, 512
PREFIXES = (4, 5, 6, 7, 8)
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 40, 256, 0.2, 1e-5
#: A score from here on is a rejection.
REJECT_AT = 0.3
_WORD = re.compile(r"\w+")
_MASK = (1 << 62) - 1
PIECES_KEPT = 120_000


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest("w" + word) & _MASK


def prefix_hash(prefix: str) -> int:
    """Hash of a word's beginning; words and beginnings never share one."""
    return xxhash.xxh64_intdigest(f"p{len(prefix)}{prefix}") & _MASK


def term_hashes(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [word_hash(word), *(prefix_hash(word[:n]) for n in PREFIXES if len(word) >= n)]


@dataclass
class Machine:
    """``terms`` sorted; row i of ``weights`` and ``factors`` belongs to ``terms[i]``."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Margins of ``n`` texts from (text, term index) pairs without repeats."""
        linear = np.bincount(row, self.weights[term], n)
        pairwise = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            pairwise += np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)
        return self.bias + linear + pairwise / 2


def fit_machine(terms: np.ndarray, docs: list[np.ndarray], label: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss, AdaGrad over small batches in a fixed random order."""
    rng = np.random.default_rng(seed)
    k = len(terms)
    weights, factors = np.zeros(k), rng.normal(0, 0.01, (k, FACTORS))
    rate = float(label.mean()) if len(label) else 0.0
    bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    machine = Machine(terms, bias, weights, factors)
    g_w, g_v, g_b = np.full(k, 1e-6), np.full((k, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if k else 0):
        order = rng.permutation(len(docs))
        for low in range(0, len(order), BATCH):
            rows = order[low:low + BATCH]
            sizes = np.asarray([len(docs[i]) for i in rows])
            term = np.concatenate([docs[i] for i in rows])
            row = np.repeat(np.arange(len(rows)), sizes)
            error = 1 / (1 + np.exp(-np.clip(machine.margins(row, term, len(rows)), -30, 30))) - label[rows]
            g = float(error.mean())
            g_b += g * g
            machine.bias -= RATE * g / g_b ** 0.5
            step = np.bincount(term, error[row], k) / len(rows)
            seen = np.unique(term)
            gradient = step[seen] + DECAY * weights[seen]
            g_w[seen] += gradient ** 2
            weights[seen] -= RATE * gradient / np.sqrt(g_w[seen])
            for f in range(FACTORS):
                v = factors[term, f]
                total = np.bincount(row, v, len(rows))
                grad = np.bincount(term, error[row] * (total[row] - v), k)[seen] / len(rows) + DECAY * factors[seen, f]
                g_v[seen, f] += grad ** 2
                factors[seen, f] -= RATE / 4 * grad / np.sqrt(g_v[seen, f])
    return machine


def joint_evidence(row: np.ndarray, term: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """For each of ``k`` terms, the strongest evidence of a pair it is in, 0 below chance level.

    ``(row, term)`` says which row holds which term, without repeats.  A pair's evidence is rows x
    divergence of its label rate from the nearest rate that its terms explain: anything between
    the base rate, the two single rates and their sum in log odds.  The chance of so much evidence
    is at most exp(-evidence), so log(pairs / PAIR_CHANCE) is asked for.
    """
    out = np.zeros(k)
    label = label if label.mean() <= 0.5 else 1 - label
    n, p = np.bincount(term, minlength=k), np.bincount(term, label[row], k)
    # terms of the same rows are one
    rows_of = np.zeros(k, dtype=np.uint64)
    np.add.at(rows_of, term, np.random.default_rng(1).integers(0, 1 << 63, len(label), dtype=np.uint64)[row])
    able = np.flatnonzero(p >= PAIR_ROWS)
    _, first, group = np.unique(rows_of[able], return_index=True, return_inverse=True)
    if len(first) < 2:
        return out
    chosen = able[first]
    place = np.full(k, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    at = place[term]
    row, at = row[at >= 0], at[at >= 0]
    odds = lambda r: np.log(r / (1 - r))
    base, rate, found = float(label.mean()), (p[chosen] + 0.5) / (n[chosen] + 1), np.zeros(len(chosen))
    enough = np.log(len(chosen) * (len(chosen) - 1) / 2 / PAIR_CHANCE)

    # a pair rarer in labelled rows than ``least`` and in all rows than ``often`` cannot have enough evidence
    least, often = enough / -np.log(base), enough / -np.log1p(-base)
    toxic = np.flatnonzero(label)

    def packed(row, at, rows):
        bits = np.zeros((len(chosen), -(-rows // 64)), dtype=np.uint64)
        np.bitwise_or.at(bits, (at, row // 64), np.uint64(1) << (row % 64).astype(np.uint64))
        return bits

    def weigh(a, b, c):
        """Raise ``found`` by the pairs (a, b), of which ``c`` rows are labelled."""
        m = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64).astype(float)
        a, b, c, m = a[m > 0], b[m > 0], c[m > 0], m[m > 0]
        r, q = rate[a], rate[b]
        explained = np.stack([r, q, 1 / (1 + np.exp(odds(base) - odds(r) - odds(q))), np.full(len(r), base)])
        spot = c / m
        null = np.clip(spot, explained.min(0), explained.max(0))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(c > 0, c * np.log(spot / null), 0) + np.where(c < m, (m - c) * np.log((1 - spot) / (1 - null)), 0)
        sure = gain >= enough
        np.maximum.at(found, a[sure], gain[sure])
        np.maximum.at(found, b[sure], gain[sure])

    on = label[row] > 0
    bits = packed(row, at, len(label))
    marked = np.zeros((len(chosen), len(toxic)), dtype=np.float32)
    marked[at[on], np.searchsorted(toxic, row[on])] = 1
    common = n[chosen] >= often
    for low in range(0, len(chosen), PAIR_BLOCK):
        near = common[low:low + PAIR_BLOCK]
        # every word of the block with itself and with all later ones
        for other in range(low, len(chosen), 8 * PAIR_BLOCK):
            hit = marked[low:low + PAIR_BLOCK] @ marked[other:other + 8 * PAIR_BLOCK].T
            may = (hit >= least) | (near[:, None] & common[other:other + 8 * PAIR_BLOCK][None])
            i, j = np.nonzero(may)
            h, i, j = hit[i, j].astype(float), low + i, other + j
            later = j > i
            h, i, j = h[later], i[later], j[later]
            for k0 in range(0, len(i), 4096):
                weigh(i[k0:k0 + 4096], j[k0:k0 + 4096], h[k0:k0 + 4096])
    out[able] = found[group]
    return out


class Scorer:
    """Scores of whole texts; pieces that hold no known term cost one lookup."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.index = {int(t): i for i, t in enumerate(machine.terms)}
        self.table = PieceTable(self._terms, PIECES_KEPT)

    def _terms(self, pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            found = [self.index[t] for word in words_of(piece) for t in term_hashes(word) if t in self.index]
            out.append(struct.pack(f"<{len(found)}i", *found))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        pieces, codes, count = pieces_of(texts)
        records = self.table.records(pieces)
        sizes = np.asarray([len(r) // 4 for r in records], dtype=np.int64)
        pool = np.frombuffer(b"".join(records), dtype="<i4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(count)), count)
        hit = np.flatnonzero(sizes[codes]) if len(codes) else codes
        row, code = row[hit], codes[hit]
        each = sizes[code]
        at = np.repeat(starts[code] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        k = max(1, len(self.machine.terms))
        pairs = np.unique(np.repeat(row, each) * k + pool[at])
        margin = self.machine.margins(pairs // k, pairs % k, len(count))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def held_out(id_col: str) -> F.Column:
    """Rows never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _counts(batches):
    """Rows and toxic rows of every word and word beginning, hashed once for each slice."""
    let_go()
    for whole in batches:
        for batch in slices(whole, "text"):
            of = {kind: (Counter(), Counter()) for kind in (word_hash, prefix_hash)}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = words_of(text)
                for kind, terms in ((word_hash, words), (prefix_hash, {w[:k] for w in words for k in PREFIXES if len(w) >= k})):
                    of[kind][0].update(terms)
                    if label:
                        of[kind][1].update(terms)
            terms = [kind(t) for kind, (n, _) in of.items() for t in n]
            n = [x for n, _ in of.values() for x in n.values()]
            p = [p[t] for n, p in of.values() for t in n]
            word = [kind is word_hash for kind, (n, _) in of.items() for _ in n]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(word), pa.array(n, pa.int64()), pa.array(p, pa.int64())], names=["term", "word", "n", "p"])


def _encoded(sample: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index into the sorted ``terms``, label by row) of the sample in a fixed order.

    Bounded by the sample's rows, and by the terms, which are few of a text's.
    """
    index = {int(t): i for i, t in enumerate(terms)}

    def encode(batches):
        let_go()
        for whole in batches:
            for batch in slices(whole, "text"):
                known: dict[str, list[int]] = {}
                found = []
                for text in batch.column("text").to_pylist():
                    held = set()
                    for w in words_of(text):
                        if w not in known:
                            known[w] = [index[t] for t in term_hashes(w) if t in index]
                        held.update(known[w])
                    found.append(np.asarray(sorted(held), dtype="<i4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "terms"])

    # sorted here: an ordered exchange would run the stage twice, to sample it
    got = sample.mapInArrow(encode, "id string, label int, terms binary").select(F.xxhash64("id").alias("at"), "id", "label", "terms").toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[(c, "ascending") for c in ("at", "id", "terms")]))
    label = np.asarray(got["label"], dtype=np.float64)
    sizes = np.asarray(pc.binary_length(got["terms"]), dtype=np.int64) // 4
    term = np.concatenate([np.zeros(0, dtype="<i4"), *(np.frombuffer(t, dtype="<i4") for t in got["terms"].to_pylist())])
    return np.repeat(np.arange(len(label), dtype=np.int32), sizes), term, label


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents that are not held out.

    Repeated labels of one document are averaged (half and more: toxic); null labels, ids and
    labels without a document are ignored.  A document that stands in several rows counts once
    for each.  Ids of any type are compared as text.  Without labels the score is the prior, near 0.
    """
    bound_batches(docs.sparkSession)
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("string").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    texts = docs.select(docs[id_col].cast("string").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sample = materialize(texts.join(F.broadcast(picked), "id").select("id", "text", "label"), "labelled")  # bounded by ``rows``

    size, base = sample.agg(F.count("*"), F.avg("label")).first()
    if not size or not base or base == 1:
        return Machine(np.zeros(0, dtype=np.int64), -6.0 if not base else 6.0, np.zeros(0), np.zeros((0, FACTORS)))
    counted = sample.mapInArrow(_counts, "term long, word boolean, n long, p long").groupBy("term", "word").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    deviation = (F.col("p") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    rarer = F.expr("p" if base <= 0.5 else "n - p")
    counts = (
        counted.where(F.col("n") >= TERM_ROWS).select("term", "word", (F.abs(deviation) >= TERM_Z).alias("alone"), (F.col("word") & (rarer >= PAIR_ROWS)).alias("paired"))
        .where("alone or paired").toArrow().sort_by("term")
    )
    term, alone, paired = (np.asarray(counts[c]) for c in ("term", "alone", "paired"))
    row, at, label = _encoded(sample, term)
    as_word = np.where(paired, np.cumsum(paired) - 1, -1)[at]
    joint = np.zeros(len(term))
    joint[paired] = joint_evidence(row[as_word >= 0], as_word[as_word >= 0], label, int(paired.sum()))
    kept = alone | (joint > 0)
    place = np.where(kept, np.cumsum(kept) - 1, -1)[at]
    row, place = row[place >= 0], place[place >= 0]
    return fit_machine(term[kept], np.split(place, np.searchsorted(row, np.arange(1, len(label)))), label)


def _scorer(shared) -> Scorer:
    return hold("toxicity", shared.value, lambda: Scorer(shared.value))


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score double, predicted int)``, one row per input row.

    Whole texts are scored.  Null and empty texts have the score of a text without terms.  Equal
    texts have equal scores.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the sample
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        scorer = _scorer(shared)
        for whole in batches:
            for batch in slices(whole, "text"):
                score = scorer.score(text_column(batch, "text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= REJECT_AT).astype(np.int32))], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose score is below REJECT_AT."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        scorer = _scorer(shared)
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array(scorer.score(text_column(batch, text_col)) < REJECT_AT))

    return docs.mapInArrow(run, docs.schema)
