"""Language identification by interpolated Kneser-Ney character models.

Each language has one model of order ORDER over the letters of lower-cased words, each word
between blanks, so a word's log-probability depends on the word alone and is worked out once.
A model is a sorted array of n-gram hashes with their interpolated log-probabilities and one of
history hashes with their back-off weights; for scoring, the languages' arrays are merged into one,
so an n-gram is looked up once for all of them.  The language with the lowest cross-entropy per
symbol wins.  A text whose cross-entropy under the winner is far above what held-back texts of that
language show, for its length, is rejected.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import bound_batches, slices, sum_by_row, text_column
from .storage import materialize
from .terms import PieceTable, pieces_of
from .toxicity import held_out
from .worker import hold, let_go

ORDER = 5
#: Labelled texts of one language that its model is fitted on, about (chosen by hash of the id).
FIT_ROWS = 1_500
#: A rejected text lies this many times farther out than the farthest 1 in 1000 held-back texts,
#: and has at least this much more cross-entropy (nats per symbol) than they have on average.
FAR, EXCESS = 3.0, 0.7
UNKNOWN = "und"
PIECES_KEPT = 120_000
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)


def gram_hashes(symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """hashes[k-1][i]: of the k symbols that end at i; 0 where they would reach over ``first[i]``."""
    n, out = len(symbols), []
    at = np.arange(n)
    h = np.zeros(n, dtype=np.uint64)
    power = np.uint64(1)
    for k in range(1, ORDER + 1):
        back = at - (k - 1)
        inside = back >= first
        h = np.where(inside, h + (symbols[np.maximum(back, 0)].astype(np.uint64) + np.uint64(1)) * power, np.uint64(0))
        mixed = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        mixed ^= mixed >> np.uint64(32)
        out.append(np.where(inside, mixed | np.uint64(1), np.uint64(0)))
        with np.errstate(over="ignore"):
            power = np.uint64(int(power) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
    return out


def table_hashes(grams: list[str]) -> np.ndarray:
    """Hash of each n-gram, as ``gram_hashes`` gives it where the n-gram stands in a word."""
    lengths = np.asarray([len(g) for g in grams], dtype=np.int64)
    symbols = np.frombuffer("".join(grams).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    ends = np.cumsum(lengths)
    hashes = np.stack(gram_hashes(symbols, np.repeat(ends - lengths, lengths)))
    return hashes[lengths - 1, ends - 1]


@dataclass
class KneserNey:
    """One language: sorted hash arrays of n-grams and of histories."""

    grams: np.ndarray
    log_p: np.ndarray
    histories: np.ndarray
    log_gamma: np.ndarray
    floor: float

    @staticmethod
    def fit(counts: dict[str, int], alphabet: int) -> KneserNey:
        """``counts``: every n-gram of up to ORDER symbols with its occurrences."""
        used = dict(counts)
        left = Counter(g[1:] for g in counts if len(g) > 1)
        for g in counts:
            # lower orders count distinct left neighbours; a word's beginning has none
            if len(g) < ORDER and (g == " " or not g.startswith(" ")):
                used[g] = left[g]
        by_history: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for g, n in used.items():
            if n > 0:
                by_history[g[:-1]].append((g[-1], n))
        tally = defaultdict(Counter)
        for h, after in by_history.items():
            tally[len(h)].update(n for _, n in after if n <= 2)
        discount = {k: t[1] / max(1, t[1] + 2 * t[2]) if t[1] else 0.5 for k, t in tally.items()}
        probability: dict[str, float] = {}
        gamma: dict[str, float] = {}

        def lower(history: str, c: str) -> float:
            scale = 1.0
            while True:
                if history + c in probability:
                    return scale * probability[history + c]
                scale *= gamma.get(history, 1.0)
                if not history:
                    return scale / alphabet
                history = history[1:]

        for h in sorted(by_history, key=len):
            after, d = by_history[h], discount[len(h)]
            total = sum(n for _, n in after)
            gamma[h] = d * len(after) / total
            for c, n in after:
                rest = lower(h[1:], c) if h else 1 / alphabet
                probability[h + c] = max(n - d, 0) / total + gamma[h] * rest

        def arrays(table):
            hashes = table_hashes(list(table)) if table else np.zeros(0, dtype=np.uint64)
            order = np.argsort(hashes)
            return hashes[order], np.log(np.maximum(np.asarray(list(table.values())), 1e-12))[order]

        empty = gamma.pop("", 1.0)
        return KneserNey(*arrays(probability), *arrays(gamma), float(np.log(empty / alphabet)))


class Tables:
    """All languages in one sorted hash array, with a column of values for each language."""

    def __init__(self, models: list[KneserNey], kind=np.float32):
        every = [x for m in models for x in (m.grams, m.histories)]
        self.keys = np.unique(np.concatenate([*every, np.zeros(1, dtype=np.uint64)]))
        # the last row stands for what no language knows
        self.log_p = np.full((len(self.keys) + 1, len(models)), np.nan, dtype=kind)
        self.log_gamma = np.zeros((len(self.keys) + 1, len(models)), dtype=kind)
        for i, m in enumerate(models):
            self.log_p[np.searchsorted(self.keys, m.grams), i] = m.log_p
            self.log_gamma[np.searchsorted(self.keys, m.histories), i] = m.log_gamma
        self.floor = np.asarray([m.floor for m in models], dtype=kind)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        # short n-grams repeat a lot; hash 0 stands for an n-gram that would begin before its word
        distinct, back = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        return np.where((self.keys[at] == distinct) & (distinct != 0), at, len(self.keys))[back]

    def log_probability(self, hashes: list[np.ndarray], predicted: np.ndarray) -> np.ndarray:
        """(symbols x languages): of each symbol at ``predicted``, given those before it in its word."""
        out = np.zeros((len(predicted), len(self.floor)), dtype=self.floor.dtype)
        open_ = np.ones(out.shape, dtype=bool)
        here = self.places(hashes[ORDER - 1])
        for k in range(ORDER, 0, -1):
            value = self.log_p[here[predicted]]
            hit = open_ & ~np.isnan(value)
            np.add(out, value, out=out, where=hit)
            open_ &= ~hit
            if k > 1:
                here = self.places(hashes[k - 2])
                inside = (hashes[k - 1][predicted] != 0)[:, None]
                np.add(out, self.log_gamma[here[predicted - 1]], out=out, where=open_ & inside)
        np.add(out, self.floor[None], out=out, where=open_)
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    models: list[KneserNey]
    mean: np.ndarray
    scale: np.ndarray
    reach: np.ndarray


#: Words scored at a time; bounds the arrays of a step.
WORDS_STEP = 16_384


class Identifier:
    def __init__(self, model: LanguageModel, kind=np.float32):
        self.model, self.tables = model, Tables(model.models, kind)
        self.table = PieceTable(lambda new: [r.tobytes() for r in self.words(new).astype("<f4")], PIECES_KEPT)

    def words(self, pieces: list[str]) -> np.ndarray:
        """(pieces x (languages + 1)): log-probability under each model, then symbols predicted."""
        words, owner = [], []
        for i, piece in enumerate(pieces):
            for w in _LETTERS.findall(piece.lower()):
                words.append(w)
                owner.append(i)
        out = np.zeros((len(pieces), len(self.model.models) + 1))
        for low in range(0, len(words), WORDS_STEP):
            part = words[low:low + WORDS_STEP]
            symbols = np.frombuffer(("".join(f" {w} " for w in part)).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
            lengths = np.asarray([len(w) + 2 for w in part])
            first = np.repeat(np.cumsum(lengths) - lengths, lengths)
            predicted = np.flatnonzero(np.arange(len(symbols)) > first)
            each = np.repeat(np.asarray(owner[low:low + WORDS_STEP]), lengths - 1)
            found = self.tables.log_probability(gram_hashes(symbols, first), predicted)
            for i in range(found.shape[1]):
                out[:, i] += np.bincount(each, found[:, i], len(pieces))
            out[:, -1] += np.bincount(each, minlength=len(pieces))
        return out

    def totals(self, texts: pa.Array) -> np.ndarray:
        pieces, codes, count = pieces_of(texts)
        width = len(self.model.models) + 1
        records = np.frombuffer(b"".join(self.table.records(pieces)), dtype="<f4").reshape(-1, width).astype(np.float64)
        return np.stack([sum_by_row(records[codes, i], count) for i in range(width)], axis=1)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language index or -1, score, cross-entropy, accepted) of each text."""
        totals = self.totals(texts)
        n = totals[:, -1]
        model = self.model
        if not model.models:
            return np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), dtype=bool)
        entropy = -totals[:, :-1] / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1)
        own = entropy[np.arange(len(n)), best]
        # posterior of the winner, tempered: symbols of a word are far from independent
        score = 1 / np.exp((own[:, None] - entropy) * np.sqrt(n)[:, None]).sum(1)
        some = n > 0
        far = (own - model.mean[best]) * np.sqrt(n) / model.scale[best]
        accepted = some & ~((far > FAR * model.reach[best]) & (own > model.mean[best] + EXCESS))
        return np.where(some, best, -1), np.where(some, score, 0.0), np.where(some, own, 0.0), accepted


GRAMS = "lang string, gram string, n long"
FITTED = "lang string, grams binary, log_p binary, histories binary, log_gamma binary, floor double"


def _count(batches):
    """Occurrences of the n-grams of each language, summed over a slice."""
    let_go()
    for whole in batches:
        for batch in slices(whole, "text"):
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words[lang].update(_LETTERS.findall(text.lower()))
            rows = Counter()
            for lang, found in words.items():
                for word, n in found.items():
                    w = f" {word} "
                    for k in range(1, ORDER + 1):
                        for i in range(len(w) - k + 1):
                            rows[lang, w[i:i + k]] += n
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["lang", "gram", "n"])


def _fit(alphabet: int):
    """One language's n-gram counts -> one row with its model."""

    def run(table: pa.Table) -> pa.Table:
        m = KneserNey.fit(dict(zip(table["gram"].to_pylist(), table["n"].to_pylist())), alphabet)
        blobs = [m.grams.astype("<u8"), m.log_p.astype("<f4"), m.histories.astype("<u8"), m.log_gamma.astype("<f4")]
        return pa.table([pa.array([table["lang"][0].as_py()]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([m.floor])], names=["lang", "grams", "log_p", "histories", "log_gamma", "floor"])

    return run


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on about ``rows`` labelled texts of each language that are not held out.

    Learns from text and non-null language only.  A quarter of the sample is held back to
    calibrate rejection.  Without labelled texts there are no languages and every text is ``und``.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return LanguageModel([], [], np.zeros(0), np.zeros(0), np.zeros(0))
    share = spark.createDataFrame([(k, min(1.0, rows / n)) for k, n in sizes.items()], "lang string, share double")
    place = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30))
    sample = known.join(F.broadcast(share), "lang").where(place < F.col("share")).select("id", "lang", "text", (F.crc32("id") % 4 == 1).alias("check"))
    sample = materialize(sample, "languages")

    # a language whose texts were all held back is fitted on those
    whole = [r["lang"] for r in sample.groupBy("lang").agg(F.count_if(~F.col("check")).alias("n")).where("n = 0").collect()]
    grams = sample.where(~F.col("check") | F.col("lang").isin(whole)).select("lang", "text").mapInArrow(_count, GRAMS)
    grams = materialize(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    alphabet = grams.where(F.length("gram") == 1).select("gram").distinct().count() + 1
    # one language's n-grams are bounded by its sample; only sorted arrays reach the driver
    fitted = sorted(grams.groupBy("lang").applyInArrow(_fit(alphabet), FITTED).collect(), key=lambda r: r["lang"])
    languages = [r["lang"] for r in fitted]
    arrays = [[np.frombuffer(r[c], dtype=kind) for c, kind in (("grams", "<u8"), ("log_p", "<f4"), ("histories", "<u8"), ("log_gamma", "<f4"))] for r in fitted]
    model = LanguageModel(languages, [KneserNey(*x, r["floor"]) for x, r in zip(arrays, fitted)], np.zeros(len(languages)), np.ones(len(languages)), np.zeros(len(languages)))
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def measure(batches):
        identifier = _identifier(shared)
        for whole in batches:
            for batch in slices(whole, "text"):
                totals = identifier.totals(text_column(batch, "text"))
                index = np.asarray([languages.index(x) if x in languages else -1 for x in batch.column("lang").to_pylist()])
                n = totals[:, -1]
                own = -totals[np.arange(len(n)), index] / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(own), pa.array(n)], names=["i", "entropy", "n"])

    measured = sample.where("check").select("lang", "text").mapInArrow(measure, "i long, entropy double, n double").where("n > 0 and i >= 0").collect()
    shared.destroy()
    for i in range(len(languages)):
        own = [(r["entropy"], r["n"]) for r in measured if r["i"] == i]
        if len(own) < 10:
            model.mean[i], model.scale[i], model.reach[i] = np.inf, 1.0, np.inf  # too few to reject by
            continue
        entropy, n = np.asarray(own).T
        model.mean[i] = np.average(entropy, weights=n)
        model.scale[i] = max(1e-6, np.sqrt(np.mean((entropy - model.mean[i]) ** 2 * n)))
        model.reach[i] = np.quantile((entropy - model.mean[i]) * np.sqrt(n) / model.scale[i], 0.999)
    return model


def _identifier(shared) -> Identifier:
    return hold("languages", shared.value, lambda: Identifier(shared.value))


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, entropy, accepted)``, one row per input row.

    Whole texts are read.  A null text or one without a letter is ``und`` with score 0 and not
    accepted.  Any other text has a learnt language; ``accepted`` is false if even that one fits far
    worse than calibration allows.  Ties go to the language that sorts first.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType()),
    ])

    def run(batches):
        identifier = _identifier(shared)
        names = [*shared.value.languages, UNKNOWN]
        for whole in batches:
            for batch in slices(whole, "text"):
                best, score, entropy, accepted = identifier.predict(text_column(batch, "text"))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score), pa.array(entropy), pa.array(accepted),
                ], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose language is accepted."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        identifier = _identifier(shared)
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array(identifier.predict(text_column(batch, text_col))[3]))

    return docs.mapInArrow(run, docs.schema)
