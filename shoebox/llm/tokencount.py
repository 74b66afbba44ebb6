"""Token counts of whole texts, each distinct pre-token counted once.

A byte-level BPE never merges across its pre-tokens, so a text has as many tokens as its pre-tokens
together.  Texts become rows (document, pre-token, frequency).  Pre-tokens are counted by the
vocabulary's model, one encoding for each distinct one, joined to the frequencies and summed by
document.  No ids are kept or moved.

Pre-tokens are as skewed as words are, so there are two joins.  Some of the frequent ones, FREQUENT
of at most SHORT bytes, are counted beforehand and broadcast; a task joins them where the rows are
made and sends one sum a document.  All other rows are shuffled by pre-token and sorted, so that each
pre-token's rows follow each other and are joined to one count.  Which pre-tokens are broadcast is
read off a random sample of documents; it decides where a row is joined, never a count.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import bound_batches, ragged_take, slices, text_column
from .bpe_words import byte_alphabet, load_tokenizer
from .chunkbpe import BYTE_PATTERN
from .worker import hold

LIMIT = 1024
#: The broadcast holds at most FREQUENT * (SHORT + 12) bytes of keys and counts, 5 MB.
FREQUENT, SHORT = 65_536, 64
#: Documents of the sample, and bytes taken from each; a pre-token in a thousandth of all documents is in it almost surely.
SAMPLE, SAMPLE_BYTES = 20_000, 4096

#: Pieces of characters whose classes are the same in every Unicode version; others take the library's splitter.
_PLAIN = r"^[\t\n\r -~À-ÖØ-öø-ÿ]*$"
#: Splits many plain pieces at once, each ended by a character that no plain piece holds.
_END = "\x00"
_MANY = regex.compile(BYTE_PATTERN.replace(r"[^\s\p{L}", r"[^\x00\s\p{L}").replace(r"(?!\S)", r"(?![^\s\x00])") + r"|\x00")


def piece_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without any effect on their pre-tokens: at ``offsets`` and before single blanks.

    A blank between two characters that are no white space always begins a pre-token.  Neighbours
    count if they are printable ASCII or of U+00C0 to U+07FF, none of which is white space.
    """
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    if len(data) > 2:
        lead = (data >= 0xC3) & (data < 0xE0)
        shown = (data > 32) & (data < 127)
        begins, ends = shown | lead, shown
        ends[1:] |= lead[:-1] & (data[1:] >= 0x80) & (data[1:] < 0xC0)
        cut[1:-2] |= (data[1:-1] == 32) & ends[:-2] & begins[2:]
    return np.flatnonzero(cut)


class PreTokens:
    """Pre-tokens of texts and the number of tokens of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = load_tokenizer(path)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not re.search(r"\s", a["content"]) for a in added)
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or not plain:
            raise ValueError(f"{path}: needs a byte-level vocabulary without normaliser")
        self.alphabet = byte_alphabet()
        self.special = {a["content"] for a in added}
        self.around = re.compile("|".join(re.escape(a) for a in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def _odd(self, piece: str) -> list[str]:
        """The pre-tokens of one piece by the library, special strings apart."""
        found, at = [], 0
        for m in [*self.around.finditer(piece), None]:
            part = piece[at:m.start() if m else len(piece)]
            found += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)] if part else []
            if m:
                found.append(m.group())
                at = m.end()
        return found

    def split(self, pieces: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(pre-tokens end to end, number of pre-tokens of each piece)."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(pieces, s))
        plain = np.asarray(plain, dtype=bool)
        sizes = np.zeros(len(pieces), dtype=np.int64)
        found = _MANY.findall("".join(p + _END for p in pieces.filter(pa.array(plain)).to_pylist()))
        odd = [self._odd(p) for p in pieces.filter(pa.array(~plain)).to_pylist()]
        tokens = pa.array(found, pa.string())
        stop = np.asarray(pc.equal(tokens, _END), dtype=bool)
        sizes[plain] = np.diff(np.flatnonzero(stop), prepend=-1) - 1
        sizes[~plain] = [len(o) for o in odd]
        # plain pieces first, then the odd ones
        tokens = pa.concat_arrays([tokens.filter(pa.array(~stop)), pa.array([t for o in odd for t in o], pa.string())])
        begin = np.zeros(len(pieces), dtype=np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return tokens.take(pa.array(ragged_take(begin, sizes))).dictionary_encode(), sizes

    def tokens(self, pre_token: str) -> int:
        if pre_token in self.special:
            return 1
        return len(self.tokenizer.model.tokenize("".join(map(self.alphabet.__getitem__, pre_token.encode()))))

    def frequencies(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(text, pre-token, frequency) of each distinct pair, by pre-token: its runs are stored cheaply."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0]:offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        cuts = piece_offsets(data, offsets)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        tokens, sizes = self.split(coded.dictionary)
        piece = np.asarray(coded.indices, dtype=np.int64)
        codes = np.asarray(tokens.indices, dtype=np.int64)[ragged_take((np.cumsum(sizes) - sizes)[piece], sizes[piece])]
        text_of = np.repeat(np.searchsorted(offsets, cuts[:-1], "right") - 1, sizes[piece])
        both, count = np.unique(codes * len(texts) + text_of, return_counts=True)
        return both % len(texts), tokens.dictionary.take(pa.array(both // len(texts))), count


def pre_tokens(path: str) -> PreTokens:
    return hold("pre-tokens", path, lambda: PreTokens(path))


def frequent_pre_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text") -> pa.Table:
    """``(pre_token, n)`` of at most FREQUENT short pre-tokens that many documents of a random sample hold."""
    total = docs.count()
    drawn = docs.select(F.substring(docs[text_col], 1, SAMPLE_BYTES).alias("text")).sample(fraction=min(1.0, SAMPLE / max(total, 1)), seed=11)

    def run(batches):
        splitter = pre_tokens(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                _, names, _ = splitter.frequencies(text_column(batch, "text"))
                found = names.filter(pc.less_equal(pc.binary_length(names), SHORT)).value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["pre_token", "docs"])

    seen = drawn.mapInArrow(run, "pre_token string, docs long").groupBy("pre_token").agg(F.sum("docs").alias("docs"))
    best = seen.where("docs > 1").orderBy(F.desc("docs"), "pre_token").limit(FREQUENT).select("pre_token").toArrow()["pre_token"].combine_chunks()
    counter = PreTokens(tokenizer)
    return pa.table({"pre_token": best, "n": pa.array([counter.tokens(t) for t in best.to_pylist()], pa.int64())})


def pre_token_frequencies(docs: DataFrame, tokenizer: str, frequent: pa.Table, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, pre_token, frequency, n_tokens, n_bytes)``.

    ``key`` is a hash of the text; with the id it names the document, so that rows that repeat an id
    stay apart.  A document has one row without a pre-token, which holds its bytes and the tokens of
    its frequent pre-tokens, and one for each other pre-token with its frequency.
    """
    bound_batches(docs.sparkSession)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("key", T.LongType()), T.StructField("pre_token", T.StringType()),
        T.StructField("frequency", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()),
    ])
    shared = docs.sparkSession.sparkContext.broadcast((frequent["pre_token"].combine_chunks(), frequent["n"].to_numpy()))

    def run(batches):
        splitter = pre_tokens(tokenizer)
        common, counts = shared.value
        counts = np.append(counts, 0)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, ids = text_column(batch, "text"), batch.column("id")
                raw = [t.encode() for t in texts.to_pylist()]
                keys = np.asarray([xxhash.xxh3_64_intdigest(t) for t in raw], dtype=np.uint64).view(np.int64)
                n = len(raw)
                text_of, names, count = splitter.frequencies(texts)
                place = np.asarray(pc.fill_null(pc.index_in(names, common), -1), dtype=np.int64)
                known = np.bincount(text_of, weights=count * counts[place], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(known), pa.array([len(t) for t in raw], pa.int64())], names=schema.names)
                rest = np.flatnonzero(place < 0)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(text_of[rest])), pa.array(keys[text_of[rest]]), names.take(pa.array(rest)), pa.array(count[rest]), pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()),
                ], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def join_counts(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of :func:`pre_token_frequencies` with ``n_tokens`` filled in: frequency times the pre-token's count.

    Rows of one pre-token come to one task, sorted, so that it is counted at the first of them.
    """
    dealt = rows.repartition(F.coalesce("pre_token", F.col("key").cast("string"))).sortWithinPartitions("pre_token")

    def run(batches):
        counter = pre_tokens(tokenizer)
        last, tokens = None, 0
        for batch in batches:
            coded = batch.column("pre_token").dictionary_encode()
            counts = [tokens if t == last else counter.tokens(t) for t in coded.dictionary.to_pylist()]
            which = np.asarray(pc.fill_null(coded.indices, len(counts)), dtype=np.int64)
            made = np.append(np.asarray(counts, dtype=np.int64), 0)[which] * np.asarray(pc.fill_null(batch.column("frequency"), 0), dtype=np.int64)
            if batch.num_rows and which[-1] < len(counts):
                last, tokens = coded.dictionary[int(which[-1])].as_py(), counts[int(which[-1])]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("key"), pa.array(made + np.asarray(pc.fill_null(batch.column("n_tokens"), 0), dtype=np.int64)), batch.column("n_bytes"),
            ], names=["doc_id", "key", "n_tokens", "n_bytes"])

    return dealt.mapInArrow(run, rows.select("doc_id", "key", "n_tokens", "n_bytes").schema)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    Tokens are those of the tokenizers library without added special tokens, truncation or padding;
    special strings inside texts are one token each.  Null and empty texts have none.  Rows that
    repeat an id are counted each by its own text.  An empty table gives an empty result.
    """
    frequent = frequent_pre_tokens(docs, tokenizer, text_col)
    joined = join_counts(pre_token_frequencies(docs, tokenizer, frequent, id_col, text_col), tokenizer)
    total = joined.groupBy("doc_id", "key").agg(F.sum("n_tokens").alias("all"), F.count("n_bytes").alias("copies"), F.max("n_bytes").alias("n_bytes"))
    # equal texts under an equal id were summed together
    n = F.expr("`all` div copies")
    return total.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
