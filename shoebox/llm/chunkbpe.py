"""Byte-level BPE with content-defined chunk reuse.

Texts are cut where a rolling hash over their bytes falls on a mask, so passages that documents
share give the same chunks.  A worker encodes each distinct chunk once and keeps its ids under the
chunk's digest.  A cut may fall inside a word, so every join between two chunks is then repaired: a
window of tokens around it is encoded anew, and must agree at both ends with the ids that the two
chunks have there; while it does not, it grows by a chunk on either side.

Chunks are shared within a worker, not over the cluster: that would move every text, and costs more
than it saves (README has figures).

Why agreement is exact.  The pre-tokenizer reads left to right without looking back, and a blank
between two non-blank characters always begins a new pre-token (an *anchor*).  Ids left of an
anchor do not depend on what is right of it, and the reverse.  A window that reaches from an anchor
in the left chunk to one in the right chunk therefore gives the ids of the whole text there, and ids
outside it are already right.  A chunk without an anchor is merged into the window.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T

from .batches import TwoGenerations, bound_batches, slices, text_column
from .bpe_words import byte_alphabet, load_tokenizer
from .worker import hold

WINDOW = 32
#: One byte position in 2**CUT_BITS ends a chunk, on average.
CUT_BITS = 11
LEAST, MOST = 256, 32768
#: Distinct chunks that a worker keeps in each of two generations, about 1.2 KB each.
CHUNKS_KEPT = 16_000
#: Fixed value: the split pattern of the byte-level pre-tokenizer.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: An anchor stands before the blank.  Only ASCII neighbours count, which is stricter than needed.
_ANCHOR = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def _anchors(chunk: bytes) -> tuple[int, int, int, int]:
    """A chunk's first two anchors and its last two; -1 where absent."""
    found = _ANCHOR.search(chunk)
    if not found:
        return -1, -1, -1, -1
    first, found = found.start(), _ANCHOR.search(chunk, found.start() + 1)
    last, at = [], len(chunk) - 1
    while len(last) < 2 and (at := chunk.rfind(b" ", first, at)) >= 0:
        if _ANCHOR.match(chunk, at):
            last.append(at)
    return first, found.start() if found else -1, last[1] if len(last) > 1 else -1, last[0]


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each position."""
    mix = 0x9E3779B1
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(mix)
    h ^= h >> np.uint32(13)
    width, factor = 1, mix
    while width < WINDOW:
        add = h[:-width] * np.uint32(factor)
        h = h.copy()
        h[width:] += add
        factor = factor * factor & 0xFFFFFFFF
        width *= 2
    h ^= h >> np.uint32(16)
    return h * np.uint32(0x85EBCA6B)


def cut_points(data: np.ndarray, marks: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end], all at character borders."""
    cuts, last = [], start
    for mark in [*marks[np.searchsorted(marks, start, "right"):np.searchsorted(marks, end, "left")].tolist(), end]:
        while mark - last > MOST:
            at = last + MOST
            while data[at] & 0xC0 == 0x80:
                at -= 1
            cuts.append(at)
            last = at
        if mark == end or mark - last >= LEAST:
            cuts.append(mark)
            last = mark
    return cuts


class ChunkEncoder:
    """Exact ids of whole texts, by way of chunks."""

    def __init__(self, path: str, keep: int = CHUNKS_KEPT):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = load_tokenizer(path)
        back = {c: b for b, c in byte_alphabet().items()}
        vocabulary = spec["model"]["vocab"]
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.piece = {i: bytes(map(back.__getitem__, p)) for p, i in vocabulary.items() if p not in added} | {i: p.encode() for p, i in added.items()}
        self.lengths = np.zeros(max(self.piece) + 1, dtype=np.int64)
        for i, p in self.piece.items():
            self.lengths[i] = len(p)
        if spec.get("normalizer") or any(re.search(r"\s", a) for a in added):
            raise ValueError(f"{path}: needs a byte-level vocabulary without normaliser")
        self.fast = self._ranked(spec, added)
        self.known, self.kept = TwoGenerations(keep), np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32
        #: Bytes of chunks that were encoded, and of chunks whose ids were at hand.
        self.encoded, self.reused = 0, 0

    def _ranked(self, spec, added):
        """The same vocabulary as merge ranks, if its merges are numbered in order; else None."""
        pre, model = spec["pre_tokenizer"], spec["model"]
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = [vocabulary["".join(p)] for p in pairs]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("dropout") and not model.get("ignore_merges")
        free = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not a["normalized"] for a in spec["added_tokens"])
        if not (plain and free and all(a < b for a, b in zip(ranks, ranks[1:]))):
            return None
        import tiktoken

        merged = {self.piece[i]: i for i in vocabulary.values() if i not in added.values()}
        return tiktoken.Encoding("chunks", pat_str=BYTE_PATTERN, mergeable_ranks=merged, special_tokens=added)

    def _plain(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.fast.encode(text, allowed_special="all"), dtype=np.uint32)

    def _chunk(self, chunk: bytes) -> tuple:
        """(ids, byte position after each id, its first two anchors, its last two)."""
        name = xxhash.xxh3_128_digest(chunk)
        found = self.known.find(name)
        if found is None:
            ids = self._plain(chunk.decode())
            found = ids.astype(self.kept).tobytes(), _anchors(chunk)
            self.known.put(name, found)
            self.encoded += len(chunk)
        else:
            ids = np.frombuffer(found[0], dtype=self.kept).astype(np.uint32)
            self.reused += len(chunk)
        return ids, np.cumsum(self.lengths[ids], dtype=np.int32), *found[1]

    def encode(self, data: bytes, cuts: list[int], start: int) -> np.ndarray:
        """Ids of one text; ``cuts`` are the ends of its chunks within ``data``."""
        none = np.zeros(0, dtype=np.uint32)
        settled: list[tuple[int, np.ndarray]] = []  # runs of ids, each with the place where its bytes begin
        # data[open_:last] is not settled yet; ``known`` are ids already settled for its beginning
        open_, known, last = start, none, start
        for cut in cuts:
            chunk, begun = data[last:cut], last
            last = cut
            ids, ends, first, second, before, final = self._chunk(chunk)
            at = lambda anchor: int(np.searchsorted(ends, anchor, "right"))  # noqa: E731, B023
            if open_ == begun:
                begin = 0
            elif first < 0:
                continue
            else:
                begin = at(first)
                overlap = ids[begin:at(second)] if second >= 0 else none
                window = self._plain(data[open_:begun + (second if second >= 0 else first)].decode())
                stop = len(window) - len(overlap)
                if not (np.array_equal(window[:len(known)], known) and np.array_equal(window[stop:], overlap)):
                    # a chunk more on either side: the run settled last is open again, and so is this chunk
                    open_, known = settled.pop()[0] if settled else start, none
                    continue
                settled.append((open_, window[len(known):stop]))
            if final < 0:
                open_, known = begun, none
                continue
            stop = at(final)
            settled.append((begun + (first if begin else 0), ids[begin:stop]))
            low = max(before, first) if begin else before
            if low >= 0 and low < final:
                open_, known = begun + low, ids[at(low):stop]
            else:
                open_, known = begun + final, none
        out = [ids for _, ids in settled]
        if open_ < last:
            out.append(self._plain(data[open_:last].decode())[len(known):])
        return np.concatenate(out) if out else none

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' text, special tokens included; broken UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.piece.__getitem__, ids.tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def chunk_encoder(path: str) -> ChunkEncoder:
    return hold("chunks", path, lambda: ChunkEncoder(path))


def encode_column(encoder: ChunkEncoder, texts: pa.Array) -> list[np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = buffer.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if buffer is not None else b""
    offsets = offsets - offsets[0]
    view = np.frombuffer(data, dtype=np.uint8)
    marks = np.flatnonzero((rolling_hash(view) >> np.uint32(32 - CUT_BITS)) == 0) + 1
    inside = marks[marks < len(view)]
    marks = inside[(view[inside] & 0xC0) != 0x80]
    return [
        encoder.encode(data, cut_points(view, marks, a, b) if b > a else [], a)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
    ]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids binary little-endian uint32, n_tokens long)``, one row per input row.

    The ids are those of the tokenizers library over the whole text without added special tokens,
    truncation or padding.  Null and empty texts have no ids.  Needs no shuffle.
    """
    bound_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        encoder = chunk_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = encode_column(encoder, text_column(batch, "text"))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                ], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, text_utf8 binary)``: the text that the ids stand for, special tokens kept.

    Null ids give a null text.
    """
    schema = T.StructType([T.StructField("doc_id", encoded.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("text_utf8", T.BinaryType())])

    def run(batches):
        encoder = chunk_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "ids"):
                texts = [None if raw is None else encoder.decode(np.frombuffer(raw, dtype="<u4")) for raw in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(texts, pa.binary())], names=schema.names)

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, schema)
