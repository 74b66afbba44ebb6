"""Whole-column token ids for BPE vocabularies whose pieces never reach across white space.

``WordEncoder`` gives the same ids as the tokenizers library run over whole texts.  It may cut
a text at ASCII white space because, for the vocabularies it accepts (see ``_splittable``), the
normaliser turns white space into separators, the pre-tokenizer drops them, and neither they nor
special tokens reach over one.  So each distinct piece of a batch is encoded once, and a text's
ids are gathered from its pieces' ids.  Plain pieces are cut into pre-tokens here, and all distinct
pre-tokens of a batch go through one call of a merge-rank encoder; other pieces take the library.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import ragged_take, sum_by_row
from .worker import hold

#: The split pattern that the fast path below repeats for Latin letters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LATIN = "a-zß-öø-ÿ"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte value."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_tokenizer(path: str):
    """The library's tokenizer with truncation and padding off, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _splittable(spec: dict) -> tuple[bool, bool]:
    """(ids may be made piece by piece, pieces of plain Latin text may skip the normaliser)."""
    norms = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
    kinds = [n.get("type") for n in norms]
    pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    pre = pres[0] if pres else {}
    drops = pre.get("type") == "Split" and pre.get("behavior") == "Removed" and pre.get("invert") and pre["pattern"].get("Regex") == WORD_PATTERN
    plain_added = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not re.search(r"\s", a["content"]) for a in spec["added_tokens"])
    cuts = bool(drops and plain_added and set(kinds) <= {"NFC", "Replace", "Lowercase"})
    level = len(pres) == 2 and pres[1].get("type") == "ByteLevel" and not pres[1].get("add_prefix_space") and not pres[1].get("use_regex")
    return cuts, cuts and bool(level) and kinds == ["NFC", "Replace", "Lowercase"]


class MergeRanks:
    """The vocabulary's merges as ranks: ids of many pre-tokens in one call.

    A byte that plain text never holds ends each pre-token and stands for the end-of-word mark.
    ``None`` comes from :meth:`of` if the vocabulary's merges are not numbered in order.
    """

    END = b"\x00"

    def __init__(self, ranks: dict[bytes, int], ends: np.ndarray):
        import tiktoken

        self.ends = ends
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, spec: dict) -> MergeRanks | None:
        model = spec["model"]
        suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
        ids = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        alike = not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        if not (suffix and alike and all(a < b for a, b in zip(ids, ids[1:]))):
            return None
        back = {c: b for b, c in byte_alphabet().items()}
        top = max(vocabulary.values())
        ranks, ends = {}, np.zeros(top + 2, dtype=bool)
        for token, i in vocabulary.items():
            last = token.endswith(suffix)
            raw = bytes(map(back.__getitem__, token.removesuffix(suffix) if last else token))
            if cls.END not in raw:
                ranks[raw + cls.END if last else raw] = i
                ends[i] = last
        # single bytes and single bytes with the mark come before all merges, so the mark joins its byte first
        if any(bytes([b]) + cls.END not in ranks or ranks[bytes([b]) + cls.END] >= ids[0] for b in range(1, 256)):
            return None
        return cls(ranks | {cls.END: top + 1}, ends)

    def encode(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each pre-token)."""
        if not cores:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        mark = self.END.decode()
        ids = self.encoding.encode_to_numpy(mark.join(cores) + mark, allowed_special=set(), disallowed_special=())
        ends = np.flatnonzero(self.ends[ids]) + 1
        return ids, np.diff(ends, prepend=0)


class WordEncoder:
    """``encode(texts)`` -> (all ids as uint32, number of ids of each text)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as little-endian 32-bit words")
        self.tokenizer = load_tokenizer(path)
        self.by_piece, by_model = _splittable(spec)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = re.compile("|".join(re.escape(a["content"]) for a in spec["added_tokens"]) or r"(?!)")
        self.ranks = MergeRanks.of(spec) if by_model else None

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each piece)."""
        cores: dict[str, int] = {}
        codes, per, odd = [], [], []
        for piece in pieces:
            if self.ranks is not None and (piece.isprintable() if piece.isascii() else _PLAIN.fullmatch(piece)):
                lower = piece.lower()
                if lower.isalpha():
                    codes.append(cores.setdefault(lower, len(cores)))
                    per.append(1)
                    continue
                if not self.special.search(piece):
                    found = _SPLIT.findall(lower)
                    codes += [cores.setdefault(c, len(cores)) for c in found]
                    per.append(len(found))
                    continue
            odd.append(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            codes.append(-len(odd))
            per.append(1)
        ids, sizes = self.ranks.encode(list(cores)) if self.ranks is not None else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        pool = np.concatenate([ids, np.asarray([i for x in odd for i in x], dtype=np.uint32)])
        sizes = np.concatenate([sizes, np.asarray([len(x) for x in odd], dtype=np.int64)])
        code = np.asarray(codes, dtype=np.int64)
        code = np.where(code < 0, len(cores) - code - 1, code)
        each = sizes[code]
        return pool[ragged_take((np.cumsum(sizes) - sizes)[code], each)], sum_by_row(each, np.asarray(per, dtype=np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            found = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            counts = np.asarray([len(e.ids) for e in found], dtype=np.int64)
            return np.asarray([i for e in found for i in e.ids], dtype=np.uint32), counts
        pieces = pc.ascii_split_whitespace(texts)
        pieces_of = np.diff(np.asarray(pieces.offsets, dtype=np.int64))
        distinct = pieces.flatten().dictionary_encode()
        pool, lengths = self._pieces(distinct.dictionary.to_pylist())
        codes = np.asarray(distinct.indices, dtype=np.int64)
        each = lengths[codes]
        ids = pool[ragged_take((np.cumsum(lengths) - lengths)[codes], each)]
        return ids.astype(np.uint32, copy=False), sum_by_row(each, pieces_of)


def word_encoder(path: str) -> WordEncoder:
    return hold("words", path, lambda: WordEncoder(path))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every document."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32, copy=False), counts + 1
