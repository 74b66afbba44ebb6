"""Distinct white-space pieces of a batch of texts, and what each stands for, worked out once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import TwoGenerations


def pieces_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, code of each occurrence, occurrences of each text)."""
    pieces = pc.ascii_split_whitespace(texts)
    count = np.diff(np.asarray(pieces.offsets, dtype=np.int64))
    coded = pieces.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64), count


class PieceTable:
    """Fixed-size records (bytes) of pieces, computed in bulk and kept in a bounded cache."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]], keep: int):
        self.compute, self.known = compute, TwoGenerations(keep)

    def records(self, pieces: list[str]) -> list[bytes]:
        find = self.known.find
        out = [find(p) for p in pieces]
        new = [i for i, r in enumerate(out) if r is None]
        if new:
            for i, record in zip(new, self.compute([pieces[i] for i in new])):
                out[i] = record
                if len(pieces[i]) <= 64:
                    self.known.put(pieces[i], record)
        return out
