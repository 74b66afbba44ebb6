"""Registers the corpus pipeline at the top of the repository as query ``pipeline``."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL, run

QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
