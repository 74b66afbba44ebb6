"""Label logs: totals, latest state, and per-item enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import ranks


def totals(log: DataFrame) -> DataFrame:
    """Attempts, successes and failures of an append log; retries count again."""
    return log.agg(F.count("*").alias("count"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def latest_success(log: DataFrame) -> DataFrame:
    """The last successful row of each path by ``seq``; failures never hide a success."""
    return log.where("error is null").groupBy("path").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))


def last_row_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``.  Partial aggregation, so a hot key costs no window."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}") for c in rows.columns])


def pending(scanned: DataFrame, done: DataFrame, key: str = "path", most: int | None = None) -> DataFrame:
    """Scanned keys that have no row in ``done``; ``most`` bounds a batch, smallest keys first."""
    new = scanned.join(done.select(key).distinct(), key, "left_anti")
    return ranks.between(new, [F.asc(key)], 0, most) if most else new


def label_images(images: DataFrame, call: Callable[[str, bytes], dict], workers: int = 5) -> DataFrame:
    """Run ``call(path, content)`` for each row of ``images(path, content)``, ``workers`` at a time.

    ``call`` returns ``{'bytes', 'response', 'text'}``.  An exception becomes the row's ``error`` and
    stops nothing else.
    """

    def one(item: tuple[str, bytes]) -> dict:
        path, content = item
        try:
            return {"path": path, "error": None} | call(path, content)
        except Exception as error:  # each item keeps its own outcome
            return {"path": path, "bytes": None, "response": None, "text": None, "error": f"{type(error).__name__}: {error}"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        columns = ["path", "bytes", "response", "text", "error"]
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                rows = list(pool.map(one, zip(frame["path"], frame["content"])))
                yield pd.DataFrame(rows, columns=columns).astype({"bytes": "Int64"})

    return images.select("path", "content").mapInPandas(run, "path string, bytes long, response string, text string, error string")
