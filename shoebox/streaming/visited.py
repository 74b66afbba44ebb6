"""Work done once for each path of a stream, with its outcome kept as state.

State is keyed by path on RocksDB, so that a batch asks for the paths it holds and never reads what
earlier runs wrote.  A path's rows are worked on together and all of its results are kept.  A path that
failed keeps its rows, and is tried again with them, and with new ones, when it turns up again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Visits(StatefulProcessor):
    """``work(rows)`` gives the results of one path's rows, as a pandas frame of ``columns``, or raises."""

    def __init__(self, work: Callable[[pd.DataFrame], pd.DataFrame], key: str, columns: list[str], rows: T.StructType):
        self.work, self.key, self.columns, self.rows = work, key, columns, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.outcome = handle.getValueState("outcome", "status string, tries int")
        self.waiting = handle.getListState("waiting", self.rows)

    def _try(self, path, frame: pd.DataFrame) -> pd.DataFrame:
        tries = 1 + (self.outcome.get()[1] if self.outcome.exists() else 0)
        try:
            out = self.work(frame)[self.columns].assign(error=None, tries=tries)
            self.outcome.update(("done", tries))
            self.waiting.clear()
        except Exception as error:  # the path keeps its outcome, others go on
            out = pd.DataFrame([{c: None for c in self.columns} | {self.key: path, "error": f"{type(error).__name__}: {error}"[:200], "tries": tries}])
            self.outcome.update(("failed", tries))
            self.waiting.put([tuple(r) for r in frame[self.rows.names].itertuples(index=False)])
        return out[[*self.columns, "error", "tries"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        path = key[0]
        frame = pd.concat(list(rows), ignore_index=True)
        status = self.outcome.get() if self.outcome.exists() else None
        if status is None or status[0] == "failed":
            before = [tuple(r) for r in self.waiting.get()] if status else []
            if before:
                frame = pd.concat([pd.DataFrame(before, columns=self.rows.names), frame], ignore_index=True).drop_duplicates(ignore_index=True)
            yield self._try(path, frame)

    def close(self) -> None:
        pass


def visit(stream: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], result: str, key: str = "path") -> DataFrame:
    """Results of ``work`` over a stream, each path once: ``result`` columns, ``error``, ``tries``.

    ``result`` is a schema that holds ``key``.  A failed try is a row with an error and nothing else.
    """
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    columns = T.StructType.fromDDL(result)
    out = T.StructType([*columns, T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())])
    rows = T.StructType(list(stream.schema))
    return stream.groupBy(key).transformWithStateInPandas(Visits(work, key, columns.names, rows), out, "append", "none")


def drain(visited: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Append the results to a Parquet table, exactly once a batch, until the source is drained; returns the table."""
    visited.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return visited.sparkSession.read.schema(visited.schema).parquet(target)


def finished(log: DataFrame) -> DataFrame:
    """Results of the paths that succeeded."""
    return log.where("error is null").drop("error")


def open_failures(log: DataFrame, key: str = "path") -> DataFrame:
    """Paths whose tries have all failed so far, with their last error."""
    failed = log.where("error is not null").groupBy(key).agg({"tries": "max"}).withColumnRenamed("max(tries)", "tries")
    return failed.join(log.where("error is null").select(key).distinct(), key, "left_anti").join(log.where("error is not null").select(key, "tries", "error"), [key, "tries"])
