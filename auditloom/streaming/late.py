"""Counts of late rows that outlive a query's progress log and its restarts."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

_ROW = "query_id string, batch_id long, dropped long"


class LateRows(StreamingQueryListener):
    """Adds the rows that each batch of any query of the session drops as later than its watermark to a table of its own at `path`, in a store that the cluster shares.

    A query keeps its id over restarts, and a batch that is run again is written again, so counts are taken once a batch id. Batches that drop nothing write nothing.
    Rows of one window and key that a task has combined before the state sees them count once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._ended = spark, path, {}
        spark.createDataFrame([], _ROW).write.mode("append").parquet(path)  # the table is there before its first row

    def _end(self, run_id: str) -> threading.Event:
        return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if dropped > 0:
            self.spark.createDataFrame([(str(p.id), p.batchId, dropped)], _ROW).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def wait(self, query, seconds: float = 60.0) -> None:
        """Until all that the listener was told of an ended query is written; TimeoutError if that takes longer."""
        if not self._end(query.runId).wait(seconds):
            raise TimeoutError(f"no end of {query.runId} after {seconds} seconds")


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, dropped): the late rows of each query so far, each batch once; queries without any have no row."""
    rows = spark.read.schema(_ROW).parquet(path)
    return rows.groupBy("query_id", "batch_id").agg(F.max("dropped").alias("dropped")).groupBy("query_id").agg(F.sum("dropped").alias("dropped"))
