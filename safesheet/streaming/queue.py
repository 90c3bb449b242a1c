"""An indexing queue as a stateful stream: documents that fail are tried again, and given up after so many times."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

OUT = "document_id string, outcome string, attempts int, error string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Queue(StatefulProcessor):
    """State of a document: its content, how often it was tried, and once it is done, that alone."""

    def __init__(self, work: Callable[[str, str, int], None], most: int, wait_ms: int, keep_ms: int | None) -> None:
        self.work, self.most, self.wait_ms, self.keep_ms = work, most, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "content string, attempts int")
        self.done = handle.getValueState("done", "outcome string", self.keep_ms)

    def _attempt(self, key: str, content: str, before: int, now: int) -> Iterator[Row]:
        attempts, error = before + 1, None
        try:
            self.work(key, content, attempts)
        except Exception as e:  # whatever is wrong with a document, the others go on
            error = f"{type(e).__name__}: {e}"[:200]
        if error is not None and attempts < self.most:
            self.waiting.update((content, attempts))
            self.handle.registerTimer(now + self.wait_ms)
            return
        outcome = "indexed" if error is None else "dead_letter"
        self.waiting.clear()
        self.done.update((outcome,))
        yield Row(document_id=key, outcome=outcome, attempts=attempts, error=error)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        content = next((r["content"] for r in rows), None)
        if not self.done.exists() and not self.waiting.exists():
            yield from self._attempt(key[0], content, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            content, attempts = self.waiting.get()
            yield from self._attempt(key[0], content, attempts, timerValues.getCurrentProcessingTimeInMs())


def use_store(spark: SparkSession) -> None:
    """The queue's state has timers, which Spark keeps in its RocksDB store only; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def indexing_queue(documents: DataFrame, work: Callable[[str, str, int], None], most: int = 3, wait_ms: int = 1000, keep_ms: int | None = None) -> DataFrame:
    """Stream of (document_id, outcome, attempts, error) for a stream of (document_id, content): a row for each document once it is indexed, or a dead_letter after ``most`` attempts.

    ``work`` (id, content, attempt) is called on the executors and indexes the document; an exception is a failure, and it is called again after
    ``wait_ms``. What waits, how often it was tried and what is done are state in the query's checkpoint, so a restart goes on where it was. A document
    that comes again while it waits or when it is done isn't taken; ``keep_ms`` is how long that is known (null: for ever). A batch that comes again
    after a failure calls ``work`` again, which therefore has to write by id.
    """
    keyed = documents.selectExpr("cast(document_id as string) as document_id", "content").filter("document_id is not null")
    return keyed.groupBy("document_id").transformWithState(_Queue(work, most, wait_ms, keep_ms), OUT, "append", "ProcessingTime")
