"""Books from a stream of pages, each written when its last page has come.

The state of a document is a bit for each page that has come, not the pages: their parts are written once, with the batch's events, and a book that is whole is assembled from there.  A page that comes
again, or late, has its book assembled anew.  A document that no page has come of for some time gives a book of what there is, if it isn't whole, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.operators import pages

PARTS = "doc_id string, page_id string, ord long, block string, status string"
EVENTS = f"{PARTS}, event string"
#: Settings that the stream starts with: state with timers needs this store; and a run over what is there would never end if timers alone made batches.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ONCE = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class Arrivals(StatefulProcessor):
    """Passes parts on, with a row for each document that is whole, late or given up."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("arrivals", "n_pages int, seen binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, seen = self.state.get() if self.state.exists() else (0, b"")
        bits = int.from_bytes(seen, "little")
        whole = n > 0 and bits.bit_count() == n
        for batch in rows:
            n = max(n, int(batch["n_pages"].max()))
            for place in batch["place"].tolist():
                bits |= 1 << place
            yield batch[["doc_id", "page_id", "ord", "block", "status"]].assign(event=None)
        self.state.update((n, bits.to_bytes(bits.bit_length() // 8 + 1, "little")))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        if bits.bit_count() == n:
            yield self._event(key, "late" if whole else "whole")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, seen = self.state.get()
        self.state.clear()
        if int.from_bytes(seen, "little").bit_count() < n:
            yield self._event(key, "given up")

    def close(self) -> None:
        pass

    def _event(self, key, event: str) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "page_id": [None], "ord": pd.array([None], "Int64"), "block": [None], "status": [None], "event": [event]})


def assemble(events: DataFrame, ready: DataFrame, method: str) -> DataFrame:
    """Books of the documents of ready (doc_id), from events of all batches: of each page what came with the latest batch, and of several there the last by its text.

    Blocks are shuffled once, by document; all that follows is within a document.
    """
    own = events.where("event is null").join(F.broadcast(ready), "doc_id", "left_semi").repartition("doc_id")
    last = own.groupBy("doc_id", "page_id").agg(F.max_by(F.struct("ord", "block", "status"), F.struct("batch", "block", "status")).alias("p"))
    return pages.books_of(last.select("doc_id", "page_id", "p.ord", "p.block", F.lit(1).alias("n"), (F.col("p.status") == "error").cast("long").alias("bad")), method)


def write_books(stream: DataFrame, method: str, folder: str, checkpoint: str, wait: float = 3600, once: bool = True) -> StreamingQuery:
    """Writes parts (with events) and books below folder.  stream: doc_id, page_id, ord, place (from 0, another for each page), n_pages, block, status; wait: seconds without a page after which a document is given up.

    A batch that comes again replaces what it wrote.  With `once` the stream ends when all that is there is read, and documents are given up in batches that have pages.
    """
    spark = stream.sparkSession
    rows = stream.select("doc_id", "page_id", F.col("ord").cast("long").alias("ord"), F.col("place").cast("int").alias("place"), F.col("n_pages").cast("int").alias("n_pages"), "block", "status")
    events = rows.groupBy("doc_id").transformWithStateInPandas(Arrivals(int(wait * 1000)), EVENTS, "Append", "ProcessingTime")

    def batch(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(at := f"{folder}/events/batch={number:012d}")
        found = spark.read.parquet(at)
        ready = found.where("event is not null").select("doc_id").distinct()
        if not ready.isEmpty():
            assemble(spark.read.schema(f"{EVENTS}, batch long").parquet(f"{folder}/events"), ready, method).write.mode("overwrite").parquet(f"{folder}/books/batch={number:012d}")

    settings = SETTINGS | (ONCE if once else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:  # the stream keeps the settings that it starts with
        writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's latest book: doc_id, markdown, n_pages, n_errors."""
    every = spark.read.parquet(f"{folder}/books")
    anew = every.groupBy("doc_id").agg(F.max("batch").alias("_latest"), F.count(F.lit(1)).alias("_n")).where("_n > 1")  # few, so books themselves aren't shuffled for it
    latest = every.join(F.broadcast(anew), "doc_id", "left").where("_latest is null or batch = _latest")
    return latest.select("doc_id", "markdown", "n_pages", "n_errors")
