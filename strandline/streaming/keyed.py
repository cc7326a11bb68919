"""The latest quote of each symbol as keyed state in the engine's state store; a batch emits the symbols that it changed and touches no other."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strandline.streaming.live import QUOTE, quotes

ROWS = "symbol long, price double, at_us long, event_id long"
STATE = "price double, at_us long, event_id long"
CHANGE = "symbol long, old_price double, price double, at_us long, event_id long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestQuote(StatefulProcessor):
    """One value a symbol: the last quote by (time, event). A batch yields a row where that moves the price, and the first time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._last.get()
        best = (known[1], known[2]) if known is not None else None
        price = known[0] if known is not None else None
        newest = best
        for pdf in rows:
            for p, at, event in zip(pdf["price"].tolist(), pdf["at_us"].tolist(), pdf["event_id"].tolist(), strict=True):
                if newest is None or (at, event) > newest:
                    newest, price = (at, event), p
        if newest != best:
            self._last.update((price, *newest))
            old = known[0] if known is not None else None
            if old != price:
                yield pd.DataFrame({"symbol": [key[0]], "old_price": [old], "price": [price], "at_us": [newest[0]], "event_id": [newest[1]]})

    def close(self) -> None:
        pass


def last_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last quote of each symbol in every batch of rows, before they are shuffled: what a busy symbol sends does not grow with its quotes."""
    for pdf in batches:
        yield pdf.sort_values(["at_us", "event_id"], kind="stable").drop_duplicates("symbol", keep="last")


def changes(events: DataFrame, gate: Column | None = None) -> DataFrame:
    """Changed symbols of a stream of events (update mode): symbol, old_price (null the first time), price, received_at, event_id.

    Quotes without time, symbol or a price above zero are not taken, nor are those for which ``gate``, say the exchange's session, does not hold.
    """
    if gate is not None:
        events = events.filter(gate)
    good = quotes(events).filter("reject_reason IS NULL AND symbol IS NOT NULL AND received_at IS NOT NULL AND event_id IS NOT NULL")
    good = good.select("symbol", "price", F.unix_micros("received_at").alias("at_us"), "event_id").mapInPandas(last_of_each, ROWS)
    moved = good.groupBy("symbol").transformWithStateInPandas(LatestQuote(), CHANGE, "Update", "None")
    return moved.select("symbol", "old_price", "price", F.timestamp_micros("at_us").alias("received_at"), "event_id")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def events_in(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(QUOTE)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def start_changes(spark: SparkSession, path: str, checkpoint: str, out: str, gate: Column | None = None, files_a_batch: int | None = None, once: bool = True) -> StreamingQuery:
    """Stream of the event files in ``path``: ``out`` gets the symbols that each batch changed, in a folder a batch.

    A batch that runs again replaces its own folder; the state goes with the checkpoint, so a restart goes on where the last run ended.
    """

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    with state_store(spark):
        writer = changes(events_in(spark, path, files_a_batch), gate).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def start_dead_letters(spark: SparkSession, path: str, checkpoint: str, out: str) -> StreamingQuery:
    """Stream of the events that are no quotes, with the reason, as files in ``out``."""
    bad = quotes(events_in(spark, path)).filter("reject_reason IS NOT NULL")
    return bad.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_with_backoff(start: Callable[[], StreamingQuery], failures: int = 5, first_wait: float = 30.0, longest_wait: float = 60.0, wait: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Runs a query to its end and starts it again from its checkpoint when it fails, after waits that double up to ``longest_wait``; the last of ``failures`` in a row is raised.

    A run that got a batch through before it failed begins the count and the waits anew.
    """
    failed, pause = 0, first_wait
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if any(p["numInputRows"] for p in query.recentProgress):
                failed, pause = 0, first_wait
            failed += 1
            if failed >= failures:
                raise
            wait(pause)
            pause = min(longest_wait, 2 * pause)
