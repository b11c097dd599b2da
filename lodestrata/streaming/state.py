"""Keyed state over a stream: each key's latest event and its last few, with expiry, replay and
a start from stored states.

A key's events may come in any order; the latest is that with the largest (time,
tie).  A key without events for ``ttl`` of event time, by the watermark, expires:
its state goes, which is told as a row of kind ``expired``.  The state lives in
the checkpoint (RocksDB), survives a restart, and can be read from there: that is
what a late subscriber gets first, and what a new query may start from.

Of a batch's rows of one key, as of its state, only ``keep`` are held at a time.
These functions set the session's state store to RocksDB, which such state needs.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "time_us long, tie long, said string"
TOLD = f"key string, kind string, {EVENT}"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Latest(StatefulProcessor):
    """The latest event of a key, and its last ``keep``."""

    def __init__(self, ttl_ms: int, keep: int):
        self.ttl_ms, self.keep = ttl_ms, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", EVENT)
        self.recent = handle.getListState("recent", EVENT)
        self.ends = handle.getValueState("ends", "ms long")

    def _told(self, key, kind: str, event) -> Row:
        return Row(key=key[0], kind=kind, time_us=event[0], tie=event[1], said=event[2])

    def _keep_until(self, event) -> None:
        """The key's only timer."""
        if self.ends.exists():
            self.handle.deleteTimer(self.ends.get()[0])
        ends = event[0] // 1000 + self.ttl_ms
        self.handle.registerTimer(ends)
        self.ends.update((ends,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.latest.get()) if self.latest.exists() else None
        new = ((r["time_us"], r["tie"], r["said"]) for r in rows)
        old = (tuple(r) for r in self.recent.get()) if self.recent.exists() else ()
        held = heapq.nlargest(self.keep, (e for part in (old, new) for e in part))
        self.recent.put([*reversed(held)])
        if before is None or held[0] > before:
            self.latest.update(held[0])
            self._keep_until(held[0])
            yield self._told(key, "changed", held[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        event = tuple(self.latest.get())
        for state in (self.latest, self.recent, self.ends):
            state.clear()
        yield self._told(key, "expired", event)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        event = (initialState["time_us"], initialState["tie"], initialState["said"])
        self.latest.update(event)
        self.recent.put([event])
        self._keep_until(event)

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: Column, time: Column, tie: Column, ttl_ms: int, late: str = "10 minutes", keep: int = 20, initial: DataFrame | None = None) -> DataFrame:
    """(key, kind, time_us, tie, said) whenever a key's latest event changes or the key expires;
    ``said`` is the event as JSON.  ``initial`` has the states to start from, as ``states`` gives
    them.  Rows without key or time are left out, as are those later than ``late``."""
    stream.sparkSession.conf.set(*PROVIDER)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that sets up the state has no shipped package
    said = F.to_json(F.struct(*stream.columns))
    rows = stream.select(key.cast("string").alias("key"), time.cast("timestamp").alias("at"), tie.cast("long").alias("tie"), said.alias("said"))
    rows = rows.filter("key is not null and at is not null").withWatermark("at", late).withColumn("time_us", F.unix_micros("at"))
    given = {} if initial is None else {"initialState": initial.select("key", "time_us", "tie", "said").groupBy("key")}
    return rows.groupBy("key").transformWithState(Latest(ttl_ms, keep), TOLD, "append", "eventTime", **given)


def follow(told: DataFrame, where: str, checkpoint: str) -> StreamingQuery:
    """Store changes below ``where``, as far as the stream has come."""
    return told.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", where).format("parquet").trigger(availableNow=True).start()


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, time_us, tie, said) of the live keys: the last state of each, from the checkpoint."""
    spark.conf.set(*PROVIDER)
    return spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint).select("key.key", "value.*")


def history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, time_us, tie, said) of the live keys' last events."""
    spark.conf.set(*PROVIDER)
    return spark.read.format("statestore").option("stateVarName", "recent").load(checkpoint).select("key.key", "list_element.*")
