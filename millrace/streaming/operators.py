"""Streaming operators: the same plans on batches and streams, with watermarks where state must end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; a window's state goes once the watermark has passed it."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def latest(events: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The newest value of each key."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(time, value)).alias(value), F.max(time).alias(time))


def retain(events: DataFrame, time: str, key: list[str], keep: str = "6 hours") -> DataFrame:
    """Each event once; keys older than ``keep`` behind the newest event are forgotten, as is what comes so late."""
    return events.withWatermark(time, keep).dropDuplicatesWithinWatermark(key)


def recent(events: DataFrame, time: str, keep: str = "6 hours") -> DataFrame:
    """A batch's events of the last ``keep`` before its newest one."""
    newest = events.agg(F.max(time).alias("__newest"))
    return events.join(F.broadcast(newest), F.col(time) >= F.col("__newest") - F.expr(f"interval {keep}"), "left_semi")


TRIPS = "vehicle string, trip long, n long, first timestamp, last timestamp"
_STATE = "trip long, n long, first timestamp, last timestamp, distance double"


def trips(events: DataFrame, vehicle: str, time: str, distance: str, idle: int | None = None) -> DataFrame:
    """Finished trips of each vehicle: a trip ends where its distance falls, or after ``idle`` milliseconds without news.

    State per vehicle is five values. Rows of a batch are taken in time order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        now = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            out.append((key[0], *now[:4]))
        else:
            rows = pd.concat(list(frames)).sort_values(["t", "d"])
            for t, d in zip(rows["t"], rows["d"]):
                if now is None:
                    now = [0, 0, t, t, d]
                elif d < now[4]:
                    out.append((key[0], *now[:4]))
                    now = [now[0] + 1, 0, t, t, d]
                now[1], now[3], now[4] = now[1] + 1, t, d
            state.update(tuple(now))
            if idle:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["vehicle", "trip", "n", "first", "last"])

    renamed = events.select(F.col(vehicle).cast("string").alias("vehicle"), F.col(time).cast("timestamp").alias("t"), F.col(distance).cast("double").alias("d"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return renamed.groupBy("vehicle").applyInPandasWithState(run, TRIPS, _STATE, "append", timeout)


class _Retention(StatefulProcessor):
    """Per key, the events of the last ``keep`` milliseconds; they are handed on when the watermark has left them behind.

    A key's events are one value and its next expiry one timer, so a batch costs a few calls for each key, however many
    events the key has.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at array<long>, events array<long>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names that Spark calls
        new = pd.concat(list(rows)).dropna(subset=["at"])
        if new.empty:
            return iter([])
        at, events = new["at"].astype("int64").tolist(), new["event"].astype("int64").tolist()
        first = min(at)
        known = self.held.get()
        if known is None or first < min(known[0]):  # else the timer of an earlier event goes first
            self.handle.registerTimer(first + self.keep)
        self.held.update((at, events) if known is None else (list(known[0]) + at, list(known[1]) + events))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        known = self.held.get()
        if known is None:
            return
        held = pd.DataFrame({"event": known[1], "at": known[0]}, dtype="int64")
        due = held["at"] + self.keep <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        out, left = held[due], held[~due]
        if left.empty:
            self.held.clear()
        elif len(out):
            self.held.update((left["at"].tolist(), left["event"].tolist()))
            self.handle.registerTimer(int(left["at"].min()) + self.keep)
        if len(out):
            yield pd.DataFrame({"key": key[0], "event": out["event"], "at": out["at"], "expired": out["at"] + self.keep})

    def close(self) -> None:
        pass


def expiring(events: DataFrame, key: str, event: str, time: str, keep: int, late: str = "0 seconds") -> DataFrame:
    """(key, event, at, expired): each event once it is more than ``keep`` milliseconds old, in event time.

    State holds a key's events of that time and goes with them, by timers; what comes later than ``late`` behind the
    newest event is dropped. The session's state store must keep several variables (RocksDB; ``drained`` sees to it).
    """
    at = events.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(event).cast("long").alias("event"), F.col(time).alias("__t"), F.unix_millis(F.col(time)).alias("at"))
    return at.groupBy("key").transformWithStateInPandas(_Retention(keep), "key string, event long, at long, expired long", "append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, stream: DataFrame, mode: str = "complete", store: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns its result as a table in the shared folder.

    In ``complete`` mode each batch replaces the table, in ``append`` mode it is added under its batch number, so a
    batch that is run again after a failure replaces itself.
    """
    from millrace.plans.session import shared_folder

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    if store:
        spark.conf.set(name, store)
    try:
        _run(stream, mode, put, root)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _run(stream: DataFrame, mode: str, put, root: str) -> None:
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
