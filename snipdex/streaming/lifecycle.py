"""State of change events: retries, end states and expiry."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from snipdex.functions.rules import older_than

# Fixed values
STATUSES = ["Pending", "Processing", "Completed", "Failed", "Expired"]
END_STATES = ["Completed", "Failed", "Expired"]
STATE_SCHEMA = "event_id string, status string, retry_count int, last_us bigint"


def latest_state(events: DataFrame) -> DataFrame:
    """The last status per event id, with the number of failures so far."""
    last = F.max(F.struct("event_time", "status", "path")).alias("_l")
    failures = F.count_if(F.col("status") == "Failed").alias("retry_count")
    rows = events.groupBy("event_id").agg(last, failures)
    return rows.select("event_id", "_l.status", "_l.event_time", "_l.path", "retry_count")


def retention(events: DataFrame, as_of: str, max_age: str, states: list[str] | None = None) -> DataFrame:
    """Events that stay: all but those in an end state that are older than `max_age`."""
    ended = F.col("status").isin(states or END_STATES)
    return events.filter(~(ended & older_than(F.col("event_time"), as_of, max_age)))


class _Lifecycle(StatefulProcessor):
    """Keeps (status, retries, time) per event; an open event expires `ttl_ms` after its last step."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, retries int, us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        status, retries, us = self.state.get() if self.state.exists() else ("", 0, -1)
        for frame in rows:
            frame = frame.sort_values(["us", "status"])
            retries += int((frame["status"] == "Failed").sum())
            newest = frame.iloc[-1]
            if int(newest["us"]) >= us:
                status, us = str(newest["status"]), int(newest["us"])
        self.state.update((status, retries, us))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status not in END_STATES:
            self.handle.registerTimer(us // 1000 + self.ttl_ms)
        yield pd.DataFrame({"event_id": [key[0]], "status": [status], "retry_count": [retries], "last_us": [us]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        _, retries, us = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"event_id": [key[0]], "status": ["Expired"], "retry_count": [retries], "last_us": [us]})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lifecycle_stream(events: DataFrame, ttl_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """State changes per event id; open events that stay silent for `ttl_ms` become Expired.

    Needs the RocksDB state store.
    """
    rows = events.withWatermark("event_time", lateness).select(
        F.col("event_id").cast("string").alias("event_id"), "status", "event_time",
        F.unix_micros("event_time").alias("us"),
    )
    return rows.groupBy("event_id").transformWithStateInPandas(
        _Lifecycle(ttl_ms), outputStructType=STATE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
