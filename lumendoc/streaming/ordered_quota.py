"""The daily quota over a stream, in the order in which calls were made, not in which they came.

State of a key and day: the calls that wait, and how many were let through.  A
call waits until the watermark has passed it, so that no earlier one can still
come; then a timer takes all that are due, in order of time and tie, whatever
batches they came in.  The state goes when the watermark is past the day.

Calls at or before the watermark, which come too late, are dropped by Spark.  Null keys
are a key of their own; rows without a time never get a turn and are left out.
The session needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumendoc.operators.service import DAILY_LIMIT

DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """Have the session keep streaming state in RocksDB, which timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Quota(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n int")
        self.waiting = handle.getListState("waiting", "at long, tie long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            if len(b):
                self.waiting.appendList([(int(at), int(tie)) for at, tie in zip(b["at"], b["tie"])])
                for at in sorted(set(b["at"])):
                    self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(at), int(tie)) for at, tie in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in held if x[0] <= mark], [x for x in held if x[0] > mark]
        if not due:
            return iter(())
        used = self.used.get()[0] if self.used.exists() else 0
        out = pd.DataFrame({"day": key[0], "key": key[1], "tie": [tie for _, tie in due], "allowed": [used + k < self.limit for k in range(len(due))]})
        self.used.update((min(self.limit, used + len(due)),))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        elif mark >= int(dt.datetime.combine(key[0], dt.time(), dt.timezone.utc).timestamp() * 1000) + DAY_MS:
            self.used.clear()
        return iter((out,))

    def close(self) -> None:
        pass


def stream_quota(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id", limit: int = DAILY_LIMIT, late: str = "1 hour") -> DataFrame:
    """day, key, tie and allowed of every call: ``limit`` a day and key, in order of time; told once the watermark has passed it."""
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.to_date(ts).alias("day"), F.col(key).cast("string").alias("key"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"))
    return rows.groupBy("day", "key").transformWithStateInPandas(_Quota(limit), "day date, key string, tie long, allowed boolean", "append", "eventTime")
