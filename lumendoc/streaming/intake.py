"""Streams: documents into blocks, calls against the daily quota, and job states.

Extras that the batch operators make cheap: blocks are a stateless expression,
the others keep one small state a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumendoc.operators.segment import explode_blocks, with_blocks
from lumendoc.operators.service import DAILY_LIMIT


def stream_blocks(documents: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row a block of every arriving document."""
    return explode_blocks(with_blocks(documents.select(*keys, text), text), *keys)


def stream_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Calls a window, closed when the watermark passes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("calls")).select("window.start", "window.end", "calls")


def stream_quota(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id", limit: int = DAILY_LIMIT, late: str = "1 day") -> DataFrame:
    """Every call with whether it is allowed: ``limit`` a day and key, in order of arrival.

    State: the count so far, dropped a day after the watermark has passed it.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        for b in batches:
            b = b.sort_values(["ts", "tie"])
            nth = used + 1 + pd.RangeIndex(len(b)).to_numpy()
            yield pd.DataFrame({"day": k[0], "key": k[1], "tie": b["tie"].to_numpy(), "allowed": nth <= limit})
            used = min(limit, used + len(b))
        state.update((used,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(pd.Timestamp(k[0]).timestamp() * 1000)) + 2 * 86_400_000)

    rows = events.withWatermark(ts, late).select(F.to_date(ts).alias("day"), F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    return rows.groupBy("day", "key").applyInPandasWithState(run, "day date, key string, tie long, allowed boolean", "used int", "append", "EventTimeTimeout")


def stream_jobs(updates: DataFrame) -> DataFrame:
    """Newest stage and status of every job (for update or complete mode)."""
    return updates.groupBy("id").agg(F.max_by("stage", "seq").alias("stage"), F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
