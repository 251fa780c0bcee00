"""State of streams in the RocksDB store, forgotten by event-time timers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of a row for ``restart_timer``.
TIME = "event_time"


def stateful(rows: DataFrame, keys: list[str], columns: list[str | Column], processor: StatefulProcessor, output: str,
             ts: str | None, watermark: str) -> DataFrame:
    """Run a processor per key; with an event time ``ts`` its timers see the watermark. The session's state store becomes RocksDB."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if ts is None:
        chosen, mode = rows.select(*columns), "None"
    else:
        chosen, mode = rows.select(*columns, F.col(ts).alias(TIME)).withWatermark(TIME, watermark), "EventTime"
    return chosen.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=output, outputMode="Append", timeMode=mode)


def restart_timer(handle: StatefulProcessorHandle, part: pd.DataFrame, ttl_ms: int | None) -> None:
    """One timer per key, ``ttl_ms`` after the latest row so far."""
    if ttl_ms is None:
        return
    due = int(part[TIME].max().timestamp() * 1000) + ttl_ms
    for timer in list(handle.listTimers()):
        due = max(due, timer)
        handle.deleteTimer(timer)
    handle.registerTimer(due)
