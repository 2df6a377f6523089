"""The throttle as keyed stream state: a counter for each key and window, with timers.

Each event of a key takes a token of its window; a window gives ``limit`` of them.  Counters live in the
state store and survive restarts with the stream's checkpoint; a timer at the end of a window, once the
watermark has passed it, drops its counter.  Every micro-batch gives the windows that it has changed with
their counts so far, which the sink keeps by (key, window).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..session import ship
from . import intake

#: The only state store that holds maps and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tokens(StatefulProcessor):
    """Counts of events by window for one key."""

    def __init__(self, key: str, seconds: int, limit: int, lateness: int) -> None:
        self.key, self.seconds, self.limit, self.lateness = key, seconds, limit, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "window_start long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, int] = {}
        for batch in rows:
            for start, n in batch["window_start"].value_counts().items():
                fresh[int(start)] = fresh.get(int(start), 0) + int(n)
        out = []
        for start, n in fresh.items():
            if self.counts.containsKey((start,)):
                n += self.counts.getValue((start,))[0]
            else:
                self.handle.registerTimer((start + self.seconds + self.lateness) * 1000)
            self.counts.updateValue((start,), (n,))
            out.append((key[0], start, n, min(n, self.limit)))
        yield pd.DataFrame(out, columns=[self.key, "window_start", "n", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.seconds - self.lateness
        if self.counts.containsKey((start,)):
            self.counts.removeKey((start,))
        yield pd.DataFrame([], columns=[self.key, "window_start", "n", "allowed"])

    def close(self) -> None:
        pass


def counted(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = intake.THROTTLE_SECONDS, limit: int = intake.THROTTLE_LIMIT, lateness: int = 2 * intake.THROTTLE_SECONDS) -> DataFrame:
    """(key, window_start, n, allowed): the changed windows of a stream; events that come later than ``lateness`` seconds are left out."""
    start = (F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long")
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{lateness} seconds").select(F.col(key), F.col(ts), start.alias("window_start"))
    return rows.groupBy(key).transformWithStateInPandas(Tokens(key, seconds, limit, lateness), f"{key} {dict(events.dtypes)[key]}, window_start long, n long, allowed long", "Update", "EventTime")


def throttle_stream(events: DataFrame, folder: str, checkpoint: str, key: str = "user_id", **options) -> StreamingQuery:
    """Counts all there is of a stream and upserts the windows; ``folder`` is read with ``intake.current``."""
    ship(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def each(batch: DataFrame, batch_id: int) -> None:
        intake.upsert(batch.sparkSession, batch, folder, [key, "window_start"], batch_id)

    return counted(events, key, **options).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
