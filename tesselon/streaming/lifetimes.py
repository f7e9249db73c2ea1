"""Keyed state with a lifetime: a key that stays away is closed, told and forgotten, and begins anew when it returns.

State is a value a key in the state store (RocksDB, so it may outgrow memory), its end an event-time timer.  A run is told
when the watermark has passed its end, and not before: a later event of its key may come first, so the runs that aren't told
yet are kept, and results don't depend on where batches end.  Events older than the watermark are dropped by Spark before
they are counted.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark: SparkSession):
    """The state store that timers need, while queries are started; the session's own choice afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def runs_of(runs, ttl_ms: int) -> list[tuple]:
    """(n, first, last) of runs in order of time, those at most ``ttl_ms`` apart as one."""
    out = []
    for n, first, last in sorted(runs, key=lambda r: r[1]):
        if out and first - out[-1][2] <= ttl_ms:
            m, begin, end = out[-1]
            out[-1] = (m + n, begin, max(end, last))
        else:
            out.append((n, first, last))
    return out


class Lifetime(StatefulProcessor):
    """Counts the events of a key until none has come for ``ttl_ms``."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n array<long>, first array<long>, last array<long>, due long")

    def _held(self):
        held = self.seen.get()
        return ([], None) if held is None else (list(zip(*(list(x) for x in held[:3]))), held[3])

    def _told(self, key, runs, due, watermark: int):
        """The runs whose end the watermark has passed; the others stay, with a timer at the end of the first."""
        import pandas as pd

        closed = [r for r in runs if r[2] + self.ttl_ms < watermark]
        runs = runs[len(closed) :]
        if due is not None:
            self.handle.deleteTimer(due)
        if runs:
            due = runs[0][2] + self.ttl_ms
            self.seen.update((*(list(x) for x in zip(*runs)), due))
            self.handle.registerTimer(due)
        else:
            self.seen.clear()
        return pd.DataFrame([(key[0], *r) for r in closed], columns=[self.key, "n", "first_ms", "last_ms"])

    def handleInputRows(self, key, rows, timerValues):
        runs, due = self._held()
        new = [(1, x, x) for batch in rows for x in batch["ms"].tolist()]
        yield self._told(key, runs_of([*runs, *new], self.ttl_ms), due, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._told(key, self._held()[0], None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def lifetimes(events: DataFrame, key: str, ttl_ms: int, late: str = "10 minutes") -> DataFrame:
    """key, n, first_ms, last_ms of each closed run of events of a stream (key, ts)."""
    timed = events.select(F.col(key).cast("long").alias(key), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    timed = timed.withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=Lifetime(key, ttl_ms), outputStructType=f"{key} long, n long, first_ms long, last_ms long", outputMode="append", timeMode="eventTime")
