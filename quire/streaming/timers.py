"""Operators that wait: services that cool down after a failure, and gates that let one request of a key through in so many minutes.

State is kept a key (RocksDB) and ends by itself: a timer at the time from which it says nothing more removes it, so what is kept is bounded by
the keys of the last cool-down or gate, not by those ever seen. Time is that of the events: results are the same however events fall into batches,
as long as none is later than the watermark. Rows of a key come in any order within a batch and are sorted first; a null key is one key, a null time is left out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = StructType([StructField("us", LongType())])


def _times(rows: Iterator[pd.DataFrame]) -> list[int]:
    return sorted(t for part in rows for t in part["us"].tolist())


class _Kept(StatefulProcessor):
    """One time a key, and a timer that is `us` microseconds later."""

    def __init__(self, us: int):
        self.us = us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", LAST)

    def _load(self) -> int | None:
        return self.last.get()[0] if self.last.exists() else None

    def _keep(self, before: int | None, now: int) -> None:
        if before == now:
            return
        if before is not None:
            self.handle.deleteTimer(self._due(before))
        self.last.update((now,))
        self.handle.registerTimer(self._due(now))

    def _due(self, at: int) -> int:
        return -(-(at + self.us) // 1000)  # timers are in milliseconds

    def close(self) -> None:
        return


class Cooldown(_Kept):
    """Times of failures -> (up, us): down at the first failure, up again when none came for the cool-down."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = last = self._load()
        out = []
        for t in _times(rows):
            if last is None or t >= last + self.us:
                if last is not None:
                    out.append((key[0], True, last + self.us))
                out.append((key[0], False, t))
            last = t if last is None else max(last, t)
        if last is not None:
            self._keep(before, last)
        yield pd.DataFrame(out, columns=["key", "up", "us"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self._load()
        self.last.clear()
        yield pd.DataFrame([(key[0], True, last + self.us)], columns=["key", "up", "us"])


class Gate(_Kept):
    """Times of requests -> (us) of those let through: none of the key was in the time before."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = last = self._load()
        out = []
        for t in _times(rows):
            if last is None or t >= last + self.us:
                out.append((key[0], t))
                last = t
        if last is not None:
            self._keep(before, last)
        yield pd.DataFrame(out, columns=["key", "us"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["key", "us"])


def with_rocksdb(spark: SparkSession) -> None:
    """The state store that timers need, for streams that this session starts from now on."""
    spark.conf.set(STORE, ROCKSDB)


def _waiting(events: DataFrame, key: str, at: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    with_rocksdb(events.sparkSession)
    rows = events.where(F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), at, F.unix_micros(at).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def availability(failures: DataFrame, service: str, at: str, cooldown_seconds: int) -> DataFrame:
    """key, up, us of a stream of failures with a watermark: each time that a service goes down, and up once the cool-down has passed without another failure."""
    return _waiting(failures, service, at, Cooldown(cooldown_seconds * 1_000_000), "key string, up boolean, us long")


def let_through(requests: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """key, us of the requests of a stream with a watermark that none let through of their key precedes by less than so many minutes."""
    return _waiting(requests, key, at, Gate(minutes * 60_000_000), "key string, us long")
