"""A keyed cache with expiry over a stream of requests, as arbitrary keyed state with event-time timers.

A request whose key was asked within the expiry is a hit and needs no work; it becomes the entry's latest request and
the expiry starts anew. Any other request is a miss: it opens an entry and goes on to be worked on. An entry closes
when the expiry has passed without a request, by event time.

Tasks first fold the requests of a key and of a short time bucket into one row (first and last request, count). No gap
inside a bucket can reach the expiry, so this changes nothing, and a key with a third of all requests
reaches its state as few rows. State holds five numbers a key, and only for open entries: a timer removes them.
Keys are dealt by hash to ``groups`` groups, whose entries are kept, and changed by array operations, together.
A bucket is late, and dropped, as a whole: when its end lies before the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Fixed value: the state store that timers need.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "opened_at bigint, first_id bigint, last_at bigint, last_id bigint, requests bigint"
EVENTS = f"kind string, key string, {_STATE}"
_NAMES = [field.split()[0] for field in EVENTS.split(", ")]
_COLUMNS = "key array<string>, " + ", ".join(f"{name} array<bigint>" for name in _NAMES[2:])
#: Groups of keys that share a value of state.
_GROUPS = 256


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _folded(bucket_us: int):
    """Per batch one row for each key and bucket; ties of time go to the smaller first and the larger last id."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.assign(bucket=part["at"] // bucket_us).sort_values(["at", "id"], kind="stable")
            groups = part.groupby(["key", "bucket"], sort=False)
            yield groups.agg(
                first_at=("at", "first"), first_id=("id", "first"), last_at=("at", "last"), last_id=("id", "last"), requests=("id", "size")
            ).reset_index()

    return fold


class _Entries(StatefulProcessor):
    """The open entries of one group of keys as columns of one value, with one timer for the first that may expire.

    A call to the state store costs far more than an entry, so a group reads, changes and writes all its entries at once.
    """

    def __init__(self, expiry_us: int):
        self.expiry_us = expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entries = handle, handle.getValueState("entries", _COLUMNS)

    def _timers(self, entries: pd.DataFrame) -> pd.Series:
        return (entries["last_at"] + self.expiry_us) // 1000 + 1

    def _opened(self) -> pd.DataFrame:
        value = self.entries.get() if self.entries.exists() else [[] for _ in _NAMES[1:]]
        numbers = {name: np.array(part, "i8") for name, part in zip(_NAMES[2:], value[1:])}
        return pd.DataFrame({"key": pd.Series(value[0], dtype=object), **numbers})

    def _store(self, entries: pd.DataFrame) -> None:
        if entries.empty:
            self.entries.clear()
            return
        self.entries.update(tuple(entries[name].tolist() for name in _NAMES[1:]))
        self.handle.registerTimer(int(self._timers(entries).min()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._opened()
        asked = pd.concat([part.rename(columns={"first_at": "opened_at"})[_NAMES[1:]] for part in rows])
        after, events = _continued(before, asked, self.expiry_us)
        if not before.empty:
            self.handle.deleteTimer(int(self._timers(before).min()))
        self._store(after)
        yield events

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries = self._opened()
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        expired = self._timers(entries) <= until
        self._store(entries[~expired])
        yield _events(entries[expired], "closed")

    def close(self) -> None:
        pass


def _continued(before: pd.DataFrame, asked: pd.DataFrame, expiry_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The open entries after folded requests have come, and the events; the entry of a key comes before its requests."""
    rows = pd.concat([before.assign(new=0), asked.assign(new=1)], ignore_index=True)
    rows["code"] = pd.factorize(rows["key"])[0]
    rows = rows.sort_values(["code", "new", "opened_at", "first_id", "last_at", "last_id"], ignore_index=True)
    latest = rows.groupby("code")["last_at"].cummax()
    first = rows["code"] != rows["code"].shift()
    rows["entry"] = (first | (rows["opened_at"] - latest.shift(fill_value=0) > expiry_us)).cumsum()
    heads = rows.drop_duplicates("entry")
    ends = rows.sort_values(["entry", "last_at", "last_id"]).drop_duplicates("entry", keep="last")
    entries = heads.assign(
        last_at=ends["last_at"].to_numpy(), last_id=ends["last_id"].to_numpy(), requests=rows.groupby("entry")["requests"].sum().to_numpy()
    )
    followed = entries["code"].duplicated(keep="last")
    events = pd.concat([_events(entries[entries["new"] == 1], "miss"), _events(entries[followed], "closed")])
    return entries[~followed], events


def _events(entries: pd.DataFrame, kind: str) -> pd.DataFrame:
    frame = entries.assign(kind=kind)[_NAMES].astype({name: "Int64" for name in _NAMES[2:]})
    if kind == "miss":
        frame[["last_at", "last_id", "requests"]] = pd.NA
    return frame.astype({name: "Int64" for name in _NAMES[2:]})


def cache_events(
    requests: DataFrame, key: Column, time: Column, request_id: Column, expiry_s: int = 3600, lateness_s: int = 600, bucket_s: int = 600, groups: int = _GROUPS
) -> DataFrame:
    """A row ``miss`` for each entry opened and a row ``closed``, with its counts, for each that has expired.

    Times are in microseconds; ``requests`` counts the first request too. Start the stream inside ``rocksdb_state``.
    Null keys are a key like any other. ``bucket_s`` and ``lateness_s`` may not exceed the expiry.
    """
    if max(bucket_s, lateness_s) > expiry_s:
        raise ValueError("buckets and lateness may not exceed the expiry")
    rows = requests.select(
        F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-")).alias("key"),
        F.unix_micros(time).alias("at"),
        request_id.cast("bigint").alias("id"),
    ).where("at IS NOT NULL AND id IS NOT NULL")
    bucket_us = bucket_s * 1_000_000
    folded = rows.mapInPandas(
        _folded(bucket_us), "key string, bucket bigint, first_at bigint, first_id bigint, last_at bigint, last_id bigint, requests bigint"
    )
    timed = folded.withColumn("bucket_end", F.timestamp_micros((F.col("bucket") + 1) * bucket_us))
    entries = (
        timed.withWatermark("bucket_end", f"{lateness_s} seconds")
        .withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
        .groupBy("part")
        .transformWithStateInPandas(_Entries(expiry_s * 1_000_000), EVENTS, "append", "eventTime")
    )
    return entries.withColumn("key", F.when(F.col("key") != "-", F.expr("substring(key, 2)")))
