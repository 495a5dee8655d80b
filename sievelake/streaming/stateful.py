"""Caches and circuit breakers as streams in event time, whatever the order in which rows arrive.

State and timers are Spark's (transformWithState over RocksDB): a restart from the checkpoint goes on where the last batch was committed, and results
come out once. Rows that the watermark has passed are dropped by Spark, which counts them; each function says why that loses nothing or what delay it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from .state import FAILURES, TTL_S

STORE, ROCKS_DB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(when: datetime) -> int:
    """Microseconds since the epoch of a UTC time, exactly."""
    past = when.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (past.days * 86_400 + past.seconds) * 1_000_000 + past.microseconds


class _Cache(StatefulProcessor):
    """The newest entry of a key, until the watermark, which stays a time to live behind, passes it."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, seq long, hash string")

    def _change(self, key, at: int, seq: int, value: str | None, live: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key], "at": [at], "seq": [seq], "hash": pd.array([value], dtype="string"), "live": [live]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = before = tuple(self.entry.get()) if self.entry.exists() else None
        for batch in rows:
            for at, seq, value in zip(batch["at"], batch["seq"], batch["hash"], strict=True):
                row = (int(at), int(seq), None if pd.isna(value) else value)
                if newest is None or row[:2] > newest[:2]:
                    newest = row
        if newest != before:
            if before is not None and before[0] // 1_000 != newest[0] // 1_000:
                self.handle.deleteTimer(before[0] // 1_000)
            self.entry.update(newest)
            self.handle.registerTimer(newest[0] // 1_000)
            yield self._change(key[0], *newest, newest[2] is not None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and (entry := tuple(self.entry.get()))[0] // 1_000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
            yield self._change(key[0], *entry, False)

    def close(self) -> None:
        pass


def cache_changes(entries: DataFrame, key: str = "function_name", ttl_s: int = TTL_S) -> DataFrame:
    """The changes of a cache over a stream of ``entries`` (key, hash, inserted_at, seq): key, at (microseconds), seq, hash and live.

    A row with a hash puts it, one without takes the key's entry away; of a key the greatest (inserted_at, seq) counts, in whatever order rows come, and
    the state is that one row. An entry ends when the newest time seen is ``ttl_s`` later, to the millisecond. So late rows, which Spark drops,
    have ended already. Null keys are a key; rows with a null time are left out.
    """
    kind = dict(entries.dtypes)[key]
    rows = entries.filter("inserted_at IS NOT NULL").select(key, "hash", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.col("inserted_at").cast("timestamp").alias("time"))
    rows = rows.withColumn("at", F.unix_micros("time")).withWatermark("time", f"{ttl_s} seconds")
    return rows.groupBy(key).transformWithStateInPandas(_Cache(key), f"{key} {kind}, at long, seq long, hash string, live boolean", "Append", "EventTime")


def live_entries(changes: DataFrame, key: str = "function_name") -> DataFrame:
    """The entries (key, at, seq, hash) that are live after all ``changes``."""
    last = F.max_by(F.struct("at", "seq", "hash", "live"), F.struct("at", "seq", ~F.col("live")))
    return changes.groupBy(key).agg(last.alias("e")).filter("e.live").select(key, "e.at", "e.seq", "e.hash")


class _Breaker(StatefulProcessor):
    """Failures in a row of a key, over calls that wait until the watermark has passed them."""

    def __init__(self, key: str, limit: int):
        self.key, self.limit = key, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, failed boolean")
        self.run = handle.getValueState("run", "failures int, open boolean, timer long")

    def _state(self) -> tuple[int, bool, int]:
        return tuple(self.run.get()) if self.run.exists() else (0, False, -1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, opened, timer = self._state()
        new = [(int(a), int(s), bool(f)) for batch in rows for a, s, f in zip(batch["at"], batch["seq"], batch["failed"], strict=True)]
        for at in range(0, len(new), 10_000):
            self.waiting.appendList(new[at : at + 10_000])
        first = min(a for a, _, _ in new) // 1_000
        if timer < 0 or first < timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            self.run.update((failures, opened, first))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, opened, _ = self._state()
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        calls = sorted(map(tuple, self.waiting.get()))
        rest = [c for c in calls if c[0] // 1_000 > passed]
        for at, seq, bad in calls[: len(calls) - len(rest)]:
            out.append((key[0], at, seq, bad, failures, opened))
            if not opened:
                failures = failures + 1 if bad else 0
                opened = failures >= self.limit
        self.waiting.put(rest) if rest else self.waiting.clear()
        timer = rest[0][0] // 1_000 if rest else -1
        if rest:
            self.handle.registerTimer(timer)
        self.run.update((failures, opened, timer))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "at", "seq", "failed", "failures_before", "open"])

    def close(self) -> None:
        pass


def breaker_in_order(calls: DataFrame, key: str, delay: str, limit: int = FAILURES) -> DataFrame:
    """A breaker over a stream of ``calls`` (key, time, seq, failed): each call with at (microseconds), failures_before and open, once the watermark has passed it.

    Calls count in the order of (time, seq) as long as none comes more than ``delay`` late; a key's state is what waits within the delay. What is left
    when the stream stops comes out when later calls, or a ``heartbeat``, move the watermark on. Calls with a null time are left out.
    """
    kind = dict(calls.dtypes)[key]
    rows = calls.filter("time IS NOT NULL").select(key, F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("failed", F.lit(False)).alias("failed"), F.col("time").cast("timestamp").alias("time"))
    rows = rows.withColumn("at", F.unix_micros("time")).withWatermark("time", delay)
    return rows.groupBy(key).transformWithStateInPandas(_Breaker(key, limit), f"{key} {kind}, at long, seq long, failed boolean, failures_before int, open boolean", "Append", "EventTime")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stateful ``stream`` has given once everything there is has been read: appended, exactly once, to the table at ``path``."""
    started(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def started(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The query behind ``drained``, running. State stands in RocksDB; the session's own choice of a store is as it was afterwards."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS_DB)
    try:
        return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(STORE, before) if before else conf.unset(STORE)

