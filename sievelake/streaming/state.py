"""State over time: caches with a time to live, invalidation, circuit breakers, and the rule scan on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.scan import scan_lines

TTL_S, FAILURES = 3_600, 3


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def cache_get(entries: DataFrame, now: Column, key: str = "function_name", ttl_s: int = TTL_S) -> DataFrame:
    """The newest entry of each key (key, inserted_at, seq, ...) that is younger than its time to live."""
    last = Window.partitionBy(key).orderBy(F.desc("inserted_at"), F.desc("seq"))
    newest = entries.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return newest.filter(F.col("inserted_at") > now - F.make_dt_interval(secs=F.lit(ttl_s)))


def invalidate(entries: DataFrame, names: DataFrame, key: str = "function_name") -> DataFrame:
    """Entries whose key is not among ``names``."""
    return entries.join(names.select(key).distinct(), key, "left_anti")


def invalidate_by_hash(entries: DataFrame, current: DataFrame, key: str = "function_name") -> DataFrame:
    """Entries whose key has no other hash in ``current`` (key, hash): those of unknown keys stay."""
    now = current.select(key, F.col("hash").alias("_now"))
    return entries.join(now, key, "left").filter("_now IS NULL OR _now = hash").drop("_now")


def cache_put(entries: DataFrame, new: DataFrame, key: str = "function_name") -> DataFrame:
    """``entries`` with those of ``new`` (one a key) in place of what the same keys had."""
    return invalidate(entries, new, key).unionByName(new.select(*entries.columns))


def cache_stats(entries: DataFrame, now: Column, key: str = "function_name", ttl_s: int = TTL_S) -> DataFrame:
    """One row: cached_functions, the keys with a live entry."""
    return cache_get(entries, now, key, ttl_s).agg(F.count("*").alias("cached_functions"))


def breaker(calls: DataFrame, key: str, order: str, failed: str = "failed", limit: int = FAILURES) -> DataFrame:
    """Adds failures_before (in a row) and open to each of ``calls``: from ``limit`` failures in a row on, a key's breaker stays open.

    Calls while open are skipped and count no more, so the first run of ``limit`` decides; windows over a key find it.
    """
    past = Window.partitionBy(key).orderBy(order)
    before = past.rowsBetween(Window.unboundedPreceding, -1)
    runs = calls.withColumn("_run", F.count_if(~F.col(failed)).over(past))
    run = Window.partitionBy(key, "_run").orderBy(order)
    runs = runs.withColumn("_in_run", F.count_if(F.col(failed)).over(run))
    opened = F.coalesce(F.max("_in_run").over(before) >= limit, F.lit(False))
    earlier = F.coalesce(F.lag("_in_run").over(past), F.lit(0))
    return runs.withColumn("open", opened).withColumn("failures_before", F.when(opened, F.lit(limit)).otherwise(earlier).cast("int")).drop("_run", "_in_run")


def judged(calls: DataFrame) -> DataFrame:
    """is_issue and confidence of calls (is_deterministic, failed, answer, answer_confidence, open): while open the rule's own word at 0.3, after a failure no issue."""
    issue = F.when(F.col("open"), F.col("is_deterministic")).when(F.col("failed"), F.lit(False)).otherwise(F.col("answer"))
    sure = F.when(F.col("open"), 0.3).when(F.col("failed"), 0.0).otherwise(F.col("answer_confidence"))
    return calls.withColumn("is_issue", issue).withColumn("confidence", sure)


def scan_stream(lines: DataFrame) -> DataFrame:
    """The line rules on a streaming table (line, language, any more): stateless, so as on a batch. An addition of this library."""
    return scan_lines(lines)


def breaker_stream(calls: DataFrame, key: str, limit: int = FAILURES) -> DataFrame:
    """The breaker over a stream of calls (key, failed BOOLEAN): key, failures in a row and open after each micro-batch.

    State is two numbers a key. Within a micro-batch calls count in the order in which they come.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, opened = state.get if state.exists else (0, False)
        for rows in batches:
            for bad in rows["failed"]:
                if not opened:
                    run = run + 1 if bad else 0
                    opened = run >= limit
        state.update((run, opened))
        yield pd.DataFrame({key: [keys[0]], "failures": [run], "open": [opened]})

    kind = dict(calls.dtypes)[key]
    return calls.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, failures int, open boolean", "failures int, open boolean", "update", GroupStateTimeout.NoTimeout)
