"""Queries that run over the events as a stream: dealt into files, read one a micro-batch, and run until all has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import scratch
from ..streaming import sink, stateful
from .queries import ORACLE_SQL, query
from .tables import table

FILES = 3


def _as_stream(spark: SparkSession, rows: DataFrame, path: str | None = None, files: int = FILES) -> DataFrame:
    """A stream of ``rows`` in files that are in no order, one a micro-batch."""
    path = path or scratch(spark, "stream-input")
    rows.repartition(files, F.xxhash64(*rows.columns)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(ORACLE_SQL["cache_ttl"])
def cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live entries of a cache with a time to live, after a stream of puts."""
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("function_name"), F.col("event_type").alias("hash"), F.col("ts").alias("inserted_at"), F.col("event_id").alias("seq"))
    changes = stateful.cache_changes(_as_stream(spark, entries))
    return stateful.live_entries(stateful.drained(changes, scratch(spark, "cache"), scratch(spark, "cache-offsets"))).select("function_name", "hash")


@query(ORACLE_SQL["circuit_breaker"])
def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker over calls out of order, which wait until the watermark has passed them.

    A call of no user that comes a delay later, when the stream has stopped and is started again from its checkpoint, lets the last ones go.
    """
    events = table(spark, sf_dir, "events")
    calls = events.select("user_id", F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click", "view").alias("failed"))
    days = events.agg(F.datediff(F.max("ts"), F.min("ts")) + 1).first()[0] or 1
    last = calls.agg((F.max("time") + F.make_dt_interval(days=F.lit(2 * days))).alias("time")).filter("time IS NOT NULL")
    beat = last.select(F.lit(None).cast("long").alias("user_id"), "time", F.lit(0).cast("long").alias("seq"), F.lit(False).alias("failed"))
    path, to, offsets = (scratch(spark, name) for name in ("stream-input", "breaker", "breaker-offsets"))
    for rows in (calls, beat):
        out = stateful.drained(stateful.breaker_in_order(_as_stream(spark, rows, path), "user_id", f"{days} days"), to, offsets)
    return out.filter("user_id IS NOT NULL").select(F.col("seq").alias("event_id"), "user_id", "failed", "open")


@query(ORACLE_SQL["latest_status"])
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each review, after micro-batches that each change the table once; half of them are compacted on the way."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), "value", "ts", "event_id")
    to = sink.BatchTable(spark, scratch(spark, "status"), rows.schema)
    order = F.desc("ts"), F.desc("event_id")
    offsets = scratch(spark, "status-offsets")
    sink.upserted(_as_stream(spark, rows), to, offsets)
    return to.compact("user_id", *order).select("user_id", "status", "value")
