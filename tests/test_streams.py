"""Stateful streams and the exactly-once table, against plain loops, with rows out of order, restarts and replays."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievelake.streaming import sink, stateful

START = datetime(2024, 1, 1)
ENTRY = "function_name string, hash string, inserted_at timestamp_ntz, seq long"


def at(seconds):
    return START + timedelta(seconds=seconds)


def stream(spark, rows, schema, path):
    """Adds ``rows`` as a file to the folder that the stream reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cache(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["f", "g", "h", "i", None]), rng.choice(["a", "b", None]), at(rng.randint(0, 300)), n) for n in range(120)]
    rows += [("late", "x", at(500), 0), ("late", "y", at(500), 1), ("gone", "x", at(500), 2), ("gone", None, at(501), 3), ("none", "x", None, 4), ("f", "z", at(520), None)]
    rng.shuffle(rows)
    folder, path, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for k in range(3):  # stopped and started again between its files
        changes = stateful.drained(stateful.cache_changes(stream(spark, rows[k::3], ENTRY, folder), ttl_s=100), path, offsets)
        seen = [r for j in range(k + 1) for r in rows[j::3] if r[2]]
        newest = {}
        for name, value, when, seq in seen:
            newest[name] = max(newest.get(name, (START, -1, "")), (when, seq or 0, value), key=lambda x: x[:2])
        limit = max(r[2] for r in seen) - timedelta(seconds=100)
        want = {(name, stateful.micros(when), seq, value) for name, (when, seq, value) in newest.items() if value is not None and when > limit}
        assert {tuple(r) for r in stateful.live_entries(changes).collect()} == want
    assert changes.count() == changes.distinct().count()  # nothing came out twice


def test_breaker_in_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), at(n + rng.random()), n, rng.choice([True, True, False, None])) for n in range(150)] + [("a", None, 900, True)]
    order = sorted(rows, key=lambda r: (r[1] or START) + timedelta(seconds=rng.randint(0, 20)))  # at most 21 seconds late
    folder, path, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    schema = "k string, time timestamp_ntz, seq long, failed boolean"
    for part in (order[:70], order[70:110], order[110:], [("beat", at(10_000), 0, False)]):
        out = stateful.drained(stateful.breaker_in_order(stream(spark, part, schema, folder), "k", "30 seconds"), path, offsets)
    want = set()
    for k in ("a", "b", None):
        failures, opened = 0, False
        for _, when, seq, bad in sorted((r for r in rows if r[0] == k and r[1]), key=lambda r: (r[1], r[2])):
            want.add((k, stateful.micros(when), seq, bool(bad), failures, opened))
            if not opened:
                failures = failures + 1 if bad else 0
                opened = failures >= 3
    got = [tuple(r) for r in out.filter("k IS NULL OR k <> 'beat'").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_batches_once(spark, tmp_path):
    to = sink.BatchTable(spark, f"file://{tmp_path}/t", "k long, v string, n long")
    made = lambda *rows: spark.createDataFrame(rows, to.schema)
    assert to.read().count() == 0 and to.latest("k", F.desc("n")).count() == 0 and to.compact("k", F.desc("n")).count() == 0
    assert to.write(made((1, "a", 1), (None, "b", 1)), 0)
    assert not to.write(made((1, "other", 9)), 0)  # a replay with other rows even
    assert not to._commit(0, "data/lost")  # a second attempt that comes to its end after the first
    made((1, "lost", 99)).write.parquet(f"file://{tmp_path}/t/data/000000000001-dead")  # an attempt without a manifest
    assert to.write(made((1, "c", 2), (2, None, 1)), 1) and to.write(made(), 2)
    want = {(1, "c", 2), (2, None, 1), (None, "b", 1)}
    assert {tuple(r) for r in to.latest("k", F.desc("n")).collect()} == want
    assert {tuple(r) for r in to.compact("k", F.desc("n")).collect()} == want
    assert to.read().count() == 3 and not to.write(made((7, "x", 1)), 1)  # compacted batches stay known
    assert to.write(made((2, "d", 2)), 3)
    assert {tuple(r) for r in to.latest("k", F.desc("n")).collect()} == {(1, "c", 2), (2, "d", 2), (None, "b", 1)}


def test_replay(spark, tmp_path):
    """A batch that was written, but whose end Spark did not get to note, is replayed and changes nothing."""
    to = sink.BatchTable(spark, f"file://{tmp_path}/t", "k long, v string")
    folder, offsets = str(tmp_path / "in"), str(tmp_path / "offsets")
    sink.upserted(stream(spark, [(1, "a"), (2, "b")], to.schema, folder), to, offsets)
    before = to.committed()
    os.remove(f"{offsets}/commits/0")
    os.remove(f"{offsets}/commits/.0.crc")
    sink.upserted(stream(spark, [(2, "c")], to.schema, folder), to, offsets)
    assert {b: f for b, f in to.committed().items() if b in before} == before
    assert sorted((r.k, r.v) for r in to.read().collect()) == [(1, "a"), (2, "b"), (2, "c")]
