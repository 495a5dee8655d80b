"""Functions solved whole in a task against loops, the fixpoint in rounds, and sizes that rounds of bitmaps do not bear."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from test_flows import STEPS, dominated_by_removal, random_flows

from pyspark.sql import functions as F
from sievelake import catalog
from sievelake.operators import controlflow, flowtasks


def test_dominator_tree_of_many_blocks(spark):
    """Blocks in a binary tree with ways back: rounds of bitmaps make 60,000 * 60,000 / 64 rows a function of this."""
    n = 60_000
    blocks = spark.range(2, n + 1).crossJoin(spark.createDataFrame([("f",), ("g",)], "function string"))
    ways = F.array(F.struct(F.floor(F.col("id") / 2).alias("src"), F.col("id").alias("dst")), F.struct(F.col("id").alias("src"), F.floor(F.col("id") / 8).alias("dst")))
    edges = blocks.select("function", F.explode(ways).alias("e")).select("function", "e.*").filter("dst > 0")
    tree = controlflow.dominator_tree(edges, spark.createDataFrame([("f", 1), ("g", 1)], "function string, block long"))
    assert tree.filter("idom IS NULL").count() == 2 and tree.filter("idom = floor(block / 2)").count() == 2 * (n - 1) == tree.count() - 2
    above = controlflow.dominators(edges, spark.createDataFrame([("g", 1)], "function string, block long"))
    assert above.count() == sum(k.bit_length() for k in range(1, n + 1)) and above.filter("function <> 'g' OR shiftright(block, cast(floor(log2(block)) - floor(log2(dominator)) as int)) <> dominator").isEmpty()


def test_dominator_tree_is_of_the_sets(spark):
    rng = random.Random(11)
    edges = random_flows(rng, 40, 12)
    entries = [(f, 1) for f in sorted({e[0] for e in edges if e[0]})] + [("f2", 2), ("alone", 5), (None, 1)]
    for backward in (False, True):
        want = dominated_by_removal(edges, [e for e in entries if e[0]], backward)
        sets = {}
        for f, b, d in want:
            sets.setdefault((f, b), set()).add(d)
        got = [tuple(r) for r in controlflow.dominator_tree(spark.createDataFrame(edges, STEPS), spark.createDataFrame(entries, "function string, block long"), backward).collect()]
        assert {(f, b) for f, b, _ in got} == set(sets) and len(got) == len(sets)
        assert all(sets[f, b] - {b} == (sets[f, d] if d is not None else set()) for f, b, d in got)


def test_dominators_along_long_ways(spark):
    """As many rounds as blocks: Spark's size estimates, handed on, had their digits doubled each round and filled the driver."""
    n = 300
    edges = spark.range(1, n).select(F.lit("f").alias("function"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    last = spark.createDataFrame([("f", n)], "function string, block long")
    pairs = controlflow.dominators(edges, last, backward=True)
    assert pairs.count() == n * (n + 1) // 2 and pairs.filter("dominator < block").isEmpty()


def table(rows, **types):
    return pa.Table.from_pylist([dict(zip(types, r)) for r in rows], pa.schema([(k, getattr(pa, t)()) for k, t in types.items()]))


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 20])
def test_dominators_of_batches(size, monkeypatch):
    """Wherever batches of functions are cut, and however few rows are sent at once."""
    rng = random.Random(size)
    edges = [e for e in random_flows(rng, 12, 9) if None not in e]
    entries = [(f, 1) for f in sorted({e[0] for e in edges})] + [("f2", 3)]
    rows = table(sorted(edges + [(f, None, b) for f, b in entries], key=lambda r: r[0]), function="string", block="int64", to="int64")
    for name in ("ROWS", "SENT"):
        monkeypatch.setattr(flowtasks, name, size)
    for most in (1, 2, 100):
        got = [tuple(r.values()) for b in flowtasks.all_dominators(iter(rows.to_batches(max_chunksize=most))) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == dominated_by_removal(edges, entries)
    assert not list(flowtasks.nearest_dominators(iter([])))


def followed(edges, definitions):
    """What is at the beginning and at the end of each block: each definition followed from its block, up to those that define its variable."""
    after, last, into = {}, {}, set()
    for f, a, b in edges:
        after.setdefault((f, a), set()).add(b)
    for f, b, i, v in definitions:
        last[f, b, v] = max(i, last.get((f, b, v), i))
    out = {(f, b, i) for (f, b, _), i in last.items()}
    for (f, b, v), i in last.items():
        work = [b]
        while work:
            for to in after.get((f, work.pop()), ()):
                if (f, to, i) not in into:
                    into.add((f, to, i))
                    if (f, to, v) not in last:
                        out.add((f, to, i))
                        work.append(to)
    return into, out


@pytest.mark.parametrize("size", [1, 3, 40, 1 << 20])
def test_reached_of_batches(size, monkeypatch):
    """Wherever batches of functions are cut, however few definitions are followed at once, and whatever repeats."""
    rng = random.Random(size + 1)
    edges = [e for e in random_flows(rng, 9, 8) if None not in e]
    definitions = [(f"f{k}", rng.randint(1, 10), n, rng.choice("xyz")) for k in range(10) for n in range((0, 3, 9, 70)[k % 4])]
    rows = [(f, a, b, None, None) for f, a, b in edges] + [(f, b, None, i, v) for f, b, i, v in definitions + definitions[:9]]
    rows = table(sorted(rows, key=lambda r: (r[0], -1 if r[3] is None else r[3])), function="string", block="int64", to="int64", id="int32", variable="string")
    for name in ("ROWS", "CELLS", "SENT"):
        monkeypatch.setattr(flowtasks, name, size)
    for after, want in enumerate(followed(edges, definitions)):
        for most in (1, 4, 1000):
            got = [tuple(r.values()) for b in flowtasks.reached(iter(rows.to_batches(max_chunksize=most)), bool(after)) for r in b.to_pylist()]
            assert len(got) == len(set(got)) and set(got) == want


def test_reaching_of_large_functions(spark):
    """Functions above the limit go through rounds: the same results."""
    rng = random.Random(17)
    edges = [e for e in random_flows(rng, 8, 6) if None not in e]
    definitions = [(f"f{k}", rng.randint(1, 7), n, rng.choice("xy")) for k in range(8) for n in range((2, 12)[k % 2])]
    tables = spark.createDataFrame(definitions, "function string, block long, id long, variable string"), spark.createDataFrame(edges, STEPS)
    for got, want in zip(controlflow.reaching_along(*tables, most=10), followed(edges, definitions)):
        got = [tuple(r) for r in got.collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["leaving_along_flow", "reaching_along_flow"])
def test_flows_keep_nothing(spark, name):
    """Small functions leave no table of any round on disk, where each round kept two."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    stored = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = stored()
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert stored() <= before


def test_rounds_end(spark):
    """Functions above the limit go through rounds: the same results, and more rounds than the digits of an estimate could bear."""
    rng = random.Random(13)
    edges = random_flows(rng, 5, 7) + [("long", k, k + 1) for k in range(1, 36)]
    entries = spark.createDataFrame([(f, 1) for f in ("f0", "f1", "f2", "f3", "f4")] + [("long", 36)], "function string, block long")
    steps = spark.createDataFrame(edges, STEPS)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(controlflow.dominators(steps, entries, True, 0)) == rows(controlflow.dominators(steps, entries, True))
    assert rows(controlflow.dominator_tree(steps, entries, False, 8)) == rows(controlflow.dominator_tree(steps, entries))


def test_union_dealt_by_function(spark):
    """Edges and entries that are both dealt by function already, of very different sizes: a function's rows come together all the same."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(was, ("16", "false", "64k", "-1")):
            spark.conf.set(k, v)
        blocks = spark.range(40_000).select((F.col("id") % 20).alias("function"), (F.floor(F.col("id") / 20) + 1).alias("block"))
        top = blocks.groupBy("function").agg(F.collect_list("block").alias("all"), F.max("block").alias("last"))
        edges = top.select("function", F.explode("all").alias("dst")).filter("dst > 1").select("function", F.floor(F.col("dst") / 2).alias("src"), "dst")
        entries = blocks.groupBy("function").agg(F.min("block").alias("block"))
        tree = controlflow.dominator_tree(edges, entries)
        assert tree.count() == 40_000 and tree.filter("idom = floor(block / 2)").count() == 40_000 - 20
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
