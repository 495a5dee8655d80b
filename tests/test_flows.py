"""Fixpoints along edges against plain loops, on random graphs with cycles, nulls and repeats."""

import random
from collections import deque

from sievelake.operators import controlflow, dataflow, graph

STEPS = "function string, src long, dst long"


def random_flows(rng, functions=6, most=9):
    """Edges of each function, some with more than 64 blocks in a row before the others; repeats and nulls."""
    out = []
    for k in range(functions):
        n = rng.randint(1, most)
        out += [(f"f{k}", rng.randint(1, n), rng.randint(1, n)) for _ in range(rng.randint(1, 2 * n))]
    return [*out, *out[:3], ("f0", None, 1), (None, 1, 2), ("f1", 1, None)]


def whole(rows):
    return [r for r in rows if None not in r]


def test_chains(spark):
    rng = random.Random(3)
    edges = [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(45)] + [(50, 51), (51, 50), (60, 60), (1, None)]
    df = spark.createDataFrame([(a, b, "calls") for a, b in edges] + [(70, 1, "reads")], "src long, dst long, kind string")
    for seeds, k, backward in (([1, 2], 3, True), ([1], None, False), ([50, 60, 99], None, True), ([1], 0, True)):
        got = {r.id: (r.hop, r.chain) for r in graph.chains(df, spark.createDataFrame([(s,) for s in seeds], "id long"), k, backward).collect()}
        want, frontier, hop = {}, {s: [s] for s in seeds}, 0
        while frontier and (k is None or hop < k):
            hop, new = hop + 1, {}
            for a, b in whole(edges):
                at, to = (b, a) if backward else (a, b)
                if at in frontier and to not in want and (to not in new or at < new[to][-2]):
                    new[to] = [*frontier[at], to]
            want.update({n: (hop, c) for n, c in new.items()})
            frontier = new
        assert got == want
    assert graph.chains(df.limit(0), spark.createDataFrame([(1,)], "id long")).count() == 0


def test_reaching_along(spark):
    rng = random.Random(5)
    edges = random_flows(rng, 6, 7)
    definitions = [(f"f{k}", rng.randint(1, 9), n, rng.choice("xyz")) for k in range(6) for n in range((2, 5, 80)[k % 3])]
    into, out = {}, {}
    kill = lambda f, b: {v for g, c, _, v in definitions if (g, c) == (f, b)}
    gen = lambda f, b: {max(i for g, c, i, w in definitions if (g, c, w) == (f, b, v)) for v in kill(f, b)}
    variable = {(f, i): v for f, _, i, v in definitions}
    places = {(f, b) for f, b, *_ in definitions} | {(f, b) for f, a, c in whole(edges) for b in (a, c)}
    for p in places:
        into[p], out[p] = set(), gen(*p)
    work = deque(places)
    while work:
        f, b = work.popleft()
        for _, _, dst in (e for e in whole(edges) if e[:2] == (f, b)):
            if not out[f, b] <= into[f, dst]:
                into[f, dst] |= out[f, b]
                out[f, dst] = gen(f, dst) | {i for i in into[f, dst] if variable[f, i] not in kill(f, dst)}
                work.append((f, dst))
    rows = spark.createDataFrame([*definitions, *definitions[:4], ("f0", None, 1, "x"), ("f0", 1, 7, None)], "function string, block long, id long, variable string")
    before, after = controlflow.reaching_along(rows, spark.createDataFrame(edges, STEPS))
    for got, want in ((before, into), (after, out)):
        got = [tuple(r) for r in got.collect()]
        assert len(got) == len(set(got)) and set(got) == {(f, b, i) for (f, b), ids in want.items() for i in ids}
    assert all(x.count() == 0 for x in controlflow.reaching_along(rows.limit(0), spark.createDataFrame(edges, STEPS)))


def dominated_by_removal(edges, entries, backward=False):
    after = {}
    for f, a, b in whole(edges):
        a, b = (b, a) if backward else (a, b)
        after.setdefault((f, a), set()).add(b)

    def reached(f, without=None):
        met = {b for g, b in entries if g == f and b != without}
        work = list(met)
        while work:
            new = after.get((f, work.pop()), set()) - met - {without}
            met |= new
            work += new
        return met

    out = set()
    for f in {f for f, _ in entries}:
        blocks = reached(f)
        out |= {(f, b, b) for b in blocks} | {(f, b, x) for x in blocks for b in blocks - reached(f, x)}
    return out


def test_dominators(spark):
    rng = random.Random(7)
    edges = random_flows(rng, 6, 6) + [("long", k, k + 1) for k in range(1, 4)] + [("wide", 1, k) for k in range(2, 150)] + [("wide", k, 150) for k in range(2, 150)]
    entries = [(f, 1) for f in sorted({e[0] for e in edges if e[0]})] + [("f2", 2), ("alone", 5)]
    for backward in (False, True):
        dominated = controlflow.dominators(spark.createDataFrame(edges, STEPS), spark.createDataFrame([*entries, ("f0", None)], "function string, block long"), backward)
        got = [tuple(r) for r in dominated.collect()]
        want = dominated_by_removal(edges, entries, backward)
        assert len(got) == len(set(got)) and set(got) == want
        nearest = {(r.function, r.block): r.idom for r in controlflow.immediate_dominators(dominated).collect()}
        for (f, b), idom in nearest.items():
            others = {d for g, c, d in want if (g, c) == (f, b) and d != b}
            assert (idom is None) == (not others) and (idom is None or {d for g, c, d in want if (g, c) == (f, idom)} == others)


def test_sinks_across_calls(spark):
    """Through two calls and a cycle; sanitized flows and calls pass nothing on."""
    flows = spark.createDataFrame([("a", "eval(", False), ("a", "open(", True), ("x", "open(", False), ("x", "open(", False), (None, "open(", False)], "function string, sink string, sanitized boolean")
    calls = [("b", "a", False), ("c", "b", False), ("b", "c", False), ("d", "a", True), ("a", "x", None), ("x", "x", False), (None, "a", False), ("b", "a", False)]
    got = {tuple(r) for r in dataflow.sinks_across_calls(flows, spark.createDataFrame(calls, "src string, dst string, sanitized boolean")).collect()}
    assert got == {("a", "eval(", 0), ("b", "eval(", 1), ("c", "eval(", 2), ("x", "open(", 0), ("a", "open(", 1), ("b", "open(", 2), ("c", "open(", 3)}
    assert dataflow.sinks_across_calls(flows.limit(0), spark.createDataFrame([], "src string, dst string")).count() == 0
