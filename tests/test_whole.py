"""Queries read every row of their tables: against loops over the whole tables, not against SQL that leaves rows out."""

import re

import pandas as pd

from sievelake.functions.fixed_values import KEYWORDS
from sievelake.operators import search
from sievelake.plans import queries
from sievelake.plans.tables import customer_edges

SF = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_multiline_rule_reads_texts_beyond_ascii(spark):
    pattern = re.compile(r"\.\n[A-Z]\w+ ", re.IGNORECASE)
    want = {d: len(pattern.findall(t)) for d, t in zip(*(read("documents")[c] for c in ("doc_id", "text")), strict=True)}
    assert any(n and not t.isascii() for n, t in zip(want.values(), read("documents").text, strict=True))
    assert {r.doc_id: r.n for r in queries.rule_scan_multiline(spark, SF).collect()} == {d: n for d, n in want.items() if n}


def test_graph_queries_walk_the_edges_of_all_orders(spark):
    orders, customers = read("orders"), read("customer")
    edges = set(zip(orders.o_custkey, orders.o_orderkey % len(customers) + 1, strict=True))
    assert {(r.src, r.dst) for r in customer_edges(spark, SF).collect()} == edges

    def hops(pairs, most):
        out, now = {}, {11}
        for hop in range(1, most + 1):
            now = {b for a, b in pairs if a in now}
            for i in now:
                out.setdefault(i, hop)
        return out

    back = {(b, a) for a, b in edges}
    ids = lambda df: {r.id for r in df.collect()}
    assert {r.id: r.hop for r in queries.callees_k(spark, SF).collect()} == hops(edges, 3)
    assert {r.id: r.hop for r in queries.callers_k(spark, SF).collect()} == hops(back, 3)
    near = {11, *hops(edges, 2), *hops(back, 2)}
    pairs = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert pairs(queries.impact_subgraph(spark, SF)) == {(a, b) for a, b in edges if a in near and b in near}
    rich = set(customers.c_custkey[customers.c_acctbal > 0])
    assert pairs(queries.induced_edges(spark, SF)) == {(a, b) for a, b in edges if a in rich and b in rich}
    assert ids(queries.filter_hops(spark, SF)) == {11, *hops(edges | back, 2)}
    reached = {11, *hops(edges, len(customers))}
    assert ids(queries.reachable(spark, SF)) == reached
    assert ids(queries.unreachable(spark, SF)) == set(customers.c_custkey) - reached
    callers = set(hops(back, 2)) - {11}
    nations = set(customers.c_nationkey[customers.c_custkey.isin(near)])
    found = queries.risk_level(spark, SF).first()
    assert (found.n_callers, found.n_modules) == (len(callers), len(nations))
    assert found.risk_level == ("High" if len(callers) > 20 else "Medium" if len(callers) > 5 or callers and len(nations) > 3 else "Low")


def postings_of(line):
    name, var, text = (re.search(p, line) for p in (r"(?:def|fn|func|function|class)\s+(\w+)", r"(\w+)\s*[:=]", ""))
    text = re.sub(r"^\s+|\s+$", "", line, flags=re.ASCII)
    out = [(name[1], "function", text)] if name else []
    return out + ([(var[1], "variable", text)] if var and var[1] not in KEYWORDS and not text.startswith(("#", "//", "/*")) else [])


def test_symbol_index_has_every_line_and_both_kinds(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((*found, d, k) for d, t in zip(docs.doc_id, docs.text, strict=True) for k, line in enumerate(t.split("\n"), 1) for found in postings_of(line))
    got = sorted((r.name, r.kind, r.snippet, r.file, r.line_no) for r in queries.symbol_index(spark, "/root/testdata/sf0.01").collect())
    assert got == want and any(not r[2].isascii() for r in want)


def test_postings_of_names_beyond_ascii(spark):
    lines = spark.createDataFrame([("f", 1, "größe = 1"), ("f", 2, "def zähle(x):"), ("f", 3, "token: 'é'")], "file string, line_no int, line string")
    assert {(r.name, r.kind, r.line_no) for r in search.postings(lines).collect()} == {("größe", "variable", 1), ("zähle", "function", 2), ("token", "variable", 3)}


def test_positional_diff_compares_each_turn_with_the_next(spark):
    turns = read("conversations")
    texts = {(c, n): t.split("\n") for c, n, t in zip(turns.conv_id, turns.turn, turns.text, strict=True)}
    assert len(texts) == len(turns) and turns.turn.max() > 1
    want = []
    for c, n in {(c, n) for c, n in texts} | {(c, n - 1) for c, n in texts if n > 0}:
        a, b = texts.get((c, n), []), texts.get((c, n + 1), [])
        for k in range(max(len(a), len(b))):
            old, new = (x[k] if k < len(x) else None for x in (a, b))
            want.append((c, n, k, old, new, old != new))
    got = [(r.conv_id, r.turn, r.pos, r.old_line, r.new_line, r.changed) for r in queries.token_positional_diff(spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
