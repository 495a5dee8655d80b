import random

from sievelake.functions import types
from sievelake.operators import dataflow, evaluate, graph, review, search
from sievelake.streaming import state


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", 1) for a, b in pairs], "src long, dst long, kind string, line int")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def found(df):
    return {r.id: r.hop for r in df.collect()}


def test_hops_find_seeds_again(spark):
    assert found(graph.callers(edges(spark, [(1, 1)]), ids(spark, 1), 1)) == {1: 1}
    assert found(graph.callers(edges(spark, [(1, 2), (2, 3), (3, 1)]), ids(spark, 1), 3)) == {3: 1, 2: 2, 1: 3}
    assert found(graph.callees(edges(spark, [(1, 2)]), ids(spark, 1), 0)) == {}


def test_plans_do_not_grow_with_hops(spark):
    chain = edges(spark, [(k, k + 1) for k in range(40)])
    walks = {k: graph.callees(chain, ids(spark, 0), k) for k in (3, 12)}
    assert found(walks[12]) == {k: k for k in range(1, 13)}
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join") for df in walks.values()]
    assert joins == [0, 0]
    assert {r.id for r in graph.reachable(chain, ids(spark, 0)).collect()} == set(range(41))


def test_other_kinds_count_only_in_induced_graphs(spark):
    e = spark.createDataFrame([(1, 2, "imports", 1), (1, 3, "calls", 1)], "src long, dst long, kind string, line int")
    assert found(graph.callees(e, ids(spark, 1), 2)) == {3: 1}
    assert graph.induced(e, ids(spark, 1, 2)).count() == 1


def test_reachability(spark):
    e = edges(spark, [(0, 2), (2, 3), (4, 1)])
    assert {r.id for r in graph.reachable(e, ids(spark, 0)).collect()} == {0, 2, 3}
    assert {r.id for r in graph.unreachable(ids(spark, 0, 1, 2, 3, 4), e, ids(spark, 0)).collect()} == {1, 4}
    assert graph.exit_reachable(e, ids(spark, 0), 1).first()[0] is False


def test_call_edges_take_innermost_caller_and_last_definition(spark):
    symbols = spark.createDataFrame([(1, "f", "a", 1, 9), (2, "g", "a", 2, 4), (3, "f", "b", 1, 3)], "id long, name string, file_path string, line_start int, line_end int")
    calls = spark.createDataFrame([("a", 3, "f"), ("a", 8, "g"), ("a", 20, "f"), ("a", 3, "nope")], "file_path string, line int, callee string")
    assert {(r.src, r.dst, r.line) for r in graph.call_edges(symbols, calls).collect()} == {(2, 3, 3), (1, 2, 8)}


def test_impact_and_risk(spark):
    nodes = spark.createDataFrame([(1, "a", "auth/x.py"), (2, "b", "web/y.py")], "id long, name string, file_path string")
    r = graph.impact_report(nodes, edges(spark, [(1, 2)]), ids(spark, 2)).first()
    assert (r.callers, r.callees, r.modules, r.risk_level) == (["a"], [], ["auth", "web"], "Critical")


def test_reaching_definitions(spark):
    d = spark.createDataFrame([("f", 0, "x"), ("f", 1, "y"), ("f", 2, "x"), ("f", 3, "z")], "function string, id int, variable string")
    got = {r.id: r.reaching_ids for r in dataflow.reaching(d).collect()}
    assert got == {0: [0, 1], 1: [0, 1, 2], 2: [1, 2], 3: [0, 1, 2, 3]}


def test_taint(spark):
    rows = [("f", "x", 1, "UserInput", "request.args"), ("f", "x", 2, "FunctionCall", "cursor.execute(q)"), ("g", "y", 3, "UserInput", "os.environ"), ("g", "y", 4, "FunctionCall", "shlex.quote(v)"), ("g", "y", 5, "FunctionCall", "os.system(v)"), ("h", "z", 6, "Literal", "1")]
    d = spark.createDataFrame(rows, "function string, variable string, id int, source_kind string, source_value string")
    flows = dataflow.taint_flows(d)
    got = {(r.function, r.sink, r.confidence, r.sanitizer_kind, r.source) for r in flows.collect()}
    assert got == {("f", "execute(", 0.85, None, "HttpRequest"), ("f", "cursor.execute", 0.85, None, "HttpRequest"), ("g", "os.system", 0.3, "ShellEscape", "EnvironmentVariable")}
    assert {r.function: r.return_tainted for r in dataflow.taint_summary(d, flows).collect()} == {"f": True, "g": False, "h": False}


def test_types(spark):
    values = {"True": "Bool", "12": "Int", "+5": "Int", "99999999999999999999": "Float", "1e3": "Float", "NaN": "Float", "'x'": "String", "None": "Null", "[1]": "List[Any]", "{}": "Dict[Any, Any]", "x": "Any", "5d": "Any", " 5": "Any", "": "Any", None: None}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.t for r in df.select("v", types.literal_type(df["v"]).alias("t")).collect()}
    assert got == values
    assert types.parse_annotation("Optional[List[int]]") == "Optional[List[Int]]" and types.parse_annotation("Union[int, None]") == "Union[Int, Null]" and types.parse_annotation("Foo") == "Custom(Foo)"
    assert types.compatible("Optional[Int]", "Null") and types.compatible("Union[Int, Null]", "Float") and not types.compatible("Int", "String") and not types.compatible("Optional[Int]", "Float")


def test_greedy_match_is_the_two_loops(spark):
    rng = random.Random(5)
    truths = [(rng.choice("ab"), rng.choice("xy"), rng.randint(1, 40), k) for k in range(80)]
    predictions = [(rng.choice("ab"), rng.choice("xy"), rng.randint(1, 40), k) for k in range(120)]
    used, want = set(), set()
    for f, c, line, k in predictions:
        for g, d, at, j in truths:
            if j not in used and (f, c) == (g, d) and abs(at - line) <= 3:
                used.add(j)
                want.add((k, j))
                break
    t = spark.createDataFrame(truths, "file string, category string, line int, gt_seq int")
    p = spark.createDataFrame(predictions, "file string, category string, line int, pred_seq int")
    m = evaluate.greedy_match(t, p)
    assert {(r.pred_seq, r.gt_seq) for r in m.collect()} == want
    r = evaluate.metrics(t, p, m).first()
    assert (r.tp, r.fp, r.fn) == (len(want), 120 - len(want), 80 - len(want))


def test_empty_evaluation(spark):
    t = spark.createDataFrame([], "file string, category string, line int, gt_seq int")
    p = spark.createDataFrame([], "file string, category string, line int, pred_seq int")
    r = evaluate.metrics(t, p, evaluate.greedy_match(t, p)).first()
    assert (r.recall, r.precision, r.f1_score, r.false_positive_rate) == (0, 0, 0, 0)
    assert evaluate.adoption(spark.createDataFrame([], "feedback string")).first().adoption_rate == 0.0


def test_breaker(spark):
    rows = [("k", n, f == "F") for n, f in enumerate("FFSFFFSFF")]
    got = state.breaker(spark.createDataFrame(rows, "k string, n int, failed boolean"), "k", "n").orderBy("n").collect()
    assert [r.open for r in got] == [False] * 6 + [True] * 3


def test_breaker_stream(spark, tmp_path):
    spark.createDataFrame([("a", True), ("a", True), ("a", True), ("b", True), ("b", False)], "k string, failed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, failed boolean").parquet(str(tmp_path / "in"))
    q = state.breaker_stream(stream, "k").writeStream.format("memory").queryName("breaker").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.open) for r in spark.table("breaker").collect()} == {("a", True), ("b", False)}


def test_scan_stream(spark, tmp_path):
    spark.createDataFrame([("eval(x)", "python"), ("x", "python")], "line string, language string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line string, language string").parquet(str(tmp_path / "in"))
    q = state.scan_stream(stream).writeStream.format("memory").queryName("scanned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.rule_id for r in spark.table("scanned").collect()] == ["SEC-006"]


def test_symbols_and_search(spark):
    code = spark.createDataFrame([("f", "x = 1\nasync def go():\n  pass\nclass A:\n")], "file string, text string")
    assert {(r.name, r.kind, r.line_start) for r in search.symbols_of(code).collect()} == {("go", "function", 2), ("A", "class", 4)}
    lines = spark.createDataFrame([("f", 1, " def go(a=1): "), ("f", 2, "# x = 1"), ("f", 3, "if: x")], "file string, line_no int, line string")
    assert {(r.name, r.kind, r.snippet) for r in search.postings(lines).collect()} == {("go", "function", "def go(a=1):"), ("a", "variable", "def go(a=1):")}
    near = search.similar_lines(lines, spark.createDataFrame([(1, "go def a")], "snippet_id int, text string"), 0.7).collect()
    assert [(r.line_no, r.similarity) for r in near] == [(1, 1.0)]


def test_apply_fix(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "lines array<string>")
    from pyspark.sql import functions as F

    assert df.select(review.apply_fix(F.col("lines"), F.lit(2), F.lit(2), F.lit("B"))).first()[0] == ["a", "B", "c"]


def test_call_sites_have_the_nearest_definition_before_them(spark):
    text = ["setup()", "def f(a):", "    if (a): g(h(a)); f(1)", "class A:", "func k() { k() }", ""]
    lines = spark.createDataFrame([("x.py", k + 1, t) for k, t in enumerate(text)] + [("y.py", 1, None)], "file_path string, line int, text string")
    got = sorted((r.line, r.callee, r.caller) for r in graph.call_sites(lines).collect())
    assert got == [(1, "setup", None), (3, "f", "f"), (3, "g", "f"), (3, "h", "f"), (5, "k", "k")]
    assert graph.call_sites(lines.limit(0)).count() == 0


def test_greedy_matching_of_one_large_group_against_a_loop(spark):
    rng = random.Random(12)
    truths, asked = ([(None, "c", rng.choice([None, rng.randint(1, 400)]), k) for k in range(600)] for _ in range(2))
    want, used = set(), set()
    for _, _, line, seq in asked:
        at = next((k for _, _, n, k in truths if k not in used and abs((n or 0) - (line or 0)) <= 3), None)
        if at is not None:
            used.add(at)
            want.add((seq, at))
    side = lambda rows, seq: spark.createDataFrame(rows, f"file string, category string, line int, {seq} long").repartition(3)
    got = evaluate.greedy_match(side(truths, "gt_seq"), side(asked, "pred_seq")).collect()
    assert {(r.pred_seq, r.gt_seq) for r in got} == want and {r.file for r in got} == {None}


def test_similar_lines_agree_however_many_words_there_are(spark, monkeypatch):
    rng = random.Random(13)
    make = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(n))
    lines = spark.createDataFrame([("f", k, make(rng.randint(0, 9))) for k in range(200)] + [("g", 1, None)], "file string, line_no int, line string")
    snippets = spark.createDataFrame([(k, make(rng.randint(0, 6))) for k in range(12)] + [(20, None)], "snippet_id int, text string")
    few = sorted(map(tuple, search.similar_lines(lines, snippets).collect()))
    monkeypatch.setattr(search, "FEW_WORDS", 3)
    assert few and sorted(map(tuple, search.similar_lines(lines, snippets).collect())) == few
    want = set()
    for s in snippets.collect():
        w = set((s.text or "").split())
        want |= {(s.snippet_id, r.file, r.line_no) for r in lines.collect() if w and len(w & set((r.line or "").split())) >= 0.7 * len(w) - 1e-9}
    assert {t[:3] for t in few} == want
    ranked = search.ranked_similar_lines(search.similar_lines(lines, snippets), 3).collect()
    assert all(r.rank <= 3 for r in ranked) and {r.rank for r in ranked} == {1, 2, 3}
