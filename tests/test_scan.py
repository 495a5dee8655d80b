"""Each active rule has a hit and a near miss; line and file scope, filters and fixes."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelake.operators import review, scan

CASES = {
    "SEC-001": ('cursor.execute("a %s" % x)', "cursor.execute(query, x)"), "SEC-002": ('PASSWORD: "abcdefghijklmnop"', 'PASSWORD: "abcdefghijklmno"'),
    "SEC-003": ("os.system(request.x)", "os.system(cmd)"), "SEC-004": ('open("../x")', 'open("x")'), "SEC-005": ("document.write(req.q)", "document.write(x)"),
    "SEC-006": ("pickle.loads(b)", "json.loads(b)"), "SEC-007": ("nodes.append(x)", "nodex = 1"), "SEC-008": ("get(u, verify = False)", "get(u, verify=True)"),
    "SEC-009": ("redirect(request.u)", "redirect(url)"), "SEC-010": ("fetch((query)", "fetch(u)"),
    "PERF-004": ("sorted(x)[0]", "sorted(x)"), "PERF-005": ("sqlite3.connect()", "sqlite3.connect(p)"), "STYLE-002": ("def f(a, b, c, d, e, g):", "def f(a, b, c, d, e):"),
    "STYLE-003": ("except:", "except ValueError:"), "STYLE-004": ("def f(a=[]):", "def f(a=None):"),
    "PERF-001": ("for r in rows:\n  .execute(q)", "for r in rows:\n  cur.execute(q)"), "PERF-002": ("for r in rows:\n\n  s += 'x'", "for r in rows:\n  s += x"),
    "PERF-003": ("async def f():\n  time.sleep(1)", "def f():\n  time.sleep(1)"), "PERF-006": ("for r in rows:\n  .write(r)", "for r in rows:\n  f.write(r)"),
    "PERF-007": ("for r in rows:\n  re.match(p, r)", "for r in rows:\n  p.match(r)"),
}


def files(spark, texts, language="python"):
    rows = [(k, f"f{k}.py", t.split("\n"), language) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "diff_id long, path string, added_lines array<string>, language string")


def lines(spark, texts, language="python"):
    rows = [(k, f"f{k}.py", language, n + 1, line) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "diff_id long, path string, language string, line_start int, line string")


def test_every_active_rule_has_a_case():
    assert {r["rule_id"] for r in scan.active_rules()} == set(CASES) and len(CASES) == 20


def test_hits_and_near_misses(spark):
    language = {"SEC-005": "javascript"}
    for lang in ("python", "javascript"):
        ids = [r for r in CASES if language.get(r, "python") == lang]
        for which in (0, 1):
            texts = [CASES[r][which] for r in ids]
            found = scan.findings(lines(spark, texts, lang), files(spark, texts, lang))
            got = {(r.diff_id, r.rule_id) for r in found.select("diff_id", "rule_id").collect()}
            for k, r in enumerate(ids):
                assert ((k, r) in got) == (which == 0), (r, which)


def test_matches_python_regular_expressions(spark):
    texts = [t for pair in CASES.values() for t in pair] + ["for r in rows:\n .get(1)\nx\nfor é in b:\n .find(2)", "", "for a in b:\n  .get(1)\n  for c in d:\n  .get(2)"]
    got = sorted((r.diff_id, r.rule_id, r.line_start, r.line_content) for r in scan.findings(lines(spark, texts), files(spark, texts)).collect())
    want = []
    for k, text in enumerate(texts):
        split = text.split("\n")
        for rule in scan.active_rules():
            if rule["language"] not in ("all", "python"):
                continue
            pattern = re.compile(rule["pattern"], re.I | re.M)
            if scan.file_scoped(rule):
                at = [text[: m.start()].count("\n") + 1 for m in pattern.finditer(text)]
            else:
                at = [n + 1 for n, line in enumerate(split) if pattern.search(line)]
            want += [(k, rule["rule_id"], n, split[min(n, len(split)) - 1]) for n in at]
    assert got == sorted(want)


def test_gate_toggle_and_nulls(spark):
    df = lines(spark, ["document.write(req.q)"], "typescript")
    assert scan.scan_lines(df).count() == 0
    assert scan.scan_lines(lines(spark, ["pickle.loads(b)"]), scan.active_rules(disabled=("SEC-006",))).count() == 0
    blank = spark.createDataFrame([(1, None, None, 1, None)], df.schema)
    assert scan.scan_lines(blank).count() == 0


@pytest.mark.parametrize(("path", "line", "severity"), [("a/test_x.py", "pickle.loads(b)", "minor"), ("tests/x.py", "pickle.loads(b)", "critical"), ("a/tests/x.py", "eval(b)", "minor"), ("x.py", "eval(b) # nolint", None), ("x.py", "eval(b) # NOLINT", "critical")])
def test_context_filter(spark, path, line, severity):
    df = spark.createDataFrame([(1, path, "python", 1, line)], "diff_id long, path string, language string, line_start int, line string")
    got = [r.severity for r in scan.context_filter(scan.findings(df)).collect()]
    assert got == ([severity] if severity else [])


def test_fixes(spark):
    rows = [("SEC-001", "security", "critical", "x"), ("SEC-001", "security", "minor", "x"), ("SEC-009", "security", "major", 'execute(f"a" + b)'), ("SEC-X", "security", "major", "a.innerHTML = b"), ("PERF-X", "performance", "major", "s += 1"), ("S", "style", "major", "x")]
    df = spark.createDataFrame([(*r, r[3] + " for ") for r in rows], "rule_id string, category string, severity string, line_content string, snippet string")
    got = [r.auto_fix_code for r in review.with_fixes(df).collect()]
    assert got[0].startswith("cursor.execute(query") and got[1] is None and got[2] == 'execute("a" ,  b)' and got[3] == "a.textContent = b" and got[4].startswith("# Use") and got[5] is None


@given(st.sampled_from([r for r in scan.RULE_DICTS if r["pattern"]]), st.data())
@settings(max_examples=300, deadline=None)
def test_what_a_pattern_matches_holds_one_of_its_needles(rule, data):
    """Also where case, or a letter that is one without case, differs."""
    text = data.draw(st.from_regex(rule["pattern"]))
    fold = {"s": "\u017f", "k": "\u212a", "i": "\u0131"}
    text = "".join(data.draw(st.sampled_from([c, c.swapcase() if len(c.swapcase()) == 1 else c, fold.get(c.lower(), c)])) if c.isascii() and c.isalpha() else c for c in text)
    lowered = text.translate(str.maketrans(*scan.FOLDS)).lower()
    parts = scan.needles(rule["pattern"])
    assert parts is None or any(p in lowered for p in parts)


def test_letters_that_fold_to_ascii_are_known():
    """Whatever a pattern that ignores case takes for a letter a-z is one of scan.FOLDS, or in them."""
    fold = lambda c: chr(c).upper().lower() if len(chr(c).upper()) == 1 else chr(c)
    found = {chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and "a" <= fold(c)[0] <= "z"}
    assert found == set(scan.FOLDS[0])


def test_rules_see_letters_without_case(spark):
    lines = spark.createDataFrame([("pa\u017fsword = 'abcdefghijklmnopq'", "x"), ("TO\u212aEN: 'abcdefghijklmnopq'", "x"), ("ver\u0131fy=False", "x")], "line string, language string")
    plain = [r for r in scan.active_rules() if not scan.file_scoped(r)]
    want = [r["rule_id"] for r in plain for line, _ in map(tuple, lines.collect()) if spark.range(1).select(F.lit(line).rlike(scan.FLAGS + r["pattern"])).first()[0]]
    assert sorted(r.rule_id for r in scan.scan_lines(lines).collect()) == sorted(want) and len(want) >= 2


def test_a_rule_with_a_broken_pattern_is_left_out(spark):
    broken = scan.RULE_DICTS[0] | {"rule_id": "X-1", "pattern": "(a"}
    fine = scan.RULE_DICTS[0] | {"rule_id": "X-2", "pattern": "a\nb"}
    lines = spark.createDataFrame([("(a", "x")], "line string, language string")
    with pytest.warns(UserWarning, match="X-1"):
        assert scan.scan_lines(lines, [broken]).count() == 0
    code = spark.createDataFrame([(["x a", "b"], "x")], "added_lines array<string>, language string")
    assert [(r.rule_id, r.line_start) for r in scan.scan_files(code, [fine]).collect()] == [("X-2", 1)]


def test_many_rules(spark):
    """The automaton finds what one rule after the other finds: null lines, rules without a common string, languages, letters beyond ASCII."""
    rng = __import__("random").Random(4)
    rules = scan.active_rules() + [dict(scan.RULE_DICTS[0], rule_id=f"X-{k}", pattern=p, language=rng.choice(["all", "python"])) for k, p in enumerate([rf"word{k}\s*\(" for k in range(120)] + ["[xy]{3}", "kelvin|pot", "a.b"])]
    words = ["word7 (", "WORD77(", "xyx", "eval(", "\u212aelvin", "é", " ", "acb", "md5(", "verify=False", "password = 'abcdefghijklmnop'"]
    lines = [(k, None if k == 5 else "".join(rng.choice(words) for _ in range(rng.randint(0, 5))), rng.choice(["python", "go", None])) for k in range(150)]
    df = spark.createDataFrame(lines, "n long, line string, language string")
    rows = lambda frame: sorted((r.n, r.rule_id, r.severity, r.title, r.line) for r in frame.collect())
    found = scan.scan_lines_with_many(df, rules)
    want = rows(scan.scan_lines(df, rules))
    assert rows(found) == want and len(want) > 100 and found.columns == scan.scan_lines(df, rules[:2]).columns
    assert scan.scan_lines_with_many(df, []).count() == 0 and scan.scan_lines_with_many(df.limit(0), rules).count() == 0
