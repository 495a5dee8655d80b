import json

from sievelake.plans import reviews

DIFF = "diff --git a/a.py b/a.py\n+++ b/a.py\n@@ -0,0 +1,3 @@\n+x = pickle.loads(b)\n+for r in rows:\n+  s += 'x'\n+y = eval(z)  # nolint"


def test_review(spark):
    df = spark.createDataFrame([(1, DIFF, ""), (2, "nothing", "")], "diff_id long, diff_content string, language string")
    found = reviews.review_findings(df)
    assert {(r.rule_id, r.line_start, r.auto_fix_code is not None) for r in found.collect()} == {("SEC-006", 1, True), ("PERF-002", 2, False)}
    got = {r.diff_id: (r.total_issues, r.critical_count, r.minor_count, r.files_analyzed) for r in reviews.review_records(df, found).collect()}
    assert got == {1: (2, 1, 1, 1), 2: (0, 0, 0, 0)}
    assert reviews.review_findings(df, only=("SEC-006",)).count() == 1


def test_path_twice(spark):
    """Two sections of one path: a finding has the code of its own section, and code of files without findings is not shuffled."""
    part = "diff --git a/k.py b/k.py\n+++ b/a/k.py\n@@ -0,0 +1 @@\n+{}\n"
    text = part.format("PASSWORD = 'abcdefghijklmnop'") + part.format("zzz = 1") + part.format("x = eval(y)\n+last = 2")
    df = spark.createDataFrame([(1, text, ""), (2, part.format("calm = 1"), ""), (None, part.format("z = eval(y)"), "")], "diff_id long, diff_content string, language string")
    found = reviews.review_findings(df)
    assert {(r.diff_id, r.rule_id, r.line_start, r.snippet) for r in found.collect()} == {
        (1, "SEC-002", 1, "PASSWORD = 'abcdefghijklmnop'"), (1, "SEC-006", 1, "x = eval(y)\nlast = 2"), (None, "SEC-006", 1, None),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()  # the files lose those without findings before anything of theirs is shuffled
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in plan.split("\n"))


def test_order_of_predictions(spark):
    """Places follow samples, rules, sections and lines within a file and category, however large ids are."""
    text = "diff --git a/k.py b/k.py\n+++ b/k.py\n@@ -0,0 +1 @@\n+x = eval(y)\n+x = md5(y)\n+x = eval(z)"
    df = spark.createDataFrame([(2**40, text, ""), (3, text, "")], "diff_id long, diff_content string, language string")
    got = sorted((r.pred_seq, r.diff_id, r.rule_id, r.line) for r in reviews.predictions(df).collect())
    assert got == [(k + 1, *x) for k, x in enumerate((d, *f) for d in (3, 2**40) for f in (("SEC-006", 1), ("SEC-006", 3), ("SEC-007", 2)))]
    assert reviews.predictions(df.limit(0)).count() == 0


def test_testset(spark, tmp_path):
    truths = [{"file": "a.py", "line": 2, "category": "security", "severity": "critical"}, {"file": "a.py", "line": 40, "category": "style", "severity": "info"}]
    (tmp_path / "t.json").write_text(json.dumps({"ground_truth": truths, "samples": [{"diff": DIFF}]}))
    total, each = reviews.evaluate_testset(spark, str(tmp_path / "t.json"))
    r = total.first()
    assert (r.tp, r.fp, r.fn, r.total_samples, r.recall) == (1, 2, 1, 2, 0.5)
    assert {(r.category, r.recall, r.precision) for r in each.collect()} == {("security", 1.0, 0.5), ("style", 0.0, 0.0)}
