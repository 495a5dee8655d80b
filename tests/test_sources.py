import json

import pytest
from pyspark.sql import functions as F

from sievelake import schemas
from sievelake.sources import git, symbols, testsets

SHA = "a" * 40


def test_blame(spark):
    text = f"{SHA} 1 1 2\nauthor Ann\nauthor-time 86400\n\tx = 1\n{SHA} 2 2\n\ty\n{'b' * 40} 1 3 1\nauthor Bo\nauthor-time 0\n\tauthor z"
    df = spark.createDataFrame([("f", text), ("empty", ""), ("none", None)], "file string, text string")
    got = [(r.line, r.commit, r.author, r.time.isoformat()) for r in git.blame(df).orderBy("line").collect()]
    assert got == [(1, "aaaaaaaa", "Ann", "1970-01-02T00:00:00"), (2, "aaaaaaaa", "Ann", "1970-01-02T00:00:00"), (3, "bbbbbbbb", "Bo", "1970-01-01T00:00:00")]
    wanted = spark.createDataFrame([("f", 2), ("f", 9)], "file string, line int")
    assert git.blame_lines(wanted, git.blame(df)).count() == 1
    odd = spark.createDataFrame([("f", 1), ("f", 1), ("f", 99), ("f", None), (None, 1), ("h", 1)], "file string, line int")
    assert [r.line for r in git.blame_lines(odd, git.blame(df)).collect()] == [1]  # repeats are told once, what has no blame not at all
    assert git.blame_lines(odd.limit(0), git.blame(df)).count() == git.blame_lines(odd, git.blame(df.limit(0))).count() == 0


def test_logs(spark):
    df = spark.createDataFrame([("f", f"{SHA}\nAnn\na@x\n2024\nfix | it\n\n 1 file changed"), ("g", None)], "file string, text string")
    assert {tuple(r) for r in git.commits(df).collect()} == {("aaaaaaaa", "Ann", "a@x", "2024", "fix | it"), ("", "", "", "", "")}
    log = spark.createDataFrame([("f", "abc first one\ndef\n\nghi third")], "file string, text string")
    assert [(r["hash"], r.message) for r in git.history(log, limit=2).orderBy("pos").collect()] == [("abc", "first one"), ("def", "")]
    assert [r.path for r in git.changed_files(log, "file").collect()] == ["abc first one", "def", "ghi third"]


def test_testset(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"ground_truth": [{"file": "a", "line": 3, "category": "style", "severity": "minor"}], "samples": [{"code": "x", "language": "go"}, {}]}))
    truths, samples = testsets.read(spark, str(tmp_path / "t.json"))
    assert (truths.first().file, truths.first().gt_seq) == ("a", 0)
    assert [(r.diff_content, r.language) for r in samples.orderBy("sample_id").collect()] == [("x", "go"), ("", "")]
    (tmp_path / "bad.json").write_text('{"ground_truth": ')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|FAILFAST"):
        testsets.read(spark, str(tmp_path / "bad.json"))[0].collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.diff").write_text("+++ b/a.py\n+x")
    assert testsets.read_diffs(spark, str(tmp_path / "d")).first().diff_content.startswith("+++ b/a.py")


def test_symbols(spark):
    code = "import os\nx: int = 1\nif x:\n    def f(a) -> str:\n        def inner(): pass\nclass A:\n    def m(self): pass\n"
    df = spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.js", "class B {}"), ("d", "class C"), ("e.py", None)], "path string, source string")
    got = {(r.name, r.kind, r.line_start, r.return_type) for r in symbols.symbols(df).collect()}
    assert got == {("import os", "import", 1, None), ("x", "variable", 2, "int"), ("f", "function", 4, "str"), ("A", "class", 6, None), ("B", "class", 1, None)}
    assert {r.path: r.ok for r in df.select("path", symbols.parses("path", "source").alias("ok")).collect()} == {"a.py": True, "b.py": False, "c.js": True, "d": True, "e.py": True}


def test_schemas(spark):
    for name, schema in schemas.TABLES.items():
        df = spark.createDataFrame([], schema)
        assert name not in schemas.KEYS or schemas.repeated_keys(df, name).count() == 0
    rules = spark.createDataFrame([("A", "style", "minor"), ("A", "style", "fatal"), ("B", None, "info")], "rule_id string, category string, severity string")
    assert schemas.repeated_keys(rules, "rules").first().rule_id == "A" and schemas.outside_domain(rules, "rules").select(F.count("*")).first()[0] == 2
