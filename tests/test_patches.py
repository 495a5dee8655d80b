"""The data source of patches and the committing sink of findings."""

import os

from pyspark.sql import functions as F

from sievelake.sources import patches


def part(path, *lines):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -0,0 +1 @@\n" + "\n".join(lines)


def test_sections():
    text = "stray\nFrom a Mon Sep 17 00:00:00 2001\nSubject: x\n\n" + part("k.py", "+From here", "+é") + "\n" + part("m.py") + "\nFrom b Mon Sep 17 00:00:00 2001\ndiff --git a/x b/x\ndeleted file mode\n+++ /dev/null"
    got = list(patches.sections(iter(text.split("\n"))))
    assert [(d, s, p) for d, s, p, _ in got] == [("a", 1, "k.py"), ("a", 2, "m.py"), ("b", 1, None)]
    assert got[0][3] == part("k.py", "+From here", "+é") and list(patches.sections(iter([]))) == [] and list(patches.sections(iter(["x", "+++ b/y"]))) == []


def test_source(spark, tmp_path):
    patches.register(spark)
    rows = [(k, part(f"{'src' if k % 2 else 'web'}/f{k}.{'py' if k % 3 else 'js'}", f"+x = {k}", "") + "\n" + part("all.py", "+y")) for k in range(40)]
    path = f"file://{tmp_path}/in"
    patches.bundled(spark.createDataFrame(rows, "diff_id long, diff_content string").repartition(3), path)
    df = spark.read.format("patches").load(path)
    assert df.count() == 80 and df.rdd.getNumPartitions() == 3
    assert {(r.diff_id, r.diff_content + ("\n" if r.section == 1 else "")) for r in df.filter("section = 1").collect()} == {(str(k), t[: t.index("\ndiff --git a/all")] + "\n") for k, t in rows}
    for where, n in (("path = 'all.py'", 40), ("path LIKE 'src/%'", 20), ("path LIKE '%.js'", 14), ("path IN ('all.py', 'src/f1.py')", 41), ("path LIKE 'src/%' AND diff_id = '3'", 1), ("path IS NULL", 0)):
        found = df.filter(where)
        assert found.count() == n
    assert "Filter (" not in df.filter("path = 'all.py'")._jdf.queryExecution().executedPlan().toString()  # all of it is the reader's
    os.makedirs(tmp_path / "none")
    assert spark.read.format("patches").load(str(tmp_path / "none")).count() == 0


def test_sink(spark, tmp_path):
    patches.register(spark)
    path, schema = f"file://{tmp_path}/out", "a long, b string, c array<string>"
    rows = [(k, None if k % 5 == 0 else f"b{k}", ["x", None]) for k in range(50)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    assert patches.read_findings(spark, path, schema).count() == 0
    df.write.format("findings").mode("append").save(path)
    (tmp_path / "out" / "part-dead.parquet").write_bytes(b"of a task that failed")
    broken = df.withColumn("a", F.when(F.col("a") == 49, F.raise_error("late")).otherwise(F.col("a")).cast("long"))
    try:
        broken.write.format("findings").mode("append").save(path)
        raise AssertionError("it should fail")
    except Exception as e:
        assert "late" in str(e)
    read = lambda: sorted((r.a, r.b, r.c) for r in patches.read_findings(spark, path, schema).collect())
    assert read() == rows
    df.filter("a < 3").write.format("findings").mode("append").save(path)
    assert len(read()) == 53
    df.limit(0).write.format("findings").mode("append").save(path)
    df.filter("a < 3").write.format("findings").mode("overwrite").save(path)
    assert len(read()) == 3
