from sievelake.sources import diffs

TWO = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +5,3 @@ def f\n a\n+one\n+two\n-gone\ndiff --git a/lib/y.jsx b/lib/y.jsx\nnew file mode 100644\n+++ b/lib/y.jsx\n@@ -3 +4 @@\n+def three(x):\r\n+++i\n--- x"
GONE = "diff --git a/z.go b/z.go\ndeleted file mode 100644\n--- a/z.go\n+++ /dev/null\n-x"


def table(spark, *texts, language=None):
    return spark.createDataFrame([(k, t, language) for k, t in enumerate(texts)], "diff_id long, diff_content string, language string")


def test_files(spark):
    got = {(r.diff_id, r.path): (r.language, r.added_lines, r.removed_lines) for r in diffs.files(table(spark, TWO, GONE, "raw source", "", None)).collect()}
    assert got == {(0, "x.py"): ("python", ["one", "two"], ["gone"]), (0, "lib/y.jsx"): ("unknown", ["def three(x):\r"], [])}


def test_headerless_sections_merge_and_language_overrides(spark):
    (r,) = diffs.files(table(spark, "+++ b/a.py\n+1\n+++ b/b.rs\n+2", language="go")).collect()
    assert (r.path, r.language, r.added_lines) == ("b.rs", "go", ["1", "2"])


def test_added_lines_have_ordinals_and_file_lines(spark):
    got = [(r.path, r.line_start, r.file_line, r.line) for r in diffs.added_lines(table(spark, TWO)).orderBy("path", "line_start").collect()]
    assert got == [("lib/y.jsx", 1, 4, "def three(x):\r"), ("x.py", 1, 6, "one"), ("x.py", 2, 7, "two")]


def test_hunks(spark):
    (r,) = diffs.hunks(spark.createDataFrame([("@@ -3 +4 @@",), ("@ no",)], "line string")).collect()
    assert (r.old_start, r.old_count, r.new_start, r.new_count, r.heading) == (3, 1, 4, 1, "")


def test_changes_and_summary(spark):
    got = {r.path: (r.module, r.change_type, r.additions, r.deletions, r.functions) for r in diffs.file_changes(table(spark, TWO, GONE)).collect()}
    assert got == {"x.py": ("x.py", "Modified", 2, 1, []), "lib/y.jsx": ("lib", "Added", 1, 0, ["three"]), "z.go": ("z.go", "Deleted", 0, 1, [])}
    s = {r.diff_id: r for r in diffs.summary(table(spark, TWO, "")).collect()}
    assert (s[0].additions, s[0].functions, s[0].change_category, s[0].n_files) == (3, ["three"], "NewFeature", 2) and s[1].change_category == "Unknown"


def test_change_category(spark):
    groups = {"d": ["a.md", "docs/x"], "c": ["package.json"], "p": ["go.mod", "a.go"], "b": ["test_a.py"], "n": ["a.py"], "r": ["b.py"]}
    rows = [(k, p, "Added" if k == "n" else "Modified") for k, ps in groups.items() for p in ps]
    got = {r.diff_id: r.change_category for r in diffs.change_category(spark.createDataFrame(rows, "diff_id string, path string, change_type string")).collect()}
    assert got == {"d": "Documentation", "c": "Configuration", "p": "DependencyUpdate", "b": "BugFix", "n": "NewFeature", "r": "Refactor"}
