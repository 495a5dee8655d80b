"""Unified diffs to tables: files, added lines, hunks, changed functions, the category of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import DEFINED, LANGUAGES

HUNK = r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@ ?(.*)$"


def guess_language(path: Column) -> Column:
    """The language of the first suffix that a path has, in the table's order; ``unknown`` without one."""
    out = F.lit("unknown")
    for suffix, language in reversed(LANGUAGES.items()):
        out = F.when(path.endswith(suffix), language).otherwise(out)
    return out


def diff_lines(diffs: DataFrame, text: str = "diff_content") -> DataFrame:
    """diff_id, language, pos, line and section (``diff --git`` lines so far) of every line of every diff.

    The running section is over the lines of one diff, which are in one row to begin with.
    """
    lines = diffs.select("diff_id", "language", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    so_far = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.count_if(F.col("line").startswith("diff --git ")).over(so_far))


def _sections(diffs: DataFrame) -> DataFrame:
    """Lines with the path of their whole section; sections without a ``+++ b/`` line are left out."""
    lines = diff_lines(diffs)
    section = Window.partitionBy("diff_id", "section")
    path = F.max_by(F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 1 << 30)), F.when(F.col("line").startswith("+++ b/"), F.col("pos"))).over(section)
    return lines.withColumn("path", path).filter("path IS NOT NULL")


def _marked(sign: str) -> Column:
    return F.col("line").startswith(sign) & ~F.col("line").startswith(sign * 3)


def files(diffs: DataFrame) -> DataFrame:
    """diff_id, section, path, language, added_lines, removed_lines of each file of each diff (diff_id, diff_content, language).

    A diff may have a path in more than one section, each of which is a file here. A file exists once its section has a ``+++ b/`` line. A diff's own language, where not empty, overrides the guess. Files that only remove keep
    an empty added list.
    """
    own = F.nullif(F.first("language"), F.lit(""))
    texts = lambda which: F.transform(F.sort_array(F.collect_list(F.when(which, F.struct("pos", F.substring("line", 2, 1 << 30).alias("t"))))), lambda s: s["t"])
    grouped = _sections(diffs).groupBy("diff_id", "section", "path")
    return grouped.agg(own.alias("own"), texts(_marked("+")).alias("added_lines"), texts(_marked("-")).alias("removed_lines")).select(
        "diff_id", "section", "path", F.coalesce("own", guess_language(F.col("path"))).alias("language"), "added_lines", "removed_lines"
    )


def added_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, section, path, language, line_start (ordinal among the file's added lines), file_line (by hunk headers, null before any) and line."""
    rows = _sections(diffs)
    order = Window.partitionBy("diff_id", "section").orderBy("pos")
    start = F.regexp_extract("line", HUNK, 3)
    rows = rows.withColumn("hunk", F.last(F.when(start != "", F.struct("pos", start.cast("int").alias("start"))), ignorenulls=True).over(order))
    kept = F.col("line").startswith("+") | F.col("line").startswith(" ") | (F.col("line") == "")
    in_hunk = Window.partitionBy("diff_id", "section", "hunk.pos").orderBy("pos")
    rows = rows.withColumn("seen", F.count_if(kept).over(in_hunk)).filter(_marked("+"))
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), guess_language(F.col("path")))
    return rows.select("diff_id", "section", "path", language.alias("language"), F.row_number().over(order).alias("line_start"), (F.col("hunk.start") + F.col("seen") - 1).cast("int").alias("file_line"), F.substring("line", 2, 1 << 30).alias("line"))


def lines_of(files: DataFrame) -> DataFrame:
    """diff_id, section, path, language, line_start and line of the added lines of ``files``: as ``added_lines`` gives them, but for file_line."""
    rows = files.select("diff_id", "section", "path", "language", F.posexplode("added_lines").alias("pos", "line"))
    return rows.select("diff_id", "section", "path", "language", (F.col("pos") + 1).alias("line_start"), "line")


def hunks(lines: DataFrame) -> DataFrame:
    """The columns of ``lines`` (line, any more) with old_start, old_count, new_start, new_count and heading, for hunk headers; absent counts are 1."""
    part = lambda k: F.regexp_extract("line", HUNK, k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).try_cast("int"), F.lit(1))
    return lines.filter(F.col("line").rlike(HUNK)).select("*", number(1).alias("old_start"), number(2).alias("old_count"), number(3).alias("new_start"), number(4).alias("new_count"), part(5).alias("heading"))


def file_changes(diffs: DataFrame) -> DataFrame:
    """diff_id, path (of the ``a/`` side), module, change_type, additions, deletions and functions (first definition of each added line, repeats kept).

    Lines end at a newline, a carriage return before it is dropped.
    """
    lines = diff_lines(diffs).withColumn("line", F.regexp_replace("line", "\r$", "")).filter("section > 0")
    header = F.regexp_extract("line", r"^diff --git a/(.*?) b/", 1)
    kind = F.when(F.col("line").startswith("new file mode"), "Added").when(F.col("line").startswith("deleted file mode"), "Deleted").when(F.col("line").startswith("rename from"), "Renamed")
    name = F.when(_marked("+"), F.nullif(F.regexp_extract("line", DEFINED, 1), F.lit("")))
    out = lines.groupBy("diff_id", "section").agg(
        F.max(F.when(F.col("line").startswith("diff --git "), header)).alias("path"),
        F.coalesce(F.max_by(kind, F.when(kind.isNotNull(), F.col("pos"))), F.lit("Modified")).alias("change_type"),
        F.count_if(_marked("+")).alias("additions"),
        F.count_if(_marked("-")).alias("deletions"),
        F.transform(F.sort_array(F.collect_list(F.when(name.isNotNull(), F.struct("pos", name.alias("n"))))), lambda s: s["n"]).alias("functions"),
    )
    return out.select("diff_id", "path", F.split("path", "/")[0].alias("module"), "change_type", "additions", "deletions", "functions")


#: What the paths of documentation, configuration, dependencies and tests contain or end with.
DOC_ENDS, DOC_PARTS = (".md", ".rst"), ("docs/",)
CONFIG_PARTS = (".yml", ".yaml", ".toml", ".json", "Dockerfile", "Makefile")
DEPENDENCY_PARTS = ("Cargo.toml", "Cargo.lock", "package.json", "package-lock.json", "requirements.txt", "Pipfile", "go.mod", "go.sum")
TEST_PARTS = ("test", "spec", "__tests__")


def _has(path: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | path.contains(p)
    return out


def change_category(changes: DataFrame, key: str = "diff_id") -> DataFrame:
    """The category of each group of ``changes`` (key, path, change_type), by the first rule that holds, and its number of files."""
    path = F.col("path")
    doc = _has(path, DOC_PARTS)
    for end in DOC_ENDS:
        doc = doc | path.endswith(end)
    tests = changes.groupBy(key).agg(
        F.count("*").alias("n_files"), F.bool_and(doc).alias("docs"), F.bool_and(_has(path, CONFIG_PARTS)).alias("config"), F.bool_or(_has(path, DEPENDENCY_PARTS)).alias("deps"),
        F.bool_or(_has(path, TEST_PARTS)).alias("tests"), F.bool_or(F.col("change_type") == "Added").alias("added"),
    )
    category = (
        F.when(F.col("n_files") == 0, "Unknown").when(F.col("docs"), "Documentation").when(F.col("config"), "Configuration")
        .when(F.col("deps") & (F.col("n_files") <= 3), "DependencyUpdate").when(F.col("tests") & (F.col("n_files") == 1), "BugFix")
        .when(F.col("added"), "NewFeature").otherwise("Refactor")
    )
    return tests.select(key, category.alias("change_category"), "n_files")


def summary(diffs: DataFrame) -> DataFrame:
    """One row a diff: totals, sorted distinct functions and modules, and the category; a diff without files is Unknown."""
    changes = file_changes(diffs)
    totals = changes.groupBy("diff_id").agg(
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("functions")))).alias("functions"),
        F.array_sort(F.collect_set("module")).alias("modules"),
    )
    out = diffs.select("diff_id").join(totals, "diff_id", "left").join(change_category(changes), "diff_id", "left")
    return out.select("diff_id", F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), "functions", "modules", F.coalesce("change_category", F.lit("Unknown")).alias("change_category"), F.coalesce("n_files", F.lit(0)).alias("n_files"))
