"""Reviews: routing, fixes, severity counts, the tables' mutations as pure functions, and their reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import FIX_TEMPLATES, LOOP_HINT, SEVERITIES


def suggest_fix(rule_id: Column, category: Column, line: Column, snippet: Column, existing: Column) -> Column:
    """The rule's template, else existing fix code, else a rewrite by category; null where none applies."""
    template = F.lit(None).cast("string")
    for rule, code in reversed(FIX_TEMPLATES.items()):
        template = F.when(rule_id == rule, F.lit(code)).otherwise(template)
    text = F.coalesce(line, F.lit(""))
    secure = (
        F.when(F.lower(text).contains("execute"), F.replace(F.replace(text, F.lit("+"), F.lit(", ")), F.lit('f"'), F.lit('"')))
        .when(text.contains("innerHTML"), F.replace(text, F.lit("innerHTML"), F.lit("textContent")))
        .when(text.contains("os.system"), F.replace(text, F.lit("os.system("), F.lit("subprocess.run([")))
    )
    loop = F.when(text.contains("+=") & F.coalesce(snippet, F.lit("")).contains("for "), F.lit(LOOP_HINT))
    return F.coalesce(template, F.nullif(existing, F.lit("")), F.when(category == "security", secure).when(category == "performance", loop))


def with_fixes(found: DataFrame, existing: str | None = None) -> DataFrame:
    """Adds ``auto_fix_code`` to findings that are critical or major; null for the others."""
    old = F.col(existing) if existing else F.lit(None).cast("string")
    fix = suggest_fix(F.col("rule_id"), F.col("category"), F.col("line_content"), F.col("snippet"), old)
    return found.withColumn("auto_fix_code", F.when(F.col("severity").isin("critical", "major"), fix))


def route(found: DataFrame, judge=None) -> DataFrame:
    """Deterministic findings stay; of the others those stay that ``judge`` (DataFrame to DataFrame with is_issue) confirms; without a judge none is asked."""
    sure = found.filter("is_deterministic")
    if judge is None:
        return sure
    asked = judge(found.filter("NOT is_deterministic")).filter("is_issue")
    return sure.unionByName(asked.select(*found.columns))


def severity_counts(found: DataFrame, key: str) -> DataFrame:
    """total_issues and one count a severity for each key."""
    return found.groupBy(key).agg(F.count("*").alias("total_issues"), *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES])


def severity_share(found: DataFrame) -> DataFrame:
    """Each severity's count and per cent of all; a severity without findings is there with 0."""
    total = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"))
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])).alias("r"), "total")
    return rows.select("r.severity", "r.n", F.coalesce(F.try_divide(F.col("r.n") * 100.0, F.col("total")), F.lit(0.0)).alias("share"))


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key is in neither ``old`` nor an earlier new row."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def latest(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key: the state after all updates."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def finding_rows(found: DataFrame, review_id: Column) -> DataFrame:
    """Findings as rows of the findings table, defaults filled."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in found.columns else F.lit("")
    return found.select(
        review_id.alias("review_id"), text("rule_id").alias("rule_id"), text("category").alias("category"), F.coalesce("severity", F.lit("minor")).alias("severity"), text("title").alias("title"),
        text("description").alias("description"), text("file_path").alias("file_path"), F.coalesce("line_start", F.lit(0)).alias("line_start"), F.lit(0).alias("line_end"),
        F.coalesce(text("auto_fix_code"), F.lit("")).alias("suggestion"), text("auto_fix_code").alias("auto_fix_code"), F.coalesce("llm_confidence", F.lit(0.0)).alias("llm_confidence"), text("filter_stage").alias("filter_stage"),
    )


def toggled(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules with is_enabled of ``overrides`` (rule_id, enabled; one row a rule) where there is one."""
    o = overrides.select(F.col("rule_id").alias("_rule"), F.col("enabled").alias("_enabled"))
    joined = rules.join(o, rules["rule_id"] == o["_rule"], "left")
    return joined.withColumn("is_enabled", F.coalesce("_enabled", "is_enabled")).select(*rules.columns)


def list_rules(rules: DataFrame, enabled: bool | None = None, category: str | None = None, language: str | None = None) -> DataFrame:
    """By category, severity (as text) and id; a language also finds the rules for all."""
    for condition in (
        None if enabled is None else F.col("is_enabled") == enabled,
        None if not category else F.col("category") == category,
        None if not language else F.col("language").isin(language, "all"),
    ):
        rules = rules if condition is None else rules.filter(condition)
    return rules.orderBy("category", "severity", "rule_id")


def list_reviews(reviews: DataFrame, limit: int = 20, **equal) -> DataFrame:
    """The newest reviews, ties by id, of those that equal the given values; limit within 1 to 100."""
    for column, value in equal.items():
        reviews = reviews if value is None else reviews.filter(F.col(column) == value)
    return reviews.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(100, limit)))


def get_review(reviews: DataFrame, found: DataFrame, review_id) -> DataFrame:
    """One review with its findings as an array; no row if there is no such review."""
    own = found.filter(F.col("review_id") == review_id).groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in found.columns if c != "review_id"]))).alias("findings"))
    one = reviews.filter(F.col("id") == review_id)
    return one.join(own, one["id"] == own["review_id"], "left").drop("review_id")


def apply_fix(lines: Column, start: Column, end: Column, fix: Column) -> Column:
    """An array of lines with those from start to end (counted from 1) replaced by one."""
    return F.concat(F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0))), F.array(fix), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0))))


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi")
