"""Whole reviews: from diffs to findings and review records, and from a test set to its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import SEVERITIES
from ..operators import evaluate, review, scan
from ..operators.rounds import kept
from ..sources import diffs, testsets


def review_findings(submitted: DataFrame, judge=None, only: tuple[str, ...] = (), disabled: tuple[str, ...] = (), files: DataFrame | None = None) -> DataFrame:
    """Findings of diffs (diff_id, diff_content, language) after the context filter, routing and fixes; ``files`` are those of the diffs where they are at hand.

    A diff is cut into files once: lines, file-scoped rules and code come from what was kept.
    """
    rules = scan.active_rules(only=only, disabled=disabled)
    files = kept(diffs.files(submitted)) if files is None else files
    found = scan.with_code(scan.context_filter(scan.findings(diffs.lines_of(files), files, rules)), files)
    return review.with_fixes(review.route(found, judge))


def review_records(submitted: DataFrame, found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One completed record a diff: counts by severity and files analysed, those without additions and diffs without findings included."""
    files = diffs.files(submitted) if files is None else files
    files = files.groupBy("diff_id").agg(F.count("*").alias("files_analyzed"))
    out = submitted.select("diff_id").join(review.severity_counts(found, "diff_id"), "diff_id", "left").join(files, "diff_id", "left")
    counts = ["total_issues", *[f"{s}_count" for s in SEVERITIES], "files_analyzed"]
    return out.fillna(0, counts).select("diff_id", F.lit("completed").alias("review_status"), *counts, F.lit(0).alias("llm_calls"))


def predictions(samples: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """file, category, line, diff_id, rule_id and pred_seq of what the rules (or ``only`` some) find in ``samples`` (diff_id, diff_content, language).

    pred_seq is the place within file and category, in the order of samples, then of rules, files and lines: matches never leave those, so no order over
    everything is needed.
    """
    files = kept(diffs.files(samples))
    found = scan.findings(diffs.lines_of(files), files, scan.active_rules(only=only))
    number = F.create_map(*[x for k, r in enumerate(scan.RULE_DICTS) for x in (F.lit(r["rule_id"]), F.lit(k))])
    order = Window.partitionBy("file_path", "category").orderBy("diff_id", F.element_at(number, F.col("rule_id")), "section", "line_start")
    return found.select(F.col("file_path").alias("file"), "category", F.col("line_start").alias("line"), "diff_id", "rule_id", F.row_number().over(order).cast("long").alias("pred_seq"))


def evaluate_samples(truths: DataFrame, samples: DataFrame, only: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Metrics and per-category metrics of the rules (or ``only`` some) on ``samples`` (diff_id, diff_content, language) against ``truths`` (file, category, line, gt_seq)."""
    found = kept(predictions(samples, only))
    matches = kept(evaluate.greedy_match(truths, found))
    return evaluate.metrics(truths, found, matches), evaluate.by_category(truths, found, matches)


def evaluate_testset(spark: SparkSession, path: str, only: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """As ``evaluate_samples``, of the test set at ``path``."""
    truths, samples = testsets.read(spark, path)
    return evaluate_samples(truths, samples.select(F.col("sample_id").alias("diff_id"), "diff_content", "language"), only)
