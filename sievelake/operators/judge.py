"""What surrounds a judge: its questions as text, and its answers, retries included, as columns. The judge itself is a function of the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAIT_S, TRIES = 0.5, 3
VERDICT = "is_issue boolean, confidence double, reasoning string"
FOCUS = {"security": "unsafe use of input, secrets and permissions", "performance": "needless work in loops and slow calls", "logic": "wrong conditions, bounds and states"}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def judgment_prompt() -> Column:
    """The question whether a finding (category, title, description, snippet, language) is a real issue."""
    return F.concat(
        F.lit("Is this a real issue in the code below, or a false alarm?\nCategory: "), _text("category"), F.lit("\nIssue: "), _text("title"), F.lit(" - "), _text("description"), F.lit("\nCode ("), _text("language"),
        F.lit("):\n```\n"), _text("snippet"), F.lit('\n```\nAnswer in JSON: {"is_issue": true or false, "confidence": 0.0 to 1.0, "reasoning": "..."}'),
    )


def fix_prompt() -> Column:
    """The request for the smallest change that mends a finding (title, category, severity, description, snippet, language)."""
    return F.concat(
        F.lit("Change the code below as little as possible so that this issue is gone.\nIssue: "), _text("title"), F.lit(" ("), _text("category"), F.lit(", "), _text("severity"), F.lit(")\n"), _text("description"),
        F.lit("\nCode ("), _text("language"), F.lit("):\n```\n"), _text("snippet"), F.lit('\n```\nAnswer in JSON: {"fix_code": "..."}'),
    )


def review_prompt(focus: dict[str, str] = FOCUS) -> Column:
    """The request to review code (category, snippet, language) with the focus of its category; a general one for other categories."""
    what = F.lit("correctness and clarity")
    for category, words in focus.items():
        what = F.when(F.col("category") == category, words).otherwise(what)
    return F.concat(F.lit("Review the code below for "), what, F.lit(".\nLanguage: "), _text("language"), F.lit("\n```\n"), _text("snippet"), F.lit("\n```"))


def fenced(answer: Column) -> Column:
    """The text within the first fence of an answer, one marked json before any other; without a fence the answer; trimmed."""
    after = lambda mark: F.get(F.split(answer, mark, -1), F.lit(1))
    inner = F.when(answer.contains("```json"), after("```json")).when(answer.contains("```"), after("```")).otherwise(answer)
    return F.regexp_replace(F.get(F.split(inner, "```", -1), F.lit(0)), r"^\s+|\s+$", "")


def verdict(answer: Column) -> Column:
    """is_issue, confidence and reasoning of an answer; null of one that is no JSON or says nothing of is_issue."""
    parsed = F.from_json(fenced(answer), VERDICT)
    return F.when(parsed["is_issue"].isNotNull(), parsed)


def retried(attempts: DataFrame, call: str, order: str, tries: int = TRIES) -> DataFrame:
    """call, tried, waited_s, failed and answer of each call of ``attempts`` (call, order, failed, answer): the first answer among its first ``tries``.

    Each failure but the last costs a wait that grows by half a second.
    """
    number = F.row_number().over(Window.partitionBy(call).orderBy(order))
    counted = attempts.withColumn("_n", number).filter(F.col("_n") <= tries)
    fine = F.when(~F.col("failed"), F.col("_n"))
    out = counted.groupBy(call).agg(F.min(fine).alias("_first"), F.max("_n").alias("_last"), F.min(F.when(~F.col("failed"), F.struct("_n", "answer"))).alias("_best"))
    tried = F.coalesce("_first", "_last")
    waits = tried - 1
    return out.select(call, tried.alias("tried"), (F.lit(WAIT_S) * waits * (waits + 1) / 2).alias("waited_s"), F.col("_first").isNull().alias("failed"), F.col("_best.answer").alias("answer"))
