"""Evaluation of predictions against labels: greedy one-to-one matching, precision and recall, adoption."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR = 3  # lines between a prediction and the truth that it may match


ROWS = 20_000  # about as many rows meet in a task's call


def _first_near(open_at: dict[int, deque], line: int) -> tuple[int, int] | None:
    """Takes the first unused truth within NEAR lines; ``open_at`` has the unused ones, (place, seq), by line and in order."""
    near = [open_at[n] for n in range(line - NEAR, line + NEAR + 1) if open_at.get(n)]
    return min(near, key=lambda places: places[0]).popleft() if near else None


def _bucket(_: tuple, truths: pd.DataFrame, predictions: pd.DataFrame) -> pd.DataFrame:
    """Of all groups of one bucket: each prediction, in order, takes the first unused truth within NEAR lines."""
    names = ["file", "category", "pred_seq", "gt_seq"]

    def columns(rows: pd.DataFrame, seq: str) -> zip:
        rows = rows.sort_values(seq, kind="stable")
        keys = (rows[c].astype(object).where(rows[c].notna(), None) for c in ("file", "category"))
        return zip(*keys, rows["line"].tolist(), rows[seq].tolist(), strict=True)

    asked = {(f, c) for f, c, *_ in columns(predictions, "pred_seq")}
    open_of: dict[tuple, dict[int, deque]] = {}
    for place, (file, category, line, seq) in enumerate(columns(truths, "gt_seq")):
        if (file, category) in asked:
            open_of.setdefault((file, category), {}).setdefault(line, deque()).append((place, seq))
    out = []
    for file, category, line, seq in columns(predictions, "pred_seq"):
        if (file, category) in open_of and (at := _first_near(open_of[file, category], line)) is not None:
            out.append((file, category, seq, at[1]))
    return pd.DataFrame(out, columns=names)


def greedy_match(truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """file, category, pred_seq and gt_seq of the matches between ``truths`` (file, category, line, gt_seq) and ``predictions`` (..., pred_seq).

    Order decides, so both sides carry it. Matches stay within one file and category, each of which is one group; null lines are 0. A prediction looks at
    the unused truths of seven lines, so a group costs its rows, not their square.
    """
    side = lambda df, seq: df.select("file", "category", F.coalesce(F.col("line").cast("long"), F.lit(0)).alias("line"), F.col(seq).cast("long").alias(seq))
    kind = f"file {dict(truths.dtypes)['file']}, category {dict(truths.dtypes)['category']}, pred_seq long, gt_seq long"
    buckets = max(truths.count(), predictions.count()) // ROWS + 1
    place = F.pmod(F.xxhash64("file", "category"), F.lit(buckets)).alias("bucket")
    a, b = (side(df, seq).withColumn("bucket", place).groupBy("bucket") for df, seq in ((truths, "gt_seq"), (predictions, "pred_seq")))
    return a.cogroup(b).applyInPandas(_bucket, kind)


def rates(counts: DataFrame) -> DataFrame:
    """Adds recall, precision, f1 and false_positive_rate (of the predictions) to tp, fp and fn, rounded to 4 digits; no division by 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    recall, precision = tp / F.greatest(tp + fn, F.lit(1)), tp / F.greatest(tp + fp, F.lit(1))
    f1 = 2 * recall * precision / F.greatest(recall + precision, F.lit(0.001))
    fpr = fp / F.greatest(fp + tp, F.lit(1))
    return counts.select("*", *[F.round(c, 4).alias(n) for c, n in ((recall, "recall"), (precision, "precision"), (f1, "f1_score"), (fpr, "false_positive_rate"))])


def metrics(truths: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """One row over everything, with total_samples = tp + fn."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(matches, "tp").join(n(truths, "truths")).join(n(predictions, "predictions"))  # three single rows
    counts = counts.select("tp", (F.col("predictions") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn"), F.col("truths").alias("total_samples"))
    return rates(counts)


def by_category(truths: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """category, recall, precision and count for each category of the truths."""
    n = lambda df, name: df.groupBy("category").agg(F.count("*").alias(name))
    out = n(truths, "count").join(n(predictions, "predictions"), "category", "left").join(n(matches, "tp"), "category", "left").fillna(0, ["predictions", "tp"])
    out = rates(out.select("category", "count", "tp", (F.col("predictions") - F.col("tp")).alias("fp"), (F.col("count") - F.col("tp")).alias("fn")))
    return out.select("category", "recall", "precision", "count")


def adoption(feedback: DataFrame) -> DataFrame:
    """adoption_rate = useful of all rows (0 of none), and the three counts of ``feedback`` (feedback)."""
    n = lambda v: F.count_if(F.col("feedback") == v)
    out = feedback.agg(F.count("*").alias("total"), n("useful").alias("useful"), n("not_useful").alias("not_useful"), n("duplicate").alias("duplicate"))
    return out.select(F.round(F.coalesce(F.try_divide(F.col("useful").cast("double"), F.col("total")), F.lit(0.0)), 4).alias("adoption_rate"), "total", "useful", "not_useful", "duplicate")
