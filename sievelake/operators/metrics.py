"""Period metrics and counts of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import kept

PERIODS = {"daily": "day", "weekly": "week", "monthly": "month"}


STEPS, ABOVE = 1_024, 2_000_000  # ranges to a factor of e; more than any number's own


def _range_of(value: Column) -> Column:
    """The number of the range that a value is in: greater for greater values, and as many for each factor of e on both sides of 0. NaN is above all."""
    size = F.floor(F.log(F.abs(value)) * STEPS) + ABOVE
    far = F.when(F.isnan(value), 3 * ABOVE).when(value == float("inf"), 2 * ABOVE).when(value == float("-inf"), -2 * ABOVE)
    return far.when(value == 0, 0).when(value > 0, size).otherwise(-size).cast("long")


def value_states(rows: DataFrame, at: str, value: str) -> DataFrame:
    """day, range and n: how many values of each range a day has. States of days, or of parts of one, add up; null values are left out.

    A state grows with the ranges that occur, not with the rows.
    """
    own = rows.select(F.to_date(at).alias("day"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    return own.groupBy("day", _range_of(F.col("_v")).alias("range")).agg(F.count("*").alias("n"))


def exact_percentiles(rows: DataFrame, at: str, value: str, period: str, shares: dict[str, float], states: DataFrame | None = None) -> DataFrame:
    """period_start and a column for each of ``shares`` (name to share): exact percentiles, interpolated between values, of the periods of ``rows``.

    The days' ``value_states``, made here unless at hand, are merged to the period and tell in which range each percentile lies; values of these ranges alone,
    counted by value, are then ordered. So a period's values are never in one place, and one that a third of all rows have is one row.
    """
    states = value_states(rows, at, value) if states is None else states
    start = lambda day: F.to_date(F.date_trunc(PERIODS[period], day)).alias("period_start")
    merged = states.groupBy(start(F.col("day")), "range").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("period_start")
    placed = merged.withColumn("total", F.sum("n").over(own)).withColumn("before", F.sum("n").over(own.orderBy("range")) - F.col("n"))
    ask = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("total") - 1)).alias("place")) for name, share in shares.items()])
    asked = placed.withColumn("a", F.explode(ask)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("a.place"), F.ceil("a.place")))))
    asked = kept(asked.filter("rank >= before AND rank < before + n").select("period_start", "range", "before", "a.name", "a.place", "rank"))
    wanted = asked.select("period_start", "range").distinct()
    values = rows.select(start(F.col(at)), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").withColumn("range", _range_of(F.col("v")))
    counted = values.join(wanted, ["period_start", "range"], "left_semi").groupBy("period_start", "range", "v").agg(F.count("*").alias("n"))
    counted = counted.withColumn("within", F.sum("n").over(Window.partitionBy("period_start", "range").orderBy("v")) - F.col("n"))
    met = asked.join(counted, ["period_start", "range"]).filter("rank >= before + within AND rank < before + within + n")
    weight = F.when(F.floor("place") == F.ceil("place"), 1.0).otherwise(1 - F.abs(F.col("place") - F.col("rank")))
    found = met.groupBy("period_start", "name").agg(F.sum(F.col("v") * weight).alias("v"))
    return found.groupBy("period_start").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])


BUFFER = 1_000_000  # times of one period that may stand in one task's memory


def period_metrics(reviews: DataFrame, period: str, buffer: int = BUFFER) -> DataFrame:
    """period, period_start, total_reviews, avg, p50 and p99 of review time for each period of ``reviews`` (created_at, analysis_time_ms).

    Percentiles interpolate between values; a period without times has none. They are the plain aggregate's while no period has more than ``buffer``
    rows, and those of ``exact_percentiles`` beyond.
    """
    start = F.to_date(F.date_trunc(PERIODS[period], "created_at"))
    time = F.col("analysis_time_ms").cast("double")
    grouped = reviews.groupBy(F.lit(period).alias("period"), start.alias("period_start"))
    most = grouped.agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    plain = F.count("*").alias("total_reviews"), F.avg(time).alias("avg_review_time_ms")
    if most <= buffer:
        return grouped.agg(*plain, F.percentile(time, 0.5).alias("p50_review_time_ms"), F.percentile(time, 0.99).alias("p99_review_time_ms"))
    exact = exact_percentiles(reviews, "created_at", "analysis_time_ms", period, {"p50_review_time_ms": 0.5, "p99_review_time_ms": 0.99}).withColumnRenamed("period_start", "_start")
    out = grouped.agg(*plain).join(exact, F.col("period_start").eqNullSafe(F.col("_start")), "left")
    return out.select("period", "period_start", "total_reviews", "avg_review_time_ms", "p50_review_time_ms", "p99_review_time_ms")


def period_rates(reviews: DataFrame, period: str) -> DataFrame:
    """period, period_start, total_reviews, total_findings, llm_calls and, in per cent, adoption_rate and auto_fix_pass_rate of ``reviews``.

    ``reviews`` has created_at, findings, llm_calls, adopted, fixes and fixes_passed; a rate of nothing is 0.
    """
    start = F.to_date(F.date_trunc(PERIODS[period], "created_at"))
    rate = lambda part, whole: F.round(F.coalesce(F.try_divide(F.sum(part) * 100.0, F.sum(whole)), F.lit(0.0)), 2)
    return reviews.groupBy(F.lit(period).alias("period"), start.alias("period_start")).agg(
        F.count("*").alias("total_reviews"), F.sum("findings").alias("total_findings"), F.sum("llm_calls").alias("llm_calls"),
        rate("adopted", "findings").alias("adoption_rate"), rate("fixes_passed", "fixes").alias("auto_fix_pass_rate"),
    )


def newest_metrics(metrics: DataFrame, period: str, n: int = 10) -> DataFrame:
    return metrics.filter(F.col("period") == period).orderBy(F.desc("period_start")).limit(n)


def funnel(found: DataFrame, stage: str = "filter_stage") -> DataFrame:
    return found.groupBy(stage).agg(F.count("*").alias("n"))


def rollup_report(found: DataFrame) -> DataFrame:
    """Counts by category and severity with subtotals; an addition of this library."""
    return found.rollup("category", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
