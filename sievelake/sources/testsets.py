"""Evaluation test sets in JSON: labels and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ground_truth array<struct<file:string,line:int,category:string,severity:string>>, samples array<struct<diff:string,code:string,language:string>>"


def parts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truths (file, line, category, severity, gt_seq) and samples (sample_id, diff_content, language) of parsed ``documents``, and their other columns."""
    others = [c for c in documents.columns if c not in ("ground_truth", "samples")]
    truths = documents.select(*others, F.posexplode("ground_truth").alias("gt_seq", "t")).select(*others, "t.*", "gt_seq")
    samples = documents.select(*others, F.posexplode("samples").alias("sample_id", "s"))
    text = F.coalesce("s.diff", "s.code", F.lit(""))
    return truths, samples.select(*others, "sample_id", text.alias("diff_content"), F.coalesce("s.language", F.lit("")).alias("language"))


def parse(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """As ``parts``, of a table with the JSON text of a test set in each row; broken JSON fails."""
    parsed = texts.withColumn("_set", F.from_json(column, SCHEMA, {"mode": "FAILFAST"}))
    return parts(parsed.select(*[c for c in texts.columns if c != column], "_set.*"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As ``parts``, of the one document at ``path``; broken JSON fails."""
    return parts(spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path, multiLine=True))


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Each file of a folder as one diff: diff_id (its path), diff_content, language (none)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("diff_content"), F.lit("").alias("language"))
