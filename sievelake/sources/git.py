"""What git prints, landed as text tables, to rows. Outputs (key columns, text); git itself runs where the repository is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lines(outputs: DataFrame, *keys: str) -> DataFrame:
    return outputs.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))


def changed_files(outputs: DataFrame, key: str = "diff_id") -> DataFrame:
    """key and path of each name that a name-only difference lists; empty lines are none."""
    return _lines(outputs, key).filter("line <> ''").select(key, F.col("line").alias("path"))


def blame(outputs: DataFrame, key: str = "file") -> DataFrame:
    """key, line, commit (8 digits), author and time of each line of porcelain blame output.

    A header opens a line's record and its text, led by a tab, ends it; a commit's author may be told at its first line only.
    """
    rows = _lines(outputs, key)
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    order = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("record", F.count_if(F.col("line").rlike(head)).over(order)).filter("record > 0")
    told = lambda prefix: F.max(F.when(F.col("line").startswith(prefix + " "), F.substring("line", len(prefix) + 2, 1 << 30)))
    of = lambda k: F.max(F.when(F.col("line").rlike(head), F.regexp_extract("line", head, k)))
    records = rows.groupBy(key, "record").agg(of(1).alias("sha"), of(2).cast("int").alias("line"), told("author").alias("author"), told("author-time").alias("time"))
    first = Window.partitionBy(key, "sha").orderBy("record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = lambda c: F.last(c, ignorenulls=True).over(first)
    return records.select(key, "line", F.left("sha", F.lit(8)).alias("commit"), F.coalesce(whole("author"), F.lit("")).alias("author"), F.timestamp_seconds(whole("time").cast("long")).alias("time"))


def blame_lines(wanted: DataFrame, blamed: DataFrame) -> DataFrame:
    """The blame of the wanted (file, line); lines without one are left out."""
    return blamed.join(wanted.select("file", "line").distinct(), ["file", "line"], "left_semi")


def commits(outputs: DataFrame) -> DataFrame:
    """hash (8 digits), author, email, date and subject of each output, a line each; absent ones are empty, lines after them are not read."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    field = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    return outputs.select(F.left(field(0), F.lit(8)).alias("hash"), field(1).alias("author"), field(2).alias("email"), field(3).alias("date"), field(4).alias("subject"))


def history(outputs: DataFrame, key: str = "file", limit: int = 10) -> DataFrame:
    """key, pos, hash and message of the first ``limit`` lines of one-line logs."""
    part = F.split("line", " ", 2)
    rows = _lines(outputs, key).filter("line <> ''").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("n") <= limit)
    return rows.select(key, F.col("n").alias("pos"), part[0].alias("hash"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("message"))
