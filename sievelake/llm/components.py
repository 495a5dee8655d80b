"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _kept(df: DataFrame, spark_dir: str, k: int) -> DataFrame:
    path = f"{spark_dir}/{k}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, for every node of ``links`` (a, b).

    Each step joins the links with one row a node, minima gathered before the shuffle, so a hub is no group in memory; rounds grow with the
    logarithm of the nodes. Direction, repeats and loops of links don't matter; nulls link nothing; no links give no rows.
    """
    spark, folder = links.sparkSession, scratch(links.sparkSession, "components")
    one_way = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = _kept(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(one_way.alias("e")).select("e.*").distinct(), folder, 0)
    state, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = _kept(large, folder, k + 1)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = _kept(small.filter("a <> b").distinct(), folder, k + 2)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, k = now, k + 2
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
