"""The library's operators need code tables; these views give them rows of the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: diff_id (doc_id), path (doc_id as text), source, language ``unknown``, line_start from 1, line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.select(F.col("doc_id").alias("diff_id"), F.col("doc_id").cast("string").alias("path"), "source", F.lit("unknown").alias("language"), (F.col("pos") + 1).alias("line_start"), "line")


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges between customers: each order links its customer to the one that its key falls on, modulo the number of customers."""
    customers = table(spark, sf_dir, "customer").agg(F.nullif(F.count("*"), F.lit(0)).alias("n"))
    orders = table(spark, sf_dir, "orders").crossJoin(F.broadcast(customers))
    return orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("n") + 1).alias("dst"), F.lit("calls").alias("kind")).distinct()


def seed(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("id"))


def order_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions: function is the order, variable its return flag, id the line number."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("function"), F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("id")).distinct()


def event_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions: function is the user, variable the event type, and the value a piece of code that the event type and number choose."""
    code = F.array(*[F.lit(v) for v in ("request.args", "os.environ", "cursor.execute(q)", "html.escape(x)", "sys.argv", "eval(x)", "print(x)")])
    events = table(spark, sf_dir, "events")
    value = F.element_at(code, (F.col("event_id") % 7 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 7 < 5, "UserInput").otherwise("FunctionCall")
    return events.select(F.col("user_id").alias("function"), F.col("event_type").alias("variable"), F.col("event_id").alias("id"), kind.alias("source_kind"), value.alias("source_value"))
