"""Queries of what goes along edges until nothing changes: chains of callers, definitions along control flow, dominators, sinks across calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import controlflow, dataflow, graph
from .queries import _EDGES, ORACLE_SQL, query
from .tables import customer_edges, event_definitions, seed, table


@query(f"""
WITH RECURSIVE {_EDGES}, r(id, hop) AS (SELECT src, 1 FROM edges WHERE dst = 7 UNION SELECT e.src, hop + 1 FROM r JOIN edges e ON e.dst = r.id WHERE hop < 3),
h AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1), via AS (
  SELECT h.id, h.hop, min(e.dst) AS via FROM h JOIN edges e ON e.src = h.id LEFT JOIN h p ON p.id = e.dst WHERE (h.hop = 1 AND e.dst = 7) OR p.hop = h.hop - 1 GROUP BY 1, 2),
c(id, hop, chain) AS (SELECT id, hop, [7, id] FROM via WHERE hop = 1 UNION ALL SELECT v.id, v.hop, list_append(chain, v.id) FROM c JOIN via v ON v.via = c.id AND v.hop = c.hop + 1)
SELECT id, CAST(hop AS INT) AS hop, array_to_string(chain, '>') AS chain FROM c""")
def caller_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The callers of a customer within three hops, each with a shortest chain to it."""
    found = graph.chains(customer_edges(spark, sf_dir), seed(spark, 7), 3)
    return found.select("id", "hop", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))


#: A function for each order: a block a line, in order, with a way back from the last to the first and one past each second line.
_FLOW = """d AS (SELECT DISTINCT l_orderkey AS function, l_linenumber AS block, l_linenumber AS id, l_returnflag AS variable FROM lineitem),
top AS (SELECT function, max(block) AS last FROM d GROUP BY 1),
steps AS (SELECT DISTINCT function, src, dst FROM (SELECT function, unnest(range(1, last)) AS src, src + 1 AS dst FROM top UNION ALL SELECT function, last, 1 FROM top WHERE last > 1
UNION ALL SELECT * FROM (SELECT function, unnest(range(2, last - 1, 2)) AS src, src + 2 AS dst FROM top WHERE last > 3)))"""


def _order_flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    made = lines.select(F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("block"), (F.col("l_linenumber") * 10 + F.ascii("l_returnflag") % 10).alias("id"), F.col("l_returnflag").alias("variable"))
    last = lines.groupBy(F.col("l_orderkey").alias("function")).agg(F.max("l_linenumber").alias("last"))
    n = F.col("last")
    pair = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
    ahead = F.transform(F.sequence(F.lit(1), n - 1), lambda i: pair(i, i + 1))
    past = F.when(n > 3, F.transform(F.sequence(F.lit(2), n - 2, F.lit(2)), lambda i: pair(i, i + 2))).otherwise(F.array().cast("array<struct<src:int,dst:int>>"))
    steps = last.filter("last > 1").withColumn("e", F.explode(F.concat(ahead, F.array(pair(n, F.lit(1))), past)))
    return made, steps.select("function", "e.*")


_REACH = f"""WITH RECURSIVE {_FLOW.replace("l_linenumber AS id", "l_linenumber * 10 + ascii(l_returnflag) % 10 AS id")},
gen AS (SELECT function, block, max(id) AS id, variable FROM d GROUP BY function, block, variable),
out(function, block, id, variable) AS (SELECT function, block, id, variable FROM gen UNION
  SELECT o.function, s.dst, o.id, o.variable FROM out o JOIN steps s ON s.function = o.function AND s.src = o.block
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.function = o.function AND d.block = s.dst AND d.variable = o.variable))"""


@query(f"{_REACH} SELECT DISTINCT o.function, CAST(s.dst AS INT) AS block, CAST(o.id AS INT) AS id FROM out o JOIN steps s ON s.function = o.function AND s.src = o.block")
def reaching_along_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions that reach the beginning of each block, along control flow with cycles."""
    return controlflow.reaching_along(*_order_flow(spark, sf_dir))[0]


@query(f"{_REACH} SELECT function, CAST(block AS INT) AS block, CAST(id AS INT) AS id FROM out")
def leaving_along_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.reaching_along(*_order_flow(spark, sf_dir))[1]


#: A function for each nation: its customers are blocks in a tree, with ways across and back.
_TREE = """b AS (SELECT c_nationkey AS function, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS block FROM customer),
top AS (SELECT function, max(block) AS last FROM b GROUP BY 1),
steps AS (SELECT DISTINCT * FROM (SELECT function, block // 2 AS src, block AS dst FROM b WHERE block > 1 UNION ALL SELECT function, block, block + 1 FROM b JOIN top USING (function)
WHERE block % 3 = 0 AND block < last UNION ALL SELECT function, block, block // 4 + 1 FROM b WHERE block % 5 = 0))"""
_DOMINATES = f"""WITH RECURSIVE {_TREE}, start AS (SELECT function, 1 AS block FROM top),
free(function, gone, block) AS (SELECT b.function, b.block, s.block FROM b JOIN start s ON s.function = b.function WHERE b.block <> s.block UNION
  SELECT f.function, f.gone, s.dst FROM free f JOIN steps s ON s.function = f.function AND s.src = f.block WHERE s.dst <> f.gone),
dom AS (SELECT x.function, x.block, y.block AS dominator FROM b x JOIN b y ON x.function = y.function WHERE x.block = y.block OR NOT EXISTS
  (SELECT 1 FROM free f WHERE f.function = x.function AND f.gone = y.block AND f.block = x.block)),
depth AS (SELECT function, block, count(*) AS n FROM dom GROUP BY 1, 2)"""


def _nation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    blocks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("function"), F.row_number().over(own).cast("long").alias("block"))
    top = blocks.groupBy("function").agg(F.max("block").alias("last"))
    block = F.col("block")
    step = lambda src, dst, where: F.when(where, F.struct(src.cast("long").alias("src"), dst.cast("long").alias("dst")))
    ways = F.array(step(F.floor(block / 2), block, block > 1), step(block, block + 1, (block % 3 == 0) & (block < F.col("last"))), step(block, F.floor(block / 4) + 1, block % 5 == 0))
    return blocks.join(top, "function").withColumn("e", F.explode(F.filter(ways, lambda e: e.isNotNull()))).select("function", "e.*").distinct()


@query(f"{_DOMINATES} SELECT d.function, d.block, arg_max(d.dominator, n.n) AS idom FROM dom d JOIN depth n ON n.function = d.function AND n.block = d.dominator WHERE d.dominator <> d.block GROUP BY 1, 2")
def immediate_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block the nearest other one that every path from the entry goes through."""
    entries = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("function"), F.lit(1).cast("long").alias("block")).distinct()
    return controlflow.dominator_tree(_nation_flow(spark, sf_dir), entries).filter("idom IS NOT NULL")


_BACKWARD = _DOMINATES.replace("1 AS block FROM top", "last AS block FROM top").replace("f.gone, s.dst FROM free f JOIN steps s ON s.function = f.function AND s.src = f.block WHERE s.dst <> f.gone", "f.gone, s.src FROM free f JOIN steps s ON s.function = f.function AND s.dst = f.block WHERE s.src <> f.gone")
_LEADS = "met(function, block) AS (SELECT function, block FROM start UNION SELECT s.function, s.src FROM met m JOIN steps s ON s.function = m.function AND s.dst = m.block)"


@query(f"{_BACKWARD}, {_LEADS} SELECT function, block, dominator FROM dom SEMI JOIN met USING (function, block)")
def post_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block that leads to the last one all blocks that every path there goes through."""
    steps = _nation_flow(spark, sf_dir)
    last = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("function")).agg(F.count("*").alias("block"))
    return controlflow.dominators(steps, last, backward=True)


@query(f"""WITH RECURSIVE {_EDGES}, flows AS (SELECT DISTINCT "function", sink FROM ({ORACLE_SQL["taint_flows"]}) WHERE NOT sanitized),
r("function", sink, calls) AS (SELECT "function", sink, 0 FROM flows UNION SELECT e.src, sink, calls + 1 FROM r JOIN edges e ON e.dst = r."function" WHERE calls < 12)
SELECT "function", sink, CAST(min(calls) AS INT) AS calls FROM r GROUP BY 1, 2""")
def sinks_across_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sinks that each function's unsanitized input reaches, itself or through what it calls."""
    return dataflow.sinks_across_calls(dataflow.taint_flows(event_definitions(spark, sf_dir)), customer_edges(spark, sf_dir))
