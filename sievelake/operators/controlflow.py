"""Which definitions reach a block along control flow, and which blocks stand on every path to it.

Functions are dealt to tasks, each of which solves many at once (``flowtasks``): one shuffle of the definitions and edges, no rounds. A function too large for
a task is spread over tasks, as a fixpoint on tables. There sets are bitmaps, 64 members a row (function, block, word, bits), so that a round is one join
along the edges and one bitwise aggregation with partial sums before the shuffle; rounds pass on what the round before changed alone, are kept, and end when
nothing changes: as many as the longest way that a fact has to go.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import flowtasks
from .rounds import kept

AT = ["function", "block", "word"]
BUCKETS = 1 << 16
STEPS = 1 << 21  # edges and entries of a function, at most, whose dominators one task finds
FACTS = 1 << 15  # definitions and edges of a function, at most, that one task follows


def _large(rows: DataFrame, most: int) -> DataFrame | None:
    """The functions with more than ``most`` rows, None if there are none. Functions are counted only where all of a bucket together have more."""
    bucketed = rows.select("function", F.pmod(F.xxhash64("function"), F.lit(BUCKETS)).alias("_bucket"))
    full = [r[0] for r in bucketed.groupBy("_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("_bucket").collect()]
    if not full:
        return None
    some = rows.sparkSession.createDataFrame([(b,) for b in full], "_bucket long")
    large = kept(bucketed.join(F.broadcast(some), "_bucket", "left_semi").groupBy("function").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("function"))
    return None if large.isEmpty() else large


def _together(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both as one table, null where one lacks a column. Spark 4.1.2 takes a union of tables that are dealt by function for dealt so itself, even where it has joined the partitions of
    each differently, so that a function's rows stay apart; an expression in place of the column is not taken for dealt."""
    hidden = F.greatest("function", "function")
    return one.withColumn("function", hidden).unionByName(other.withColumn("function", hidden), allowMissingColumns=True)


def _alike(rows: DataFrame) -> DataFrame:
    """``rows`` with block and to of one type, that which holds both."""
    kind = rows.select("block").union(rows.select("to")).schema["block"].dataType
    return rows.withColumns({name: F.col(name).cast(kind) for name in ("block", "to")})


def _dealt_out(rows: DataFrame) -> DataFrame:
    """Each function's rows in one partition. By a hash, as a join below a union (see ``_together``) lets the functions pass for dealt already."""
    return rows.repartition(F.xxhash64("function"))


def _solved(rows: DataFrame, order: list[str], solve, columns: dict[str, str]) -> DataFrame:
    """What ``solve`` finds in the rows of whole functions; ``columns``: its names, each with the column of ``rows`` whose type it has."""
    made = StructType([StructField(name, rows.schema[of].dataType) for name, of in columns.items()])
    return _dealt_out(rows).sortWithinPartitions(*order).mapInArrow(solve, made)


def _others(rows: DataFrame, large: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(large), "function", "left_anti")


def _those(rows: DataFrame, large: DataFrame) -> DataFrame:
    return _dealt_out(rows.join(F.broadcast(large), "function", "left_semi"))


def _dealt(rows: DataFrame, most: int, order: list[str], solve, columns: dict[str, str], in_rounds) -> DataFrame:
    """What ``solve`` finds, and what ``in_rounds`` makes of the rows of functions with more than ``most``."""
    large = _large(rows, most)
    if large is None:
        return _solved(rows, order, solve, columns)
    return _solved(_others(rows, large), order, solve, columns).unionByName(in_rounds(_those(rows, large)))


def _numbered(members: DataFrame, order: str) -> DataFrame:
    """``members`` with word and bit of their number within the function, by ``order``: numbers come from counts of ranges, not from one window a function."""
    ranged = kept(members.repartitionByRange("function", order).sortWithinPartitions("function", order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("function").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("function", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("function", "_part").orderBy(order)) - 1
    rows = ranged.withColumn("_place", place).join(counts, ["function", "_part"])
    number = F.col("_place") + F.col("_before")
    return rows.select(*members.columns, F.floor(number / 64).alias("word"), F.expr("shiftleft(1L, cast((_place + _before) % 64 AS int))").alias("bits"))


def _members(sets: DataFrame, numbered: DataFrame, name: str, *columns: str) -> DataFrame:
    """function, block and the ``columns`` of each member of each set."""
    named = numbered.select("function", "word", F.col("bits").alias("_bit"), *[F.col(c).alias(f"_{c}") for c in columns])
    # a word's row meets its 64 members at most
    both = sets.join(named, ["function", "word"]).filter(F.col("bits").bitwiseAND(F.col("_bit")) != 0)
    return both.select("function", "block", *[F.col(f"_{c}").alias(name if len(columns) == 1 else c) for c in columns])


def _or(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*AT).agg(F.bit_or("bits").alias("bits"))


def _without(bits: Column, gone: Column) -> Column:
    return bits.bitwiseAND(F.bitwise_not(F.coalesce(gone, F.lit(0).cast("long"))))


def reaching_along(definitions: DataFrame, edges: DataFrame, most: int = FACTS) -> tuple[DataFrame, DataFrame]:
    """What reaches the beginning and the end of each block: two tables (function, block, id).

    ``definitions`` has function, block, id (unique in its function) and variable, ``edges`` function, src and dst. A block's last definition of a variable, by id, goes
    out of it, and no other of that variable does: IN is all that goes out of the blocks before, OUT is GEN and what of IN the block does not define.
    Cycles, edges that repeat, and blocks that no entry reaches take part as they are; rows with a null in a key do not. Nothing reaches a
    block: no row. A function with more than ``most`` definitions and edges goes through rounds.
    """
    definitions = definitions.select("function", "block", "id", "variable").dropna()
    steps = edges.select("function", F.col("src").alias("block"), F.col("dst").alias("to")).dropna()
    rows = _alike(_together(steps, definitions)).select("function", "block", "to", "id", "variable")
    large = _large(rows, most)
    small = rows if large is None else _others(rows, large)
    found = tuple(_solved(small, ["function", "id"], partial(flowtasks.reached, after=after), {"function": "function", "block": "block", "id": "id"}) for after in (False, True))
    if large is None:
        return found
    spread = _reaching_in_rounds(*(_those(x, large).distinct() for x in (definitions, steps.withColumnRenamed("to", "dst"))))
    return tuple(a.unionByName(b) for a, b in zip(found, spread))


def _reaching_in_rounds(definitions: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    numbered = kept(_numbered(definitions, "id"))
    of_variable = numbered.groupBy("function", "variable", "word").agg(F.bit_or("bits").alias("bits"))
    kill = kept(_or(definitions.select("function", "block", "variable").distinct().join(of_variable, ["function", "variable"])))
    last = definitions.groupBy("function", "block", "variable").agg(F.max("id").alias("id"))
    gen = _or(numbered.join(last, ["function", "block", "variable", "id"], "left_semi"))
    killed = kill.withColumnRenamed("bits", "_kill")
    known, news = None, kept(gen)
    while True:
        came = _or(news.join(steps, ["function", "block"]).select("function", F.col("dst").alias("block"), "word", "bits"))
        if known is not None:
            came = came.join(known.withColumnRenamed("bits", "_known"), AT, "left").withColumn("bits", _without(F.col("bits"), F.col("_known"))).drop("_known").filter("bits <> 0")
        came = kept(came)
        if came.isEmpty():
            break
        known = came if known is None else kept(_or(_together(known, came)))
        news = came.join(killed, AT, "left").withColumn("bits", _without(F.col("bits"), F.col("_kill"))).drop("_kill").filter("bits <> 0")
    known = gen.limit(0) if known is None else known
    through = known.join(killed, AT, "left").withColumn("bits", _without(F.col("bits"), F.col("_kill"))).drop("_kill")
    return _members(known, numbered, "id", "id"), _members(_or(_together(through, gen)), numbered, "id", "id")


def _paths(edges: DataFrame, entries: DataFrame, backward: bool) -> DataFrame:
    """function, block, to: the edges in the order that they are followed; without block, to is an entry."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = edges.select("function", F.col(a).alias("block"), F.col(b).alias("to")).dropna()
    return _alike(_together(steps, entries.select("function", F.col("block").alias("to")).dropna()))


def dominators(edges: DataFrame, entries: DataFrame, backward: bool = False, most: int = STEPS) -> DataFrame:
    """function, block and dominator: the blocks on every path from the entry of a function (``entries``: function, block) to each block that it reaches.

    A block dominates itself. ``backward`` follows ``edges`` (function, src, dst) from dst to src: with exits for entries these are the post-dominators. A
    function may have several entries. The dominators of a block are those above it in the tree of nearest ones (``dominator_tree``), so no set of them is held.
    A function with more than ``most`` edges and entries goes through rounds.
    """
    paths = _paths(edges, entries, backward)
    return _dealt(paths, most, ["function"], flowtasks.all_dominators, {"function": "function", "block": "to", "dominator": "to"}, _dominators_in_rounds)


def dominator_tree(edges: DataFrame, entries: DataFrame, backward: bool = False, most: int = STEPS) -> DataFrame:
    """function, block and idom, its nearest other dominator, null for an entry: what ``immediate_dominators`` makes of ``dominators``, without the pairs."""
    paths = _paths(edges, entries, backward)
    spread = lambda large: immediate_dominators(_dominators_in_rounds(large))
    return _dealt(paths, most, ["function"], flowtasks.nearest_dominators, {"function": "function", "block": "to", "idom": "to"}, spread)


def _dominators_in_rounds(paths: DataFrame) -> DataFrame:
    """Sets only shrink: the entry's is itself, any other's is itself and what all blocks before it that have a set share."""
    paths = kept(paths.distinct())
    steps, entries = paths.dropna(), paths.filter("block IS NULL").select("function", F.col("to").alias("block"))
    blocks = steps.select("function", "block").unionByName(steps.select("function", F.col("to").alias("block"))).unionByName(entries).distinct()
    numbered = kept(_numbered(blocks, "block"))
    words = numbered.groupBy("function").agg(F.max("word").alias("_last"))
    own = numbered.withColumnRenamed("word", "_own").withColumnRenamed("bits", "_bit")
    whole = own.join(words, "function").withColumn("word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    self_ = kept(whole.select(*AT, F.when(F.col("word") == F.col("_own"), F.col("_bit")).otherwise(0).cast("long").alias("_self")))
    inner = kept(steps.join(entries.select("function", F.col("block").alias("to")), ["function", "to"], "left_anti"))  # nothing takes from an entry's set
    sets = kept(self_.join(entries, ["function", "block"], "left_semi").select(*AT, F.col("_self").alias("bits"), F.lit(True).alias("fresh")))
    while not (changed := sets.filter("fresh")).isEmpty():
        touched = inner.join(changed.select("function", "block").distinct(), ["function", "block"], "left_semi").select("function", "to").distinct()
        before = inner.join(touched, ["function", "to"], "left_semi").join(sets, ["function", "block"])
        shared = before.select("function", F.col("to").alias("block"), "word", "bits").groupBy(*AT).agg(F.bit_and("bits").alias("bits"))
        new = shared.join(self_, AT).select(*AT, F.col("bits").bitwiseOR(F.col("_self")).alias("_new"))
        news = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("bits"))
        sets = kept(sets.join(new, AT, "full").select(*AT, F.coalesce("_new", "bits").alias("bits"), news.alias("fresh")))
    return _members(sets.drop("fresh"), numbered, "dominator", "block")


def immediate_dominators(dominated: DataFrame) -> DataFrame:
    """function, block and idom, the nearest other dominator, null for an entry, of ``dominators``: of a chain the member with most dominators itself."""
    depth = dominated.groupBy("function", "block").agg(F.count("*").alias("_depth"))
    each = dominated.join(depth.select("function", F.col("block").alias("dominator"), "_depth"), ["function", "dominator"])
    other = F.col("dominator") != F.col("block")
    return each.groupBy("function", "block").agg(F.max_by(F.when(other, F.col("dominator")), F.when(other, F.col("_depth"))).alias("idom"))
