"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sources share the total by weight; one whose share exceeds ``max_epochs`` times its size is clamped there and the excess is
shared again among the others. With the sources ordered by cap over weight, the clamped ones are a prefix, so one running sum
over the sources (one row each) finds the level that the repeated clamping would reach.

Each document is then taken floor(epochs) times whole, and once more if it comes early enough in its source's seeded order: the
documents whose running size stays within the fraction left, the one at the border in part. The order is that of a hash, whose
first digits make 4096 buckets: bucket sums find each source's border bucket, and only rows of that bucket meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

DIGITS = 3  # hexadecimal digits of a bucket


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sizes`` (source, source_size, weight) with ``target``.

    The targets sum to the sum of all sizes. Weights must be positive. A source of size 0 has target 0. No rows: no rows.
    One row a source, so the running sums stand in one small task.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    # cap / weight orders the sources; a source stays below its cap when the level of those from it on does
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sizes.withColumn("cap", cap)
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("clamped", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_size"))
    )
    free = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), "left_size", "left_weight"))).over(everything)
    level = level.withColumn("free", free)
    shared = (F.col("weight") * F.col("free.left_size")).cast("double") / F.col("free.left_weight")
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(shared)
    return level.select("source", "source_size", "weight", target.alias("target"))


def ranked_weights(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``sizes`` (source, source_size) with weights dealt in turn to the sources by code point, null last."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))


ADDED = ("source_size", "target", "copies", "part", "taken")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17, narrow: DataFrame | None = None) -> DataFrame:
    """Adds to ``sized`` (doc_id, source, size, any more) ``source_size``, ``target``, ``copies``, ``part`` and ``taken`` = copies * size + part words.

    A source's ``taken`` sum to its target rounded to a whole word; no document is taken beyond ceil(epochs) times. Reruns agree: the order within a
    source is by a hash of seed and doc_id, then doc_id, then size, then a hash of the other columns. Null doc_ids and null sources are ordinary
    values, repeated rows documents of their own. Columns of ``sized`` with the names of added ones are replaced, others keep their names
    whatever these are. Sums come from ``narrow``, the same rows without other columns, where it is given.

    Each row finds its place from one row of its source; only rows of a source's border bucket are shuffled.
    """
    sized = sized.drop(*ADDED)
    names, own = sized.columns, ("doc_id", "source", "size")
    rows = sized.toDF(*(c if c in own else f"_other{k}" for k, c in enumerate(names)))
    shares = targets.select(F.col("source").alias("_source"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(0).cast("long")
    rest = (F.round("target").cast("long") - F.col("_whole") * F.col("source_size")).cast("long")
    shares = shares.withColumn("_whole", whole).withColumn("_rest", rest)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    keyed = lambda df: df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, DIGITS))
    few = (narrow or rows).select(*own)

    # the first bucket of each source that does not fit whole, and the words that it may give
    sums = keyed(few).groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).join(shares, F.col("source").eqNullSafe(F.col("_source")))
    room = F.col("_rest") - F.col("_before")
    first = F.min(F.when(room < F.col("_sum"), F.struct("_bucket", room.alias("room"))))
    plan = sums.groupBy("_source", "source_size", "target", "_whole").agg(first.alias("_border"))
    plan = F.broadcast(plan) if _few(targets) else plan

    def placed(df: DataFrame) -> DataFrame:
        return keyed(df).join(plan, F.col("source").eqNullSafe(F.col("_source")))

    at_border = F.coalesce(F.col("_bucket") == F.col("_border._bucket"), F.lit(False))
    inside = F.col("_border").isNull() | (F.col("_bucket") < F.col("_border._bucket"))
    most = placed(rows).filter(~at_border).withColumn("_extra", F.when(inside, F.col("size")).otherwise(0).cast("long"))
    # equal keys and sizes, say of null ids, are counted before their order is found
    group = ["source", "_key", "doc_id", "size"]
    groups = placed(few).filter(at_border).groupBy(*group).agg(F.count("*").alias("_n"), F.first("_border.room").alias("_room"))
    upto = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_left", F.col("_room") - F.coalesce(F.sum(F.col("_n") * F.col("size")).over(upto), F.lit(0)))
    groups = groups.select(*[F.col(c).alias(f"_of{c}") for c in group], "_left")
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in group]
    others = [c for c, kind in rows.dtypes if c not in own and "map<" not in kind]
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(0), *others)))
    border = placed(rows).filter(at_border).join(groups, same[0] & same[1] & same[2] & same[3])
    left = F.col("_left") - (turn - 1) * F.col("size")
    border = border.withColumn("_extra", F.greatest(F.least(left, F.col("size")), F.lit(0)).cast("long")).select(most.columns)

    out = most.unionByName(border)
    # a whole further repetition is a copy too
    again = (F.col("_extra") == F.col("size")) & (F.col("size") > 0)
    part = F.when(again, 0).otherwise(F.col("_extra")).cast("long")
    taken = (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long")
    copies = F.col("_whole") + again.cast("long")
    return out.select(*rows.columns, "source_size", "target", copies, part, taken).toDF(*names, *ADDED)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix: each of ``mixed`` (with text, copies and part) as often as it is copied, and its first ``part`` words once more.

    n_chars, where it is among the columns, follows the text.
    """
    part = F.col("part") > 0
    times = (F.col("copies") + part.cast("int")).cast("int")
    turns = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    each = mixed.withColumn("_turn", F.explode(turns))
    cut = F.col("_turn") > F.col("copies")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col("part").cast("int")), " ")
    each = each.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if "n_chars" in columns:
        each = each.withColumn("n_chars", F.when(cut, F.length("text").cast(dict(mixed.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return each.select(*columns)


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources is small enough to send to every executor."""
    return targets.limit(most + 1).count() <= most
