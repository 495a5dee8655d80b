"""Filter interaction audit: what each of five filters removes in every order in which they can run.

A document's failures are a mask of five bits, so all orders and steps follow from how many documents of a part have which mask; the documents are
read once. A to D are functions of the text. E (a copy of an earlier document) comes from a sort: rows are dealt by range of text fingerprint and doc_id,
sorted by fingerprint, whole text and doc_id, and each is compared with its predecessor. Copies that go on over a boundary between ranges are
told by one fingerprint a boundary, and by the digest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_Z, written

FILTERS = "ABCDE"
MARKS = "#$%&*|"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
COPY = 1 << FILTERS.index("E")
ORDERS = tuple("".join(p) for p in permutations(FILTERS))


def own_failures(text: Column) -> Column:
    """The bits of A to D for a text without nulls: few words, few distinct words, many capitals, marks. A text without words fails A alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = F.transform(F.array(words), lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w), 2).otherwise(0))[0]
    capitals = F.length(text) - F.length(F.translate(text, A_Z, ""))
    shouting = F.when(100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"), 4).otherwise(0)
    marked = F.when(F.length(F.translate(text, MARKS, "")) < F.length(text), 8).otherwise(0)
    return few + shouting + marked


def _first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted rows, ``first``: the doc_id of the first row with this text in a row. Nulls, which come first, count as one id below all."""
    before_fp = before = first = None
    for batch in batches:
        out = []
        for fp, text, doc_id in zip(batch.column("fp").to_pylist(), batch.column("text"), batch.column("doc_id").to_pylist(), strict=True):
            text = text.as_buffer()
            if fp != before_fp or text != before:
                before_fp, before, first = fp, text, doc_id
            out.append(first)
        # a slice of the last text alone: the batch that it stands in is not kept
        before = pa.py_buffer(before.to_pybytes()) if before is not None else None
        rest = [batch.column(c) for c in ("fp", "digest", "doc_id", "part", "mask")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.int64())], names=["fp", "digest", "doc_id", "part", "mask", "first"])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row of ``docs`` (doc_id, text, lang).

    E is failed by a row whose text, byte for byte, some row of a smaller doc_id has; a null doc_id is below all others. Equal rows fail it together or
    not at all. A null text is empty; a null lang and an empty one are one part. One shuffle of the texts; a group of copies, however large, is
    spread over the ranges.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    # what the texts fail and their digests are made after the shuffle: the ranges are found by a pass of its own, which makes all that stands before
    rows = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    rows = rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text")).alias("mask"))
    judged = rows.mapInArrow(_first_of_run, "fp long, digest binary, doc_id long, part string, mask int, first long")
    judged = written(judged.withColumn("range", F.spark_partition_id()), "audit-rows")
    # a fingerprint on both sides of a boundary is the greatest of one range: at most one a range
    ends = judged.groupBy("range").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    over = ends.select(F.col("high").alias("fp")).join(ends.select(F.col("low").alias("fp")).distinct(), "fp", "left_semi").distinct()
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id").alias("id"))
    firsts = judged.join(F.broadcast(over), "fp").groupBy("fp", "digest").agg(F.min(order)["id"].alias("global_first"), F.lit(True).alias("spread"))
    told = judged.join(F.broadcast(firsts), ["fp", "digest"], "left")  # a row a boundary, and text of one fingerprint
    first = F.when(F.col("spread"), F.col("global_first")).otherwise(F.col("first"))
    copy = F.col("doc_id").isNotNull() & (first.isNull() | (first < F.col("doc_id")))
    return told.select("doc_id", "part", (F.col("mask") + F.when(copy, COPY).otherwise(0)).alias("mask"))


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, zeros included, from ``masks`` (doc_id, part, mask) and ``labels`` (doc_id, quality, toxic).

    Counts add up: those of two tables' masks may be summed. A document is good or toxic if any of its labels says so; a null doc_id has no label. Copies of
    a document count each. No rows give no parts.
    """
    said = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    counted = masks.join(said, "doc_id", "left").fillna(0, ["good", "bad"]).groupBy("part", "mask", "good", "bad").agg(F.count("*").alias("n"))
    counters = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "bad", "n")).alias("counters"))  # 128 at most
    each = counters.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(ORDERS)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.pow(F.lit(2), F.instr(F.lit(FILTERS), c) - 1).cast("int"))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    each = each.withColumn("bits", bits).select("*", F.get("bits", F.col("step") - 1).alias("bit"), before.alias("before"))

    def total(where, weight=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("counters", where), F.lit(0).cast("long"), lambda a, c: a + weight(c))

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) > 0
    earlier = lambda c: c["mask"].bitwiseAND(F.col("before")) > 0
    removed = lambda c: fails(c) & ~earlier(c)
    # of a document's k failed filters, each stands first in len(ORDERS) / k orders
    share = lambda c: c["n"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(c["mask"]))
    return each.select(
        "part", "filter_order", "step", total(lambda c: ~fails(c) & ~earlier(c)).alias("kept"), total(removed).alias("removed"),
        total(lambda c: fails(c) & earlier(c)).alias("redundant"), total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: removed(c) & (c["good"] == 1)).alias("good_lost"), total(lambda c: removed(c) & (c["bad"] == 1)).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )
