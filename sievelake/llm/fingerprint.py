"""Threshold-scaled document sketches, with DataFrame functions only.

A fingerprint holds the hash of every shingle of five words (A-Z lower-cased) that falls below 1/SCALE of the hash range, so a document's sketch
grows with it, sketches of one SCALE merge by union, and containment can be estimated between a short and a long document. Where no
shingle falls below, the least hash alone stands for the text, so that no text with a word has an empty fingerprint; it counts only against sketches
that have none below either, or as a member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

WIDTH, SCALE = 5, 4
LIMIT = -(2**63) + 2**64 // SCALE  # signed hashes below this are kept


def sketch(text: Column) -> Column:
    """Sorted kept hashes (array of long) of a text; of the whole word sequence where it has fewer than five words; null text: none."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(words), sketch_of_words)[0]


def sketch_of_words(words: Column) -> Column:
    last = F.greatest(F.size(words) - (WIDTH - 1), F.lit(1))
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WIDTH)))
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < LIMIT)))
    whole = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.array_min(hashes)))
    return F.when(F.size(words) > 0, whole).otherwise(F.array().cast("array<long>"))


def as_text(kept: Column) -> Column:
    """A sketch as hexadecimal text, 16 digits a hash, in order."""
    return F.concat_ws("", F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; 1 of an empty sketch in an empty one, else 0 of it."""
    return F.when(F.size(a) > 0, _shared(a, b) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for two empty ones."""
    both = _shared(a, b)
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together: the union, without a lone least hash where the other has hashes below the limit."""
    union = F.array_sort(F.array_union(a, b))
    below = F.filter(union, lambda h: h < LIMIT)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(union, 1, 1))


def neighbours(keys: DataFrame) -> DataFrame:
    """For ``keys`` (id, h, n_chars), the next row in descending order (id, then h; after the last the first) and the one before.

    Returns id, h, n (rows of that key), next_id, next_h, and prev_chars of the last row before this key. Rows are range-partitioned and numbered
    inside their partitions; only the ends of partitions, one row each, meet in a window of their own.
    """
    grouped = keys.groupBy("id", "h").agg(F.count("*").alias("n"), F.max("n_chars").alias("n_chars"))
    ranged = grouped.repartitionByRange(F.desc("id"), F.desc("h")).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "order")
    inside = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("h"))
    this = F.struct("id", "h", "n_chars")
    ends = ranged.groupBy("part").agg(F.max(F.struct("id", "h", "n_chars")).alias("first"), F.min(F.struct("id", "h", "n_chars")).alias("last"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("first"), F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("last"))
    linked = ranged.withColumn("next", F.lead(this).over(inside)).withColumn("prev", F.lag(this).over(inside)).join(F.broadcast(ends), "part")
    after, before = F.coalesce("next", "first"), F.coalesce("prev", "last")
    return linked.select("id", "h", "n", after["id"].alias("next_id"), after["h"].alias("next_h"), before["id"].alias("prev_id"), before["h"].alias("prev_h"), before["n_chars"].alias("prev_chars"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and next_doc_id of every row of ``docs`` (doc_id, text).

    The edited text is the text with its last third (floor) replaced by as many first code points of the next document in descending doc_id, all of them
    if it has fewer; the last document's next is the first, a lone one's itself. A null text is empty; null doc_ids come last; rows of one doc_id
    follow by a hash of their texts, so equal rows are next to each other. The text is shuffled once, and its needed first part once more.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("h"), text.alias("text"))
    order = neighbours(base.select("id", "h", F.length("text").alias("n_chars")))
    turn = F.row_number().over(Window.partitionBy("id", "h").orderBy("id"))
    joined = base.withColumn("turn", turn).join(order, ["id", "h"])
    # What each key hands to the one before it: the first part of its text and its sketch. Of equal rows the first alone has a key to go to. The same
    # columns are read as above, so that both sides use one shuffle of the texts; a text's own sketch is made after it, not sent along.
    head = F.substr("text", F.lit(1), F.floor(F.col("prev_chars") / 3).cast("int"))
    to = F.when(F.col("turn") == 1, F.struct(F.col("prev_id").alias("id"), F.col("prev_h").alias("h")))
    handed = joined.select(to.alias("to"), head.alias("head"), sketch(F.col("text")).alias("next_fp"), F.col("doc_id").alias("next_doc_id"))
    handed = handed.select(F.col("to.id").alias("id"), F.col("to.h").alias("h"), "head", "next_fp", "next_doc_id")
    out = joined.join(handed, ["id", "h"])
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    repeated = F.col("turn") < F.col("n")  # all but the last of equal rows are followed by an equal row
    head = F.when(repeated, F.substr("text", F.lit(1), third)).otherwise(F.col("head"))
    edited = F.concat(F.substr("text", F.lit(1), size - third), F.substr(head, F.lit(1), third))
    out = out.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("fp"), "next_fp", "next_doc_id", repeated.alias("repeated"))
    own_or = lambda own, other: F.when(F.col("repeated"), F.col(own)).otherwise(F.col(other))
    edited = F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("efp")
    out = out.select("doc_id", "n_chars", *edited, "fp", own_or("fp", "next_fp").alias("nfp"), own_or("doc_id", "next_doc_id").alias("next_doc_id"))
    fp, efp, nfp = (F.col(c) for c in ("fp", "efp", "nfp"))
    texts = as_text(fp).alias("fingerprint"), as_text(efp).alias("edited_fingerprint")
    near = likeness(fp, efp).alias("near_edited"), likeness(fp, nfp).alias("near_next")
    return out.select("doc_id", "n_chars", "edited_sha256", *texts, *near, "next_doc_id")
