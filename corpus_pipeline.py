"""A corpus from documents to packed bins: STAGES in order, each of (spark, docs, sf_dir).

Every stage but the last returns the columns of documents; its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import language_id, mixing, near_dup, packing, toxicity
from sievelake.llm.common import crc_fold, discard, scratch_paths, table, written

MIN_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learnt on the labels outside the held-out fold, finds toxic."""
    held = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").filter(~held).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, named=("_toxicity", "_toxic"))
    return scored.filter("_toxic = 0").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of no recognisable language: without a letter, or with no language of probability 0.5 or more.

    Where no language could be learnt, all documents with a letter stay.
    """
    held = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language_id.fit(docs.filter(~held).select("doc_id", "text", "lang"))
    if not model["langs"]:
        return docs.filter(language_id.has_letter(F.col("text")))
    scored = language_id.identify(docs, model, named=("_language", "_probability"))
    known = (F.col("_language") != language_id.UNKNOWN) & (F.col("_probability") >= MIN_LANGUAGE_SCORE)
    return scored.filter(known).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, by five-word shingles at similarity 0.8.

    Rows are judged one by one, whether their doc_ids are null, repeated or neither; null ones come last. Rows without a word are copies of nothing and stay.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = near_dup.near_duplicates(docs.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80)
    judged = written(judged.select(F.col("doc_id").alias("_n"), "component_id"), "judged")
    ids = docs.select(F.col(row).alias("_n"), F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("n")).alias("order"))
    stay = judged.join(ids, "_n").groupBy("component_id").agg(F.min("order")["n"].alias("_n"))
    gone = written(judged.select("_n").join(stay.select("_n"), "_n", "left_anti").withColumnRenamed("_n", "_gone_row"), "gone")
    return docs.join(gone, docs[row] == gone["_gone_row"], "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources meet their target weights; a source's last repetition may be of part of a text."""
    size = mixing.word_count(F.col("text"))
    narrow = written(docs.select("doc_id", "source", size.alias("_size")), "sizes").withColumnRenamed("_size", "size")
    sources = mixing.ranked_weights(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    columns = [f"c{k}" for k in range(len(docs.columns))]  # a mix adds columns whose names documents may have
    place = {c: columns[k] for k, c in enumerate(docs.columns)}
    needed = {place["doc_id"]: "doc_id", place["source"]: "source", place["text"]: "text"} | ({place["n_chars"]: "n_chars"} if "n_chars" in place else {})
    names = [needed.get(c, c) for c in columns]
    mixed = mixing.mix(docs.toDF(*names).withColumn("size", mixing.word_count(F.col("text"))), mixing.water_fill(sources), narrow=narrow)
    return mixing.repeated(mixed, names).toDF(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go: doc_id, text_key, piece, first_word, n_words, bin_id and bin_offset; packing.packed_texts makes the bins' texts of it."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: Trained classifiers and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents. A stage's scratch tables and its input go when its result has been written; the last result's stay."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = set(scratch_paths())
        docs = written(stage(spark, docs, sf_dir), name)
        *own, result = [p for p in scratch_paths() if p not in before]
        discard(spark, [*read, *own])
        read = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
