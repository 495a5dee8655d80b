"""Line dedup: lines that many documents share go from all of them.

How many documents have a line is kept in levelled sorted runs of line hashes, for corpora that arrive in batches. A run is a table bucketed and sorted by
hash, with a count a hash. A batch first loses the hashes that the runs already know to be common (a merge anti-join), then adds the rest as a run of level
0; FAN runs of a level are merged into one of the next, so a hash is rewritten once a level. Counts stop at the limit from which a line is common, and so
does the growth of what common lines cost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, scratch, written

LEAST, FAN, BATCHES = 10, 3, 4
HOT = 1_000  # a line with more than one in HOT of all (document, line) pairs is hot; there are fewer than HOT such lines
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased (in UTF-8 no other character has their bytes)."""
    return line.strip(SPACE).lower()


def keys_of(text: bytes | None) -> set[bytes]:
    """The hashes (16 bytes each) of a text's lines; lines with an empty key have none."""
    return {xxhash.xxh3_128_digest(k) for k in {line_key(x) for x in (text or b"").split(b"\n")} if k}


def without(text: bytes | None, gone: set[bytes]) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the others joined by newlines; a null or empty text is one empty line."""
    lines = (text or b"").split(b"\n")
    kept = [x for x in lines if not (k := line_key(x)) or xxhash.xxh3_128_digest(k) not in gone] if gone else lines
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


class LineRuns:
    """Levelled sorted runs of (h, n) in the shared folder: n documents, ``least`` at most, have the line of hash h."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fan: int = FAN):
        self.spark, self.least, self.fan = spark, least, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as shuffles have, so that a batch meets the runs without another
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, name)
        counts.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, [self.paths.pop(name)])

    def _merged(self, names: list[str]) -> DataFrame:
        # outer joins, not a union: Spark 4.1 takes a union of bucketed tables for bucketed itself, and then adds up each table alone
        merged = self.spark.table(names[0])
        for name in names[1:]:
            both = merged.join(self.spark.table(name).withColumnRenamed("n", "m"), "h", "full")
            merged = both.select("h", F.least(F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)), F.lit(self.least)).alias("n"))
        return merged

    def add(self, keys: DataFrame) -> None:
        """Adds a batch, one row (h) a document and line."""
        counts = keys.groupBy("h").agg(F.least(F.count("*"), F.lit(self.least)).cast("int").alias("n"))
        for name in (n for level in self.levels for n in level):
            counts = counts.join(self.spark.table(name).filter(F.col("n") >= self.least).select("h"), "h", "left_anti")
        self._write(counts, 0)
        for level, names in enumerate(self.levels):
            if len(names) >= self.fan:  # may fill the next level, which the loop meets then
                self._write(self._merged(names), level + 1)
                self.levels[level] = []
                self._drop(names)

    def common(self) -> DataFrame:
        """h of every line that ``least`` documents or more have, over all batches."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "h binary")
        return self._merged(names).filter(F.col("n") >= self.least).select("h")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (h, any more) whose line no earlier batch has."""
        for name in (n for level in self.levels for n in level):
            keys = keys.join(self.spark.table(name).select("h"), "h", "left_anti")
        return keys

    def close(self) -> None:
        self._drop([n for level in self.levels for n in level])
        self.levels = [[]]


def document_keys(docs: DataFrame) -> DataFrame:
    """h and every other column of ``docs`` but ``text`` (binary): one row a document and distinct line."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # as many documents' lines stand in memory
                piece = batch.slice(at, 256)
                sets = [keys_of(t.as_py()) for t in piece.column("text")]
                index = pa.array([k for k, s in enumerate(sets) for _ in s], pa.int32())
                rows = [piece.column(c).take(index) for c in others]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([h for s in sets for h in s], pa.binary())], names=[*others, "h"])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in others], T.StructField("h", T.BinaryType())]))


def common_pairs(keys: DataFrame, common: DataFrame, share: int = HOT) -> DataFrame:
    """The rows of ``keys`` (h, any more) whose h is in ``common`` (h, distinct).

    A hash with more than 1 in ``share`` of the rows would fill a task of a join. There are fewer than ``share`` of those, so they are sent to every
    task; the rest are joined by shuffle.
    """
    counts = written(keys.join(common, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n")), "line-counts")
    limit = max((counts.agg(F.sum("n")).first()[0] or 0) // share, 1)
    hot = F.broadcast(counts.filter(F.col("n") > limit).select("h", F.lit(True).alias("_hot")))
    marked = keys.join(hot, "h", "left")
    rest = marked.filter("_hot IS NULL").join(counts.filter(F.col("n") <= limit).select("h"), "h", "left_semi")
    return marked.filter("_hot").unionByName(rest).drop("_hot")


def drop_common_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` (doc_id, text, any more) with the texts that are left, n_lines (before) and n_dropped.

    Lines end at newlines alone. Lines whose key at least ``least`` rows of ``docs`` have lose all their places; lines of white space stay. Every row is a
    document, equal rows and null doc_ids included; a null text is one empty line and stays null if nothing is dropped. Texts are read whole, and
    shuffled once, by doc_id and hash, unless Spark finds the lines to drop few. Columns of the new names are replaced. No rows give none.
    """
    spark = docs.sparkSession
    kept = docs.drop(n_lines, n_dropped)
    rows = kept.toDF(*[f"c{k}" for k in range(len(kept.columns))])  # whatever the names are
    doc_id, text = (F.col(rows.columns[kept.columns.index(c)]) for c in ("doc_id", "text"))
    names = {"id": F.coalesce(doc_id.cast("string"), F.lit("")), "x": F.xxhash64(text), "y": F.xxhash64(F.lit(1), text), "text": text.cast("binary")}
    rows = rows.withColumns(names)
    narrow = rows.select(*names, F.pmod(F.xxhash64("id", "x", F.lit("batch")), F.lit(batches)).cast("int").alias("batch"))
    path = scratch(spark, "lines")
    document_keys(narrow).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("id string, x long, y long, h binary, batch int").parquet(path)
    runs = LineRuns(spark, least)
    for k in range(batches):
        runs.add(keys.filter(F.col("batch") == k).select("h"))
    common = written(runs.common(), "common-lines")
    runs.close()
    gone = common_pairs(keys.drop("batch"), common).groupBy("id", "x", "y").agg(F.collect_set("h").alias("gone"))
    at = kept.columns.index("text")
    joined = rows.join(gone, ["id", "x", "y"], "left").select(*rows.columns[:at], "text", *rows.columns[at + 1 : len(kept.columns)], "gone")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            told = [without(t.as_py(), set(g.as_py() or ())) for t, g in zip(part.column("text"), part.column("gone"), strict=True)]
            left = pa.array([t if d else own.as_py() for own, (_, d, t) in zip(part.column("text"), told, strict=True)], pa.binary())
            counts = [pa.array([x[k] for x in told], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:at], left, *part.columns[at + 1 : -1], *counts], names=[*part.schema.names[:-1], "n_lines", "n_dropped"])

    counts = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")]
    out = joined.mapInArrow(run, T.StructType([*joined.drop("gone").schema, *counts]))
    return out.withColumn("text", F.col("text").cast("string")).toDF(*kept.columns, n_lines, n_dropped)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of ``docs`` (doc_id, text): the digest of the text that is left, of the empty text for a null one."""
    left = drop_common_lines(docs.select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
