"""Queries of what changed between texts, and of searches by index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linediff, search, trigrams
from ..operators.rounds import scratch
from .queries import _BLANKS, _KEYWORDS, _S, _W, ORACLE_SQL, query
from .tables import table


@query("""SELECT conv_id, turn, sha256(text) AS made FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 1""")
def turn_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn made of the one before it and the script of line changes between them."""
    pairs = linediff.successive(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    scripts = linediff.line_script(pairs)
    made = linediff.replayed(pairs.select("conv_id", "turn", F.col("old").alias("text")), scripts, "conv_id", "turn")
    return made.select("conv_id", "turn", F.sha2("text", 256).alias("made"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents before and after an edit: the second line goes, and a definition comes as the third."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("old"), F.split("text", "\n", -1).alias("lines"))
    name = F.concat(F.lit("def f"), F.col("file").cast("string"), F.lit("(a=1):"))
    new = F.concat(F.slice("lines", 1, 1), F.slice("lines", 3, 1), F.array(name), F.slice("lines", 4, 1 << 30))
    return docs.select("file", "old", F.array_join(new, "\n").alias("new"))


_NEW_LINES = """edits AS (SELECT doc_id AS file, list_concat(a[1:1], a[3:3], ['def f' || doc_id || '(a=1):'], a[4:]) AS a FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
lines AS (SELECT file, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM edits)"""


@query(rf"""WITH {_NEW_LINES}, t AS (SELECT file, CAST(line_no AS INT) AS line_no, regexp_replace(line, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS snippet,
regexp_extract(line, '(?:def|fn|func|function|class){_S}+({_W}+)', 1) AS defined, regexp_extract(line, '({_W}+){_S}*[:=]', 1) AS assigned FROM lines)
SELECT defined AS name, 'function' AS kind, file, line_no, snippet FROM t WHERE defined <> ''
UNION ALL SELECT assigned, 'variable', file, line_no, snippet FROM t
WHERE assigned <> '' AND assigned NOT IN ({_KEYWORDS}) AND NOT (starts_with(snippet, '#') OR starts_with(snippet, '//') OR starts_with(snippet, '/*'))""")
def updated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents after an edit, from the index before it and the changed lines."""
    edits = _edits(spark, sf_dir)
    lines = edits.select("file", F.posexplode(F.split("old", "\n", -1)).alias("pos", "line"))
    index = search.postings(lines.select("file", (F.col("pos") + 1).alias("line_no"), "line"))
    return linediff.updated_postings(index, linediff.line_script(edits))


@query(f"""WITH {_NEW_LINES}, n AS (SELECT doc_id AS file, len(string_split(text, chr(10))) AS n_old FROM documents),
blocks AS (SELECT file, unnest(range(1, len(a) + 1, 5)) AS line_start, len(a) AS n FROM edits)
SELECT file, CAST(line_start AS INT) AS line_start FROM blocks JOIN n USING (file) WHERE line_start = 1""")
def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of blocks of five lines those that the edit touched: the first of each document."""
    edits = _edits(spark, sf_dir)
    size = F.size(F.split("new", "\n", -1))
    blocks = edits.withColumn("line_start", F.explode(F.sequence(F.lit(1), size, F.lit(5))))
    blocks = blocks.select("file", "line_start", F.least(F.col("line_start") + 4, size).alias("line_end"))
    return linediff.changed_definitions(blocks, linediff.line_script(edits)).select("file", "line_start")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    path = scratch(spark, "trigrams")
    trigrams.trigram_index(texts).write.parquet(path)
    return spark.read.schema("trigram string, file long").parquet(path), texts


@query(ORACLE_SQL["pattern_search"])
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As pattern_search, over the documents alone that have the trigrams of one of its alternatives."""
    return trigrams.search_indexed(*_index(spark, sf_dir), "licen[sc]e|copyright|permission")


@query("""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
has AS (SELECT *, (contains(t, 'lic') AND contains(t, 'ice') AND contains(t, 'cen')) OR (contains(t, 'cop') AND contains(t, 'opy') AND contains(t, 'pyr') AND contains(t, 'yri')
AND contains(t, 'rig') AND contains(t, 'igh') AND contains(t, 'ght')) OR (contains(t, 'per') AND contains(t, 'erm') AND contains(t, 'rmi') AND contains(t, 'mis') AND contains(t, 'iss')
AND contains(t, 'ssi') AND contains(t, 'sio') AND contains(t, 'ion')) AS candidate FROM d)
SELECT count(*) AS files, count(*) FILTER (candidate) AS files_read FROM has""")
def indexed_search_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the search reads, of how many."""
    index, texts = _index(spark, sf_dir)
    found = trigrams.candidates(index, "licen[sc]e|copyright|permission")
    return texts.agg(F.count("*").alias("files")).join(found.agg(F.count("*").alias("files_read")))  # two single rows
