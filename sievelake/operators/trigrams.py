"""A code search index: which texts have which three characters in a row, and searches that read the texts a pattern may be in alone."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import FOLDS
from .search import search_pattern

WAYS = 64  # alternatives of a pattern that are told apart; of one with more only what all of them share is asked


def folded(text: Column) -> Column:
    """Lower-case, and letters that ignoring the case takes for ASCII ones replaced by these."""
    return F.lower(F.translate(text, *FOLDS))


def trigram_index(texts: DataFrame) -> DataFrame:
    """trigram and file: every three characters in a row of every one of ``texts`` (file, text), once each, across line ends too.

    Sorted by range, so that a search of the written table skips all but a few row groups. Null texts and those of fewer characters have none.
    """
    each = F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit("(?s)(?=(...))"), 1))
    return texts.select(F.explode(each).alias("trigram"), "file").repartitionByRange("trigram", "file").sortWithinPartitions("trigram", "file")


def ways(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, of one of which a text that the pattern matches, folded, has all; an empty set asks nothing."""
    from re import _parser as parser
    from re import error

    def either(parts: list[list[frozenset[str]]]) -> list[frozenset[str]]:
        out = list(dict.fromkeys(w for part in parts for w in part))
        return out if len(out) <= WAYS else [frozenset.intersection(*out)]

    def both(parts: list[list[frozenset[str]]]) -> list[frozenset[str]]:
        out = [frozenset()]
        for part in parts:
            joined = list(dict.fromkeys(a | b for a, b in product(out, part)))
            out = joined if len(joined) <= WAYS else [a | frozenset.intersection(*part) for a in out]
        return out

    def of(sequence) -> list[frozenset[str]]:
        run, parts = "", []

        def ended():
            nonlocal run
            parts.append([frozenset(run[k : k + 3] for k in range(len(run) - 2))])
            run = ""

        for op, value in sequence:
            name = str(op)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            ended()
            if name == "BRANCH":
                parts.append(either([of(p) for p in value[1]]))
            elif name == "SUBPATTERN":
                parts.append(of(value[-1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                parts.append(of(value[2]))
        ended()
        return both(parts)

    try:
        return of(parser.parse(pattern))
    except (error, ValueError, ArithmeticError, LookupError):
        return [frozenset()]


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """The files (distinct) that may have a match of ``pattern``; None where that may be any."""
    found = ways(pattern)
    if not all(found):
        return None
    spark = index.sparkSession
    plan = spark.createDataFrame([(k, t, len(w)) for k, w in enumerate(found) for t in sorted(w)], "way int, trigram string, needed int")
    hits = index.filter(F.col("trigram").isin(sorted({t for w in found for t in w}))).join(F.broadcast(plan), "trigram")  # a pattern's trigrams
    return hits.groupBy("file", "way").agg(F.count("*").alias("n"), F.max("needed").alias("needed")).filter("n = needed").select("file").distinct()


def search_indexed(index: DataFrame, texts: DataFrame, pattern: str) -> DataFrame:
    """file, line_no and snippet of the lines of ``texts`` in which the pattern is found, whatever the case: as ``search_pattern``, over candidate files alone."""
    found = candidates(index, pattern)
    read = texts if found is None else texts.join(found, "file", "left_semi")
    lines = read.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return search_pattern(lines.select("file", (F.col("pos") + 1).alias("line_no"), "line"), pattern)
