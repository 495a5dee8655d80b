"""Search: symbol postings, definitions, patterns, similar lines, positional differences. Lines (file, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import DEFINED, KEYWORDS

# What defines, what assigns, and what a symbol is.
DEFINITION, ASSIGNMENT, SYMBOL = "(?U)" + DEFINED, r"(?U)(\w+)\s*[:=]", r"(?:def|async def|class)\s+(\w+)"
#: White space of any script, and the four separators of ASCII.
BLANKS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trimmed(line: Column) -> Column:
    """A line without white space of any script at its ends."""
    return F.regexp_replace(line, f"^{BLANKS}+|{BLANKS}+$", "")


def postings(lines: DataFrame) -> DataFrame:
    """name, kind, file, line_no and snippet: the first definition and the first assignment of each line.

    Comment lines and keywords assign nothing.
    """
    name, var, text = F.regexp_extract("line", DEFINITION, 1), F.regexp_extract("line", ASSIGNMENT, 1), trimmed(F.col("line"))
    comment = text.startswith("#") | text.startswith("//") | text.startswith("/*")
    found = F.array(
        F.when(name != "", F.struct(name.alias("name"), F.lit("function").alias("kind"))),
        F.when((var != "") & ~comment & ~var.isin(*KEYWORDS), F.struct(var.alias("name"), F.lit("variable").alias("kind"))),
    )
    rows = lines.withColumn("_p", F.explode(F.filter(found, lambda p: p.isNotNull())))
    return rows.select("_p.name", "_p.kind", "file", "line_no", text.alias("snippet"))


def search_symbol(index: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    found = index.filter(F.col("name") == name)
    return found.filter(F.col("kind") == kind) if kind else found


def search_pattern(lines: DataFrame, pattern: str) -> DataFrame:
    """file, line_no and snippet of the lines in which the pattern is found, whatever the case."""
    return lines.filter(F.col("line").rlike("(?idU)" + pattern)).select("file", "line_no", trimmed(F.col("line")).alias("snippet"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0))


FEW_WORDS = 500_000  # words of snippets, of 50 bytes or so, that may be sent to every executor


def similar_lines(lines: DataFrame, snippets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """snippet_id, file, line_no, snippet, similarity (rounded) and share: the lines that hold at least ``threshold`` of a snippet's distinct words.

    ``snippets`` has snippet_id and text, ``lines`` a line for each (file, line_no). A line meets a snippet through one of the snippet's rarest words
    alone, as many as it may lack plus one (a line that lacks them all falls below), and the candidates are checked whole, so frequent words pair nothing.
    Where the snippets' words are few enough to be sent out, a line is met and checked in the task that read it; otherwise words and line numbers
    alone are shuffled, and the candidates' lines are read again.
    """
    wanted = snippets.select("snippet_id", tokens(F.col("text")).alias("want")).filter(F.size("want") > 0)
    each = wanted.select("snippet_id", "want", F.explode("want").alias("word"))
    few = each.limit(FEW_WORDS + 1).count() <= FEW_WORDS
    sent = F.broadcast if few else lambda df: df
    have = lines.select("file", "line_no", trimmed(F.col("line")).alias("snippet"), tokens(F.col("line")).alias("have"))
    rare = have.select(F.explode("have").alias("word")).join(sent(each.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("snippet_id").orderBy(F.coalesce("df", F.lit(0)), "word"))
    need = F.ceil(F.size("want") * F.lit(threshold) - 1e-9)
    keys = each.join(rare, "word", "left").withColumn("rank", rank).filter(F.col("rank") <= F.size("want") - need + 1).select("word", "snippet_id", "want")
    share = F.size(F.array_intersect("want", "have")) / F.size("want")
    if few:
        met = have.withColumn("word", F.explode("have")).join(F.broadcast(keys), "word")
    else:
        pairs = have.select("file", "line_no", F.explode("have").alias("word")).join(keys.select("word", "snippet_id"), "word").select("file", "line_no", "snippet_id").distinct()
        met = pairs.join(have, ["file", "line_no"]).join(wanted, "snippet_id")
    hits = met.withColumn("share", share).filter(F.col("share") >= threshold)
    return hits.groupBy("snippet_id", "file", "line_no", "snippet").agg(F.round(F.max("share"), 2).alias("similarity"), F.max("share").alias("share"))


def ranked_similar_lines(found: DataFrame, most: int | None = None) -> DataFrame:
    """Similar lines with their ``rank`` for each snippet: by similarity, the greatest first, then file and line; the first ``most`` where given."""
    order = Window.partitionBy("snippet_id").orderBy(F.desc("similarity"), "file", "line_no")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def find_definition(symbols: DataFrame, name: str) -> DataFrame:
    """The symbol (name, seq, ...) of that name, else the first by seq whose qualified name ends in it."""
    rank = F.when(F.col("name") == name, 0).when(F.col("name").endswith("." + name), 1)
    return symbols.withColumn("_rank", rank).filter("_rank IS NOT NULL").orderBy("_rank", "seq").limit(1).drop("_rank")


def type_info(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("type_info", F.coalesce(F.nullif(F.col("return_type"), F.lit("")), F.col("kind")))


def symbols_of(code: DataFrame) -> DataFrame:
    """Symbols of each ``code`` row (file, text) by pattern, one a match: name, kind, line_start = line_end, signature."""
    from .scan import match_positions

    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(SYMBOL), 1).alias("name"), F.regexp_extract_all("text", F.lit(SYMBOL), 0).alias("signature"), match_positions(F.col("text"), SYMBOL).alias("line"))
    rows = code.withColumn("_s", F.explode(found))
    kind = F.when(F.col("_s.signature").contains("def"), "function").otherwise("class")
    return rows.select(F.col("_s.name").alias("name"), kind.alias("kind"), "file", F.col("_s.line").alias("line_start"), F.col("_s.line").alias("line_end"), F.col("_s.signature").alias("signature"), F.lit("unknown").alias("visibility"))


def positional_diff(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """key, pos, old_line, new_line and changed: lines of two texts (key, text) by position, absent ones null and changed."""
    side = lambda df, name: df.select(*key, F.posexplode(F.split("text", "\n", -1)).alias("pos", name))
    both = side(old, "old_line").join(side(new, "new_line"), [*key, "pos"], "full_outer")
    return both.withColumn("changed", ~F.col("old_line").eqNullSafe(F.col("new_line")))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` (path, source) whose text is not that of ``old``: all that needs to be read again."""
    mark = lambda df: df.select("path", F.sha2("source", 256).alias("hash"))
    return new.withColumn("hash", F.sha2("source", 256)).join(mark(old), ["path", "hash"], "left_anti").drop("hash")
