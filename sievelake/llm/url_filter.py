"""URL filtering by character language models, with DataFrame functions only.

Two variable-order Markov models of characters are counted, one over accepted and one over rejected URLs (those that a rule
decides). A context's estimate is smoothed by its own suffix (Witten-Bell): P(c | s) = (n(s c) + t(s) P(c | s')) / (n(s) + t(s)),
where t(s) is the number of distinct characters seen after s, so an unseen context backs off wholly and a rich one hardly.
A URL's score is the mean over its characters of log P_accepted - log P_rejected; the cut is calibrated on rule-decided URLs that
training left out.

URLs are mapped to an alphabet of 38 classes, so that with contexts of up to 2 characters a model has at most 38^3 entries
however many URLs there are: the gains are one array of 54,872 numbers, and what is shuffled is counts of cells, summed before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import A_Z, A_Z_LOWER, written

#: Classes 0 to 25 are letters, 26 any digit, 27 to 36 these marks, 37 anything else.
MARKS = "/.-_?=&#%:"
SIZE = 38
ORDER = 2
FOLDS, HELD_OUT = 5, 0
STEPS = 400  # cuts tried on either side of 0, 0.01 apart

#: The dealt rules: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, at, 1), F.lit("")), A_Z, A_Z_LOWER)
    return host, F.coalesce(F.regexp_extract(url, at, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is outermost
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def cells(url: Column) -> Column:
    """For each character of the URL after ``://`` the number of its cell: two characters of context and itself, base 38.

    Marks of the beginning stand before the first character. Null, or without ``://``: no cells.
    """
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    rest = F.translate(rest, A_Z + "123456789", A_Z_LOWER + "0" * 9)
    rest = F.concat(F.lit("~" * ORDER), F.regexp_replace(rest, r"[^a-z0/._?=&#%:\-]", "~"))
    return F.transform(F.array(rest), _cells_of)[0]  # a bound variable: made once, not again for each character


def _cells_of(rest: Column) -> Column:
    alphabet = F.lit(A_Z_LOWER + "0" + MARKS + "~")

    def cell(i: Column) -> Column:
        code = F.lit(0)
        for back in range(ORDER, -1, -1):
            code = code * SIZE + F.instr(alphabet, F.substr(rest, i - back, F.lit(1))) - 1
        return code

    found = F.transform(F.sequence(F.lit(ORDER + 1), F.length(rest)), cell)
    return F.when(F.length(rest) > ORDER, found).otherwise(F.array().cast("array<int>"))


def _estimates(counts: DataFrame, side: str) -> DataFrame:
    """Adds p_<side> to ``counts``, which has a row for every cell and n_<side>; every window is over the 54,872 cells at most."""
    p, df = F.lit(1.0 / SIZE), counts
    for order in range(ORDER + 1):
        copies = SIZE ** (ORDER - order)  # cells with the same last characters
        same = Window.partitionBy(F.pmod("cell", F.lit(SIZE ** (order + 1))))
        context = Window.partitionBy(F.pmod(F.floor(F.col("cell") / SIZE), F.lit(SIZE**order)))
        df = df.withColumn("_n", F.sum(f"n_{side}").over(same).cast("double"))
        df = df.withColumn("_seen", F.sum("_n").over(context) / copies).withColumn("_kinds", F.sum((F.col("_n") > 0).cast("int")).over(context) / copies)
        df = df.withColumn(f"p_{side}", F.when(F.col("_seen") > 0, (F.col("_n") + F.col("_kinds") * p) / (F.col("_seen") + F.col("_kinds"))).otherwise(p))
        p = F.col(f"p_{side}")
    return df.drop("_n", "_seen", "_kinds")


def train(ruled: DataFrame) -> DataFrame:
    """cell, gain (log P_accepted - log P_rejected) for every cell, from ``ruled`` (url, ruled)."""
    seen = ruled.select(F.explode(cells(F.col("url"))).alias("cell"), "ruled").groupBy("cell")
    seen = seen.agg(F.count_if(F.col("ruled") == "allow").alias("n_allow"), F.count_if(F.col("ruled") == "block").alias("n_block"))
    grid = ruled.sparkSession.range(SIZE ** (ORDER + 1)).withColumnRenamed("id", "cell").join(seen, "cell", "left").fillna(0)
    both = _estimates(_estimates(grid, "allow"), "block")
    return both.select("cell", (F.log("p_allow") - F.log("p_block")).alias("gain"))


def score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``score``, the mean gain of a row's characters (0 without any), to ``rows``, which must hold ``url``.

    The gains are one array, a scalar subquery, in which each cell is a place: a URL is scored inside its row, without a join or a shuffle.
    """
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("cell", "gain"))), lambda c: c["gain"])
    gains = model.agg(in_order.alias("gains")).scalar()
    own = rows.withColumn("_cells", cells(F.col("url"))).withColumn("_gains", gains)
    total = F.aggregate("_cells", F.lit(0.0), lambda sum_, cell: sum_ + F.get("_gains", cell))
    mean = F.when(F.size("_cells") > 0, total / F.size("_cells")).otherwise(0.0)
    return own.withColumn("score", mean).drop("_cells", "_gains")


def calibrate(held_out: DataFrame) -> float:
    """The cut with the best sum of both classes' right shares over ``held_out`` (ruled, score), nearest to 0 among equals; 0 if a class is absent.

    Scores are counted in steps of 0.01, so 801 rows at most are compared.
    """
    step = F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(STEPS)), F.lit(-STEPS)).alias("step")
    bins = held_out.groupBy(step).agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")).collect()
    good, bad = sum(b.good for b in bins), sum(b.bad for b in bins)
    if not good or not bad:
        return 0.0
    cuts = {c: sum(b.good for b in bins if b.step >= c) / good + sum(b.bad for b in bins if b.step < c) / bad for c in {0, *(b.step for b in bins)}}
    return min(cuts, key=lambda c: (-round(cuts[c], 12), abs(c), c)) / 100


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    The verdict is the rule's or, without one, ``allow`` if the score reaches the calibrated cut, else ``block``. Models are counted on the URLs with a
    rule but for a fifth by md5 of the URL, which calibrates. Null URLs, and those without ``://``, have empty host and path, no rule and
    score 0. Repeated pages stay, each with its row; an empty table gives none. Other columns of ``pages`` are not read.
    """
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, what = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("ruled", what)
    fold = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS
    known = judged.filter("ruled IS NOT NULL").withColumn("held_out", fold == HELD_OUT)
    model = written(train(known.filter(~F.col("held_out")).select("url", "ruled")), "url-model")
    cut = calibrate(score(known.filter("held_out").select("url", "ruled"), model))
    scored = score(judged, model)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
