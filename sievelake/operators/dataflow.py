"""Data flow: use-def chains, reaching definitions, taint flows. Definitions (function, id, variable, source_kind, source_value, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import SANITIZERS, TAINT_SINKS, TAINT_SOURCES
from .rounds import FOLDED, kept


def use_def(definitions: DataFrame, scope: str = "function") -> DataFrame:
    """For each scope and variable the sorted ids of its definitions."""
    return definitions.groupBy(scope, "variable").agg(F.array_sort(F.collect_set("id")).alias("def_ids"))


def reaching(definitions: DataFrame, scope: str = "function") -> DataFrame:
    """For each definition the sorted ids that reach it: all of its scope but the highest and those of its own variable, and itself.

    A scope's ids are gathered once; each definition then takes its variable's away, so nothing is paired.
    """
    everything = definitions.groupBy(scope).agg(F.array_sort(F.collect_set("id")).alias("_all"))
    own = use_def(definitions, scope).withColumnRenamed("def_ids", "_own")
    out = definitions.select(scope, "variable", "id").distinct().join(own, [scope, "variable"]).join(everything, scope)
    but_last = F.slice("_all", F.lit(1), F.size("_all") - 1)
    return out.select(scope, "variable", "id", F.array_sort(F.array_union(F.array_except(but_last, "_own"), F.array("id"))).alias("reaching_ids"))


def reaching_at(reached: DataFrame, points: DataFrame, scope: str = "function") -> DataFrame:
    """``points`` (scope, id) with the definitions that reach them; none for a point that no definition is at."""
    none = F.array().cast(dict(reached.dtypes)["reaching_ids"])
    joined = points.join(reached.select(scope, "id", "reaching_ids"), [scope, "id"], "left")
    return joined.withColumn("reaching_ids", F.coalesce("reaching_ids", none))


def trace_to_source(definitions: DataFrame, uses: DataFrame, scope: str = "function") -> DataFrame:
    """``uses`` (scope, variable) with the kinds and values of their variable's definitions, by id; none for an unknown variable. One step, not further."""
    made = F.sort_array(F.collect_list(F.struct("id", "source_kind", "source_value")))
    known = definitions.groupBy(scope, "variable").agg(made.alias("sources"))
    return uses.join(known, [scope, "variable"], "left").withColumn("sources", F.coalesce("sources", F.array().cast(dict(known.dtypes)["sources"])))


def _first(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for part, kind in reversed(table.items()):
        out = F.when(value.contains(part), kind).otherwise(out)
    return out


def is_source(value: Column) -> Column:
    out = F.lit(False)
    for part in TAINT_SOURCES:
        out = out | F.coalesce(value.contains(part), F.lit(False))
    return out


def source_kind(kind: Column, value: Column) -> Column:
    """Where tainted input comes from, by what its text contains first; calls count as requests."""
    has = lambda *parts: value.contains(parts[0]) | value.contains(parts[1])
    read = F.when(has("request", "req."), "HttpRequest").when(has("file", "read"), "FileRead").when(has("environ", "env"), "EnvironmentVariable").when(has("argv", "arg"), "CliArgument")
    return F.when(kind == "UserInput", read.otherwise("NetworkSocket")).otherwise("HttpRequest")


def taint_flows(definitions: DataFrame, scope: str = "function") -> DataFrame:
    """A flow for each tainted definition and each sink that a step of its variable's path contains.

    The path is the sources of all definitions of the variable, by id. A path with a sanitizer is sanitized, of confidence 0.3 instead of 0.85; the
    sink's place is the last step. Long chains stay within one variable of one scope.
    """
    path = definitions.groupBy(scope, "variable").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("source_value", F.lit("")).alias("v")))), lambda s: s["v"]).alias("path"))
    tainted = definitions.filter(F.col("source_kind").isin("UserInput", "FunctionCall") & is_source(F.col("source_value")))
    flows = tainted.select(scope, "variable", "id", "source_kind", "source_value").join(path, [scope, "variable"])
    hit = lambda part: F.exists("path", lambda s: s.contains(part))
    sinks = F.filter(F.array(*[F.when(hit(p), F.struct(F.lit(p).alias("sink"), F.lit(k).alias("sink_kind"))) for p, k in TAINT_SINKS.items()]), lambda s: s.isNotNull())
    step = F.filter("path", lambda s: _first(s, SANITIZERS).isNotNull())
    flows = flows.withColumn("_sink", F.explode(sinks)).withColumn("sanitizer", F.get(step, F.lit(0)))
    sanitized = F.col("sanitizer").isNotNull()
    return flows.select(
        scope, "variable", "id", source_kind(F.col("source_kind"), F.col("source_value")).alias("source"), "_sink.sink", "_sink.sink_kind", "path", F.element_at("path", -1).alias("sink_location"),
        "sanitizer", _first(F.col("sanitizer"), SANITIZERS).alias("sanitizer_kind"), sanitized.alias("sanitized"), F.when(sanitized, 0.3).otherwise(0.85).alias("confidence"),
    )


def taint_summary(definitions: DataFrame, flows: DataFrame, source: str | None = None, scope: str = "function") -> DataFrame:
    """For each scope whether an unsanitized flow exists, its sinks, and a hash of its source text (of its name where there is none)."""
    text = F.max(source) if source else F.first(F.col(scope).cast("string"))
    own = definitions.groupBy(scope).agg(F.left(F.sha2(text.cast("string"), 256), F.lit(16)).alias("summary_hash"))
    seen = flows.groupBy(scope).agg(F.bool_or(~F.col("sanitized")).alias("return_tainted"), F.array_sort(F.collect_set("sink")).alias("sinks"))
    out = own.join(seen, scope, "left")
    return out.select(scope, F.coalesce("return_tainted", F.lit(False)).alias("return_tainted"), F.coalesce("sinks", F.array().cast("array<string>")).alias("sinks"), "summary_hash")


def sinks_across_calls(flows: DataFrame, calls: DataFrame, scope: str = "function") -> DataFrame:
    """scope, sink and calls: the sinks that unsanitized input of each function reaches, in itself (0) or through the least number of ``calls`` (src, dst, any more).

    ``flows`` are those of ``taint_flows``. A summary goes from a function to those that call it, round by round from the innermost functions outward, so a
    cycle of calls ends when none of its members learns of a new sink. Where ``calls`` has sanitized, such calls pass nothing on. A null function takes no part.
    """
    passing = calls.filter(~F.coalesce("sanitized", F.lit(False))) if "sanitized" in calls.columns else calls
    passing = passing.select(F.col("dst").alias(scope), F.col("src").alias("_caller")).dropna().distinct()
    found = news = kept(flows.filter("NOT sanitized").select(scope, "sink", F.lit(0).alias("calls")).dropna().distinct())
    rounds = 0
    while True:
        rounds += 1
        came = passing.join(news.select(scope, "sink"), scope).select(F.col("_caller").alias(scope), "sink").distinct()
        news = kept(came.join(found.select(scope, "sink"), [scope, "sink"], "left_anti").withColumn("calls", F.lit(rounds)))
        if news.isEmpty():
            return found
        found = found.unionByName(news)
        if rounds % FOLDED == 0:
            found = kept(found)


def dominated_by_last(definitions: DataFrame, scope: str = "function") -> DataFrame:
    """The last definition of each variable, by id: the one that wins."""
    last = Window.partitionBy(scope, "variable").orderBy(F.desc("id"))
    return definitions.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
