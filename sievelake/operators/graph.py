"""Code graphs as tables: hops, impact, reachability. Nodes (id, name, ...), edges (src, dst, kind, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import CRITICAL_MODULES
from .rounds import FOLDED, kept


def hops(edges: DataFrame, seeds: DataFrame, k: int, backward: bool = False, kind: str | None = "calls", undirected: bool = False) -> DataFrame:
    """id and hop (least, from 1) of every node that a walk of 1 to ``k`` edges from the ``seeds`` (id) reaches.

    Seeds are found too where a walk returns to them. Each round joins the newest nodes alone, leaves out what was found before, and is kept, so the plan
    of a round has one join with the edges and one with what was found, whatever ``k`` is. Rounds end when nothing new is found.
    """
    steps = edges if kind is None or "kind" not in edges.columns else edges.filter(F.col("kind") == kind)
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = steps.select(F.col(a).alias("id"), F.col(b).alias("to"))
    if undirected:
        steps = steps.unionByName(steps.select(F.col("to").alias("id"), F.col("id").alias("to")))
    frontier = seeds.select("id").distinct()
    found = seeds.select("id").limit(0).withColumn("hop", F.lit(0))
    for hop in range(1, k + 1):
        new = steps.join(frontier, "id", "left_semi").select(F.col("to").alias("id")).distinct()
        new = kept((new if hop == 1 else new.join(found, "id", "left_anti")).withColumn("hop", F.lit(hop)))
        if new.isEmpty():
            break
        found, frontier = new if hop == 1 else found.unionByName(new), new.select("id")
        if hop % FOLDED == 0:
            found = kept(found)
    return found


def chains(edges: DataFrame, seeds: DataFrame, k: int | None = None, backward: bool = True, kind: str | None = "calls") -> DataFrame:
    """id, hop and chain of every node that a walk of 1 to ``k`` edges (of any number) from the ``seeds`` (id) reaches: chain is a shortest one, seed first.

    Of several nodes one step nearer the least is a chain's last but one, so of equally short chains one is told, and reruns agree. A seed that a walk
    returns to is found too, and every cycle ends where it meets what was found. A round joins the newest nodes alone and carries their chains on.
    """
    steps = edges if kind is None or "kind" not in edges.columns else edges.filter(F.col("kind") == kind)
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = steps.select(F.col(a).alias("id"), F.col(b).alias("to")).dropna()
    frontier = kept(seeds.select("id").distinct().select("id", F.array("id").alias("chain")))
    found, hop = None, 0
    while k is None or hop < k:
        hop += 1
        new = steps.join(frontier.select("id"), "id").groupBy("to").agg(F.min("id").alias("via"))
        if found is not None:
            new = new.join(found.select(F.col("id").alias("to")), "to", "left_anti")
        before = frontier.select(F.col("id").alias("via"), "chain")
        new = kept(new.join(before, "via").select(F.col("to").alias("id"), F.lit(hop).alias("hop"), F.concat("chain", F.array("to")).alias("chain")))
        if new.isEmpty():
            break
        found, frontier = new if found is None else found.unionByName(new), new.select("id", "chain")
        if hop % FOLDED == 0:
            found = kept(found)
    return frontier.limit(0).select("id", F.lit(0).alias("hop"), "chain") if found is None else found


def named(nodes: DataFrame, name: str) -> DataFrame:
    """All nodes of a name: a name may be defined more than once."""
    return nodes.filter(F.col("name") == name).select("id")


def callers(edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    return hops(edges, seeds, k, backward=True)


def callees(edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    return hops(edges, seeds, k)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of any kind with both ends in ``ids`` (id)."""
    out = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def impact_nodes(edges: DataFrame, changed: DataFrame, k: int = 2) -> DataFrame:
    """The changed nodes (id), their callers and their callees within ``k`` hops."""
    return changed.select("id").unionByName(callers(edges, changed, k).select("id")).unionByName(callees(edges, changed, k).select("id")).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The seeds and all nodes within ``k`` edges of any kind and direction, by breadth first."""
    return seeds.select("id").unionByName(hops(edges, seeds, k, kind=None, undirected=True).select("id")).distinct()


def labels(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.format_string("%s (%s:%s)", "name", "file_path", F.col("line").cast("string")).alias("label"))


def impact_report(nodes: DataFrame, edges: DataFrame, changed: DataFrame, k: int = 2) -> DataFrame:
    """One row: sorted names of callers and callees (changed ones left out), modules (first path segment), files and the risk.

    ``nodes`` has id, name and file_path. Only names of the impact set are gathered, never the graph.
    """
    names = nodes.join(changed.select("id"), "id", "left_semi").select("name").distinct()
    side = lambda found: found.select("id").distinct().join(nodes, "id").join(names, "name", "left_anti")
    up, down = side(callers(edges, changed, k)), side(callees(edges, changed, k))
    touched = up.unionByName(down).unionByName(nodes.join(changed.select("id"), "id", "left_semi").select(up.columns))
    sets = up.agg(F.array_sort(F.collect_set("name")).alias("callers"), F.count("*").alias("n_callers")).join(down.agg(F.array_sort(F.collect_set("name")).alias("callees"))).join(
        touched.agg(F.array_sort(F.collect_set(F.split("file_path", "/")[0])).alias("modules"), F.array_sort(F.collect_set("file_path")).alias("files"))
    )  # three single rows
    return sets.withColumn("risk_level", risk(F.col("n_callers"), F.col("modules")))


def risk(n_callers, modules):
    """Critical if a critical module is touched; High from 21 callers; Medium from 6, or from one with more than 3 modules; else Low."""
    return (
        F.when(F.arrays_overlap(modules, F.array(*map(F.lit, CRITICAL_MODULES))), "Critical").when(n_callers > 20, "High")
        .when((n_callers > 5) | ((n_callers >= 1) & (F.size(modules) > 3)), "Medium").otherwise("Low")
    )


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """All nodes reachable from the ``entries`` (id), themselves included; rounds end when nothing new is found, however long the chains are.

    What was found is kept anew every FOLDED rounds, so that plans stay short.
    """
    steps = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    found = frontier = kept(entries.select("id").distinct())
    rounds = 0
    while not frontier.isEmpty():
        frontier = kept(steps.join(frontier, "id", "left_semi").select(F.col("to").alias("id")).distinct().join(found, "id", "left_anti"))
        found, rounds = found.unionByName(frontier), rounds + 1
        if rounds % FOLDED == 0:
            found = kept(found)
    return found


def unreachable(blocks: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Blocks (id) that no path from the entries reaches; an exit too, if none does."""
    return blocks.join(reachable(edges, entries), "id", "left_anti")


def exit_reachable(edges: DataFrame, entries: DataFrame, exit_id) -> DataFrame:
    return reachable(edges, entries).agg(F.coalesce(F.bool_or(F.col("id") == exit_id), F.lit(False)).alias("exit_reachable"))


def call_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """src, dst, kind and line of each call site of ``calls`` (file_path, line, callee) in the innermost symbol around it.

    ``symbols`` has id, name, file_path, line_start and line_end. Of several definitions of a name the last (greatest id) is called; calls outside
    any symbol, or of an unknown name, give no edge.
    """
    last = symbols.groupBy("name").agg(F.max("id").alias("dst"))
    around = symbols.select("file_path", "line_start", "line_end", F.col("id").alias("src"))
    inside = calls.join(around, "file_path").filter("line BETWEEN line_start AND line_end")
    keys = list(calls.columns)
    nearest = inside.groupBy(*keys).agg(F.max_by("src", F.struct("line_start", F.col("src"))).alias("src"))
    return nearest.join(last, nearest["callee"] == last["name"]).select("src", "dst", F.lit("calls").alias("kind"), "line")


# A call, and a definition of a function.
CALL = r"(?U)(\w+)\s*\("
FUNCTION = r"(?U)^\s*(?:async\s+def|def|fn|func|function)\s+(\w+)"
# A choice of ours: words before a parenthesis that call nothing.
NO_CALLS = ("if", "for", "while", "return", "switch", "catch", "def", "fn", "func", "function", "class", "and", "or", "not", "in")


def call_sites(lines: DataFrame) -> DataFrame:
    """file_path, line, callee and caller of each call in ``lines`` (file_path, line, text): one a match.

    The caller is the nearest function defined on the line or before it in the file; null before the first. A definition's own name is no call. A file's
    lines meet in one window, as they stand in one file.
    """
    defined = F.nullif(F.regexp_extract("text", FUNCTION, 1), F.lit(""))
    so_far = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("_defined", defined).withColumn("caller", F.last("_defined", ignorenulls=True).over(so_far))
    names = F.regexp_extract_all("text", F.lit(CALL), 1)
    own = F.array_position(names, F.col("_defined"))  # the first mention of the defined name is its definition
    calls = F.filter(names, lambda n, i: ~n.isin(*NO_CALLS) & ~F.coalesce(own == i + 1, F.lit(False)))
    return rows.select("file_path", "line", F.explode(calls).alias("callee"), "caller")


def source_calls(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, kind, line) and functions (id, name, file_path, line_start, line_end) of ``lines`` (file_path, line, text) of source files.

    A function ends where the next of its file begins; ids follow file and line, so of several of a name the last file's is called. Calls before the first
    function of a file, or of names that no file defines, are no edges.
    """
    rows = lines.withColumn("name", F.nullif(F.regexp_extract("text", FUNCTION, 1), F.lit("")))
    ends = lines.groupBy("file_path").agg(F.max("line").alias("last"))
    own = Window.partitionBy("file_path").orderBy("line")
    starts = rows.filter("name IS NOT NULL").withColumn("next", F.lead("line").over(own)).join(ends, "file_path")
    defined = starts.select(F.struct("file_path", "line").alias("id"), "name", "file_path", F.col("line").alias("line_start"), F.coalesce(F.col("next") - 1, "last").alias("line_end"))
    return call_edges(defined, call_sites(lines).select("file_path", "line", "callee")), defined


def cfg_blocks(blocks: DataFrame, order: str = "seq") -> DataFrame:
    """function, id, kind, label and line of control-flow blocks: 0 the entry and 1 the exit of each function, then ``blocks`` (function, kind, label, line, order) in order."""
    number = (F.row_number().over(Window.partitionBy("function").orderBy(order)) + 1).alias("id")
    inner = blocks.select("function", number, "kind", "label", "line")
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(kind).alias("kind"), F.lit(kind.lower()).alias("label"), F.lit(0).alias("line")) for i, kind in enumerate(("Entry", "Exit"))]))
    return blocks.select("function").distinct().withColumn("e", ends).select("function", "e.*").unionByName(inner)


def cfg_graph(blocks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (function, id, name, kind, line) and distinct edges (function, src, dst, kind) of control flow (blocks as of cfg_blocks; edges function, src, dst)."""
    nodes = blocks.select("function", "id", F.col("label").alias("name"), "kind", "line")
    return nodes, edges.select("function", "src", "dst").distinct().withColumn("kind", F.lit("control_flow"))
