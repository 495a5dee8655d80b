"""Queries of the library's operators over the tables of a folder, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import types
from ..operators import dataflow, evaluate, graph, metrics, review, scan, search
from ..sources import diffs
from ..streaming import state
from .tables import customer_edges, document_lines, event_definitions, order_definitions, seed, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rules_sql() -> str:
    rows = [r for r in scan.active_rules() if not scan.file_scoped(r) and r["language"] == "all"]
    return ", ".join(f"({_text(r['rule_id'])}, {_text(r['category'])}, {_text(r['severity'])}, {_text(r['pattern'])})" for r in rows)


#: The library's word and space classes, spelled out for an engine whose own are ASCII.
_BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W, _S = r"[\p{L}\p{M}\p{N}_]", r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_KEYWORDS = ", ".join(map(_text, fixed.KEYWORDS))
_DOC_LINES = """SELECT doc_id, source, generate_subscripts(parts, 1) AS line_start, unnest(parts) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)"""
_HITS = f"""WITH lines AS ({_DOC_LINES}), rules(rule_id, category, severity, pattern) AS (VALUES {_rules_sql()}), hits AS (SELECT l.*, r.rule_id, r.category, r.severity
FROM lines l JOIN rules r ON regexp_matches(l.line, r.pattern, 'i'))"""


@query(f"{_HITS} SELECT doc_id, rule_id, severity, CAST(line_start AS INT) AS line_start, line FROM hits")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_lines(document_lines(spark, sf_dir))
    return found.select(F.col("diff_id").alias("doc_id"), "rule_id", "severity", "line_start", "line")


@query(f"{_HITS} SELECT doc_id, rule_id, severity, CAST(line_start AS INT) AS line_start, line FROM hits")
def rule_scan_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule scan by one automaton, in which rules without a hit cost nothing: the catalogue and 500 rules that find nothing."""
    others = [dict(scan.RULE_DICTS[0], rule_id=f"X-{k}", language="all", pattern=rf"no_such_name_{k}\s*\(") for k in range(500)]
    found = scan.scan_lines_with_many(document_lines(spark, sf_dir), scan.active_rules() + others)
    return found.select(F.col("diff_id").alias("doc_id"), "rule_id", "severity", "line_start", "line")


_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count" for s in fixed.SEVERITIES)


@query(f"{_HITS} SELECT source, count(*) AS total_issues, {_COUNTS} FROM hits GROUP BY source")
def rule_scan_severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.severity_counts(scan.scan_lines(document_lines(spark, sf_dir)), "source")


_NEWLINE_RULE = {"rule_id": "X-001", "name": "break after comma", "category": "style", "severity": "info", "language": "all", "is_deterministic": True, "cwe_id": None, "owasp_category": None, "description": "", "pattern": r"\.\n[A-Z]\w+ "}


_BREAK = rf"len(regexp_extract_all(text, '(?i)\.\n[A-Z]{_W}+ '))"


@query(f"SELECT doc_id, CAST({_BREAK} AS BIGINT) AS n FROM documents WHERE {_BREAK} > 0")
def rule_scan_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("added_lines"), F.lit("unknown").alias("language"))
    return scan.scan_files(files, [_NEWLINE_RULE]).groupBy("doc_id").agg(F.count("*").alias("n"))


_MARKERS = " OR ".join(f"contains(url, {_text(m)})" for m in fixed.TEST_MARKERS)


@query(f"""
WITH rules(rule_id, category, severity, pattern) AS (VALUES {_rules_sql()}),
lines AS (SELECT page_id, url, generate_subscripts(parts, 1) AS line_start, unnest(parts) AS line FROM (SELECT page_id, url, string_split(html, chr(10)) AS parts FROM pages))
SELECT page_id, rule_id, CASE WHEN ({_MARKERS}) AND category = 'security' THEN 'minor' ELSE severity END AS severity, CAST(line_start AS INT) AS line_start
FROM lines JOIN rules ON regexp_matches(line, pattern, 'i') WHERE NOT contains(line, 'nolint') AND NOT contains(line, 'no-lint')""")
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.split("html", "\n", -1)).alias("pos", "line"))
    lines = pages.select("page_id", "url", (F.col("pos") + 1).alias("line_start"), "line", F.lit("unknown").alias("language"))
    return scan.context_filter(scan.scan_lines(lines), "url", "line").select("page_id", "rule_id", "severity", "line_start")


_TEMPLATES = " ".join(f"WHEN rule_id = '{r}' THEN {_text(c)}" for r, c in fixed.FIX_TEMPLATES.items())


@query(f"""{_HITS} SELECT doc_id, rule_id, CAST(line_start AS INT) AS line_start, CASE WHEN severity IN ('critical', 'major') THEN CASE {_TEMPLATES}
WHEN category = 'security' AND contains(lower(line), 'execute') THEN replace(replace(line, '+', ', '), 'f"', '"') WHEN category = 'security' AND contains(line,
'innerHTML') THEN replace(line, 'innerHTML', 'textContent')
WHEN category = 'security' AND contains(line, 'os.system') THEN replace(line, 'os.system(', 'subprocess.run([')
WHEN category = 'performance' AND contains(line, '+=') AND contains(text, 'for ') THEN {_text(fixed.LOOP_HINT)} END END AS auto_fix_code FROM hits JOIN
(SELECT doc_id, text FROM documents) USING (doc_id) WHERE NOT contains(line, 'nolint') AND NOT contains(line, 'no-lint')""")
def fix_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.col("doc_id").cast("string").alias("path"), F.split("text", "\n", -1).alias("added_lines"))
    found = scan.with_code(scan.context_filter(scan.findings(document_lines(spark, sf_dir))), code)
    return review.with_fixes(review.route(found)).select(F.col("diff_id").alias("doc_id"), "rule_id", "line_start", "auto_fix_code")


_LANGUAGES = " ".join(f"WHEN suffix(url, '{s}') THEN '{v}'" for s, v in fixed.LANGUAGES.items())


@query(f"SELECT page_id, CASE {_LANGUAGES} ELSE 'unknown' END AS language FROM pages")
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", diffs.guess_language(F.col("url")).alias("language"))


def _doc_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select(F.col("diff_id").alias("file"), F.col("line_start").alias("line_no"), "line")


@query(rf"""
WITH lines AS ({_DOC_LINES}) SELECT doc_id AS file, CAST(line_start AS INT) AS line_no, regexp_replace(line, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS snippet FROM lines
WHERE regexp_matches(line, 'licen[sc]e|copyright|permission', 'i')""")
def pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_pattern(_doc_code(spark, sf_dir), "licen[sc]e|copyright|permission")


@query("""
WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS want FROM benchmark),
p AS (SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
h AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(lower(line), '[\\p{L}\\p{M}\\p{N}_]+')) AS have FROM p)
SELECT item_id AS snippet_id, doc_id AS file, CAST(line_no AS INT) AS line_no, round(len(list_intersect(want, have)) / len(want), 6) AS similarity
FROM w JOIN h ON len(want) > 0 AND len(list_intersect(want, have)) / len(want) >= 0.7""".replace("\\\\", "\\"))
def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippets = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("snippet_id"), "text")
    return search.similar_lines(_doc_code(spark, sf_dir), snippets).select("snippet_id", "file", "line_no", F.round("share", 6).alias("similarity"))


_INDEX = rf"""WITH lines AS ({_DOC_LINES}), t AS (SELECT doc_id AS file, CAST(line_start AS INT) AS line_no, regexp_replace(line, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS snippet,
regexp_extract(line, '(?:def|fn|func|function|class){_S}+({_W}+)', 1) AS defined, regexp_extract(line, '({_W}+){_S}*[:=]', 1) AS assigned FROM lines)
SELECT defined AS name, 'function' AS kind, file, line_no, snippet FROM t WHERE defined <> ''
UNION ALL SELECT assigned, 'variable', file, line_no, snippet FROM t
WHERE assigned <> '' AND assigned NOT IN ({_KEYWORDS}) AND NOT (starts_with(snippet, '#') OR starts_with(snippet, '//') OR starts_with(snippet, '/*'))"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_doc_code(spark, sf_dir))


@query(_INDEX)
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query(f"SELECT file, line_no, snippet FROM ({_INDEX}) WHERE name = 'token' AND kind = 'variable'")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_symbol(_index(spark, sf_dir), "token", "variable").select("file", "line_no", "snippet")


@query("SELECT p_partkey, p_name, p_brand FROM (SELECT *, p_brand || '.' || p_name AS q FROM part) WHERE q LIKE '%.' || (SELECT max(p_name) FROM part) ORDER BY p_partkey LIMIT 1")
def find_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    name = parts.agg(F.max("p_name")).first()[0]
    symbols = parts.withColumn("name", F.concat_ws(".", "p_brand", "p_name")).withColumn("seq", F.col("p_partkey"))
    return search.find_definition(symbols, name).select("p_partkey", "p_name", "p_brand")


@query("""
WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations), l AS (SELECT conv_id, turn, generate_subscripts(parts, 1) -
1 AS pos, unnest(parts) AS line FROM t)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CAST(coalesce(a.pos, b.pos) AS INT) AS pos, a.line AS old_line, b.line
AS new_line, a.line IS DISTINCT FROM b.line AS changed
FROM l a FULL JOIN (SELECT conv_id, turn - 1 AS turn, pos, line FROM l WHERE turn > 0) b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.pos = b.pos""")
def token_positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next of its conversation; turn is the first of the two. A turn without a next is against nothing, as is one whose previous turn is absent."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    following = turns.filter("turn > 0").withColumn("turn", F.col("turn") - 1)
    return search.positional_diff(turns, following, "conv_id", "turn")


@query("""
SELECT o_orderkey AS id, o_orderstatus AS review_status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def list_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("review_status"), F.col("o_orderdate").alias("created_at"))
    return review.list_reviews(reviews, 50, review_status="F")


@query("""
SELECT o_orderkey AS id, o_totalprice, (SELECT count(*) FROM lineitem WHERE l_orderkey = 7) AS n_findings, (SELECT min(l_extendedprice) FROM lineitem WHERE
l_orderkey = 7) AS least FROM orders WHERE o_orderkey = 7""")
def get_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review_id"), "l_extendedprice", "l_linenumber")
    one = review.get_review(reviews, found, 7)
    return one.select("id", "o_totalprice", F.size(F.coalesce("findings", F.array().cast(dict(one.dtypes)["findings"]))).cast("long").alias("n_findings"), F.col("findings")[0]["l_extendedprice"].alias("least"))


@query(f"""
SELECT * FROM (VALUES {', '.join(f'({_text(r[0])}, {_text(r[2])}, {_text(r[3])}, {_text(r[4])})' for r in fixed.RULES if r[4] in ('python', 'all') and r[2] == 'style')})
AS t(rule_id, category, severity, language)""")
def list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r["rule_id"], r["category"], r["severity"], r["language"], True) for r in scan.RULE_DICTS]
    rules = spark.createDataFrame(rows, "rule_id string, category string, severity string, language string, is_enabled boolean")
    return review.list_rules(rules, True, "style", "python").drop("is_enabled")


_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'major' WHEN '3-MEDIUM' THEN 'minor' ELSE 'info' END"


def _order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "major").when(p == "3-MEDIUM", "minor").otherwise("info")
    return table(spark, sf_dir, "orders").select("o_orderstatus", severity.alias("severity"))


@query(f"SELECT o_orderstatus, count(*) AS total_issues, {_COUNTS} FROM (SELECT o_orderstatus, {_PRIORITY} AS severity FROM orders) GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.severity_counts(_order_findings(spark, sf_dir), "o_orderstatus")


@query(f"SELECT severity, n, round(n * 100.0 / sum(n) OVER (), 6) AS share FROM (SELECT {_PRIORITY} AS severity, count(*) AS n FROM orders GROUP BY 1)")
def severity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.severity_share(_order_findings(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 2 = 0 ELSE p_size > 25 END AS is_enabled FROM part")
def toggle_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    rules = parts.select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") > 25).alias("is_enabled"))
    overrides = parts.filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("rule_id"), (F.col("p_partkey") % 2 == 0).alias("enabled"))
    return review.toggled(rules, overrides)


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    half = review.insert_ignore(events.limit(0), events.filter("event_id < 100"), "user_id", "event_id")
    return review.insert_ignore(half, events, "user_id", "event_id")


@query("SELECT user_id, event_type AS status, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", F.col("event_type").alias("status"), "value")


_EDGES = "edges AS (SELECT DISTINCT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) + 1 AS dst FROM orders)"


def _walk(step: str, k: int) -> str:
    return f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(11 AS BIGINT) AS id, 0 AS hop UNION SELECT {step} WHERE r.hop < {k}) SELECT id, CAST(min(hop) AS INT) AS hop FROM r WHERE hop > 0 GROUP BY id"


@query(_walk("e.src, r.hop + 1 FROM r JOIN edges e ON e.dst = r.id", 3))
def callers_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers(customer_edges(spark, sf_dir), seed(spark, 11), 3)


@query(_walk("e.dst, r.hop + 1 FROM r JOIN edges e ON e.src = r.id", 3))
def callees_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callees(customer_edges(spark, sf_dir), seed(spark, 11), 3)


_IMPACT = f"""WITH RECURSIVE {_EDGES}, up AS (SELECT CAST(11 AS BIGINT) AS id, 0 AS hop UNION SELECT e.src, hop + 1 FROM up JOIN edges e ON e.dst = up.id WHERE hop <
2),
down AS (SELECT CAST(11 AS BIGINT) AS id, 0 AS hop UNION SELECT e.dst, hop + 1 FROM down JOIN edges e ON e.src = down.id WHERE hop < 2), ids AS (SELECT
id FROM up UNION SELECT id FROM down)"""


@query(f"{_IMPACT} SELECT src, dst FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)")
def impact_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = customer_edges(spark, sf_dir)
    return graph.induced(edges, graph.impact_nodes(edges, seed(spark, 11))).select("src", "dst")


@query(f"""{_IMPACT}, nodes AS (SELECT c_custkey AS id, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
callers AS (SELECT DISTINCT id FROM up WHERE hop > 0 AND id <> 11)
SELECT (SELECT count(*) FROM callers JOIN nodes USING (id)) AS n_callers, count(DISTINCT n_name) AS n_modules,
CASE WHEN (SELECT count(*) FROM callers JOIN nodes USING (id)) > 20 THEN 'High' WHEN (SELECT count(*) FROM callers JOIN nodes USING (id)) > 5 OR (SELECT
count(*) FROM callers JOIN nodes USING (id)) >= 1 AND count(DISTINCT n_name) > 3 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM ids JOIN nodes USING (id)""")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    nodes = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = nodes.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat_ws("/", "n_name", "c_name").alias("file_path"))
    report = graph.impact_report(nodes, customer_edges(spark, sf_dir), seed(spark, 11))
    return report.select("n_callers", F.size("modules").cast("long").alias("n_modules"), "risk_level")


@query(f"""
WITH RECURSIVE {_EDGES}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT CAST(11 AS BIGINT) AS id, 0 AS hop UNION
SELECT b.dst, r.hop + 1 FROM r JOIN both_ways b ON b.src = r.id WHERE r.hop < 2) SELECT DISTINCT id FROM r""")
def filter_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(customer_edges(spark, sf_dir), seed(spark, 11), 2)


_REACH = f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(11 AS BIGINT) AS id UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.id)"


@query(f"{_REACH} SELECT id FROM r")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(customer_edges(spark, sf_dir), seed(spark, 11))


@query(f"{_REACH} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM r)")
def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return graph.unreachable(blocks, customer_edges(spark, sf_dir), seed(spark, 11))


_DEFS = "d AS (SELECT DISTINCT l_orderkey AS function, l_returnflag AS variable, l_linenumber AS id FROM lineitem)"


@query(f"WITH {_DEFS} SELECT function, variable, array_to_string(list(id ORDER BY id), ',') AS def_ids FROM d GROUP BY 1, 2")
def use_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataflow.use_def(order_definitions(spark, sf_dir))
    return out.withColumn("def_ids", F.array_join(F.col("def_ids").cast("array<string>"), ","))


@query(f"""WITH {_DEFS}, top AS (SELECT function, max(id) AS top FROM d GROUP BY 1)
SELECT a.function, a.variable, a.id, array_to_string(list_sort(list_distinct(list(b.id) FILTER (b.id = a.id OR (b.id <> t.top AND NOT EXISTS (SELECT 1
FROM d k WHERE k.function = a.function AND k.variable = a.variable AND k.id = b.id))))), ',') AS reaching_ids
FROM d a JOIN d b ON a.function = b.function JOIN top t ON a.function = t.function GROUP BY 1, 2, 3""")
def reaching_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataflow.reaching(order_definitions(spark, sf_dir))
    return out.withColumn("reaching_ids", F.array_join(F.col("reaching_ids").cast("array<string>"), ","))


_EVENT_DEFS = """d AS (SELECT user_id AS function, event_type AS variable, event_id AS id, CASE WHEN event_id % 7 < 5 THEN 'UserInput' ELSE 'FunctionCall' END AS source_kind,
['request.args', 'os.environ', 'cursor.execute(q)', 'html.escape(x)', 'sys.argv', 'eval(x)', 'print(x)'][CAST(event_id % 7 AS INT) + 1] AS v FROM events)"""
_SINKS = ", ".join(f"('{s}', '{k}')" for s, k in fixed.TAINT_SINKS.items())
_FLOWS = f"""WITH {_EVENT_DEFS}, steps AS (SELECT function, variable, bool_or(v IN ('html.escape(x)', 'print(x)')) AS sanitized FROM d GROUP BY 1, 2),
sinks(sink, sink_kind) AS (VALUES {_SINKS}), hit AS (SELECT DISTINCT function, variable, sink, sink_kind FROM d JOIN sinks ON contains(v, sink)),
flows AS (SELECT d.function, d.variable, d.id, CASE v WHEN 'request.args' THEN 'HttpRequest' WHEN 'os.environ' THEN 'EnvironmentVariable' ELSE 'CliArgument'
END AS source, sink, sink_kind, sanitized, CASE WHEN sanitized THEN 0.3 ELSE 0.85 END::DOUBLE AS confidence
FROM d JOIN hit USING (function, variable) JOIN steps USING (function, variable) WHERE v IN ('request.args', 'os.environ', 'sys.argv'))"""


@query(f"{_FLOWS} SELECT * FROM flows")
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.taint_flows(event_definitions(spark, sf_dir)).select("function", "variable", "id", "source", "sink", "sink_kind", "sanitized", "confidence")


@query(f"""
{_FLOWS} SELECT function, coalesce(bool_or(NOT sanitized), false) AS return_tainted, left(sha256(CAST(function AS VARCHAR)), 16) AS summary_hash FROM (SELECT
DISTINCT function FROM d) LEFT JOIN flows USING (function) GROUP BY function""")
def taint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_definitions(spark, sf_dir)
    return dataflow.taint_summary(d, dataflow.taint_flows(d)).select("function", "return_tainted", "summary_hash")


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS v FROM documents)
SELECT v, CASE WHEN v IN ('True', 'False', 'true', 'false') THEN 'Bool' WHEN regexp_full_match(v, '[+-]?[0-9]{1,18}') THEN 'Int'
WHEN regexp_full_match(v, '[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))') THEN 'Float' WHEN v[1] IN ('"', '''', '`') THEN 'String'
WHEN v IN ('None', 'null', 'nil') THEN 'Null' WHEN v[1] = '[' THEN 'List[Any]' WHEN v[1] = '{' THEN 'Dict[Any, Any]' ELSE 'Any' END AS type FROM w""")
def infer_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("v")).distinct()
    return words.withColumn("type", types.literal_type(F.col("v")))


@query("""WITH t AS (SELECT p_partkey, ['Int', 'Float', 'String', 'Any', 'Null'][CAST(p_partkey % 5 AS INT) + 1] AS a, ['Int', 'Float', 'String', 'Bool', 'Null',
'Any', 'List[Int]'][CAST(p_partkey % 7 AS INT) + 1] AS b FROM part)
SELECT *, a = b OR a = 'Any' OR b = 'Any' OR (a IN ('Int', 'Float') AND b IN ('Int', 'Float')) AS compatible FROM t""")
def type_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n + 1).cast("int"))
    a = types.annotation_type(pick(("int", "float64", "str", "unknown", "nil"), 5))
    b = types.annotation_type(pick(("i64", "number", "String", "boolean", "None", "any", "List[int]"), 7))
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b")).withColumn("compatible", types.types_compatible("a", "b"))


_EVAL = """WITH truths AS (SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN toxic = 1 THEN 'security' ELSE 'style' END AS category FROM labels WHERE quality = 0),
predictions AS (SELECT CAST(doc_id AS VARCHAR) AS file, 'style' AS category FROM documents WHERE n_chars < 600),
m AS (SELECT * FROM truths JOIN predictions USING (file, category))"""


def _evaluation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    kind = F.when(F.col("toxic") == 1, "security").otherwise("style")
    truths = labels.filter("quality = 0").select(F.col("doc_id").cast("string").alias("file"), kind.alias("category"), F.lit(1).alias("line"), F.col("doc_id").alias("gt_seq"))
    predictions = docs.filter("n_chars < 600").select(F.col("doc_id").cast("string").alias("file"), F.lit("style").alias("category"), F.lit(3).alias("line"), F.col("doc_id").alias("pred_seq"))
    return truths, predictions


@query(f"""{_EVAL}, c AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM predictions) - (SELECT count(*) FROM m) AS fp, (SELECT count(*) FROM truths)
- (SELECT count(*) FROM m) AS fn, (SELECT count(*) FROM truths) AS total_samples),
r AS (SELECT *, tp / greatest(tp + fn, 1) AS rc, tp / greatest(tp + fp, 1) AS pr FROM c)
SELECT tp, fp, fn, total_samples, round(rc, 4) AS recall, round(pr, 4) AS precision, round(2 * rc * pr / greatest(rc + pr, 0.001), 4) AS f1_score, round(fp
/ greatest(fp + tp, 1), 4) AS false_positive_rate FROM r""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths, predictions = _evaluation(spark, sf_dir)
    return evaluate.metrics(truths, predictions, evaluate.greedy_match(truths, predictions))


@query(f"""{_EVAL}, g AS (SELECT category, count(*) AS n FROM truths GROUP BY 1), p AS (SELECT category, count(*) AS np FROM predictions GROUP BY 1), t AS (SELECT
category, count(*) AS tp FROM m GROUP BY 1)
SELECT category, round(coalesce(tp, 0) / greatest(n, 1), 4) AS recall, round(coalesce(tp, 0) / greatest(coalesce(np, 0), 1), 4) AS precision, n AS count
FROM g LEFT JOIN p USING (category) LEFT JOIN t USING (category)""")
def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths, predictions = _evaluation(spark, sf_dir)
    return evaluate.by_category(truths, predictions, evaluate.greedy_match(truths, predictions))


@query()
def eval_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*sorted(items.columns))
    items = items.withColumn("seq", F.row_number().over(order)).select(F.col("l_orderkey").alias("file"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("line"), "seq", "l_returnflag", "l_discount")
    truths = items.filter("l_returnflag = 'R'").withColumnRenamed("seq", "gt_seq")
    return evaluate.greedy_match(truths, items.filter("l_discount > 0.05").withColumnRenamed("seq", "pred_seq"))


@query("""
SELECT round(count(*) FILTER (event_type = 'purchase') / count(*), 4) AS adoption_rate, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS
useful, count(*) FILTER (event_type = 'error') AS not_useful, count(*) FILTER (event_type = 'view') AS duplicate FROM events""")
def adoption_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    feedback = F.when(kind == "purchase", "useful").when(kind == "error", "not_useful").when(kind == "view", "duplicate").otherwise(kind)
    return evaluate.adoption(table(spark, sf_dir, "events").select(feedback.alias("feedback")))


def _period_sql(name: str) -> str:
    part = metrics.PERIODS[name]
    return f"SELECT '{name}' AS period, CAST(date_trunc('{part}', ts) AS TIMESTAMP) AS period_start, count(*) AS total_reviews, round(avg(value), 4) AS avg_review_time_ms, round(quantile_cont(value, 0.5), 4) AS p50_review_time_ms, round(quantile_cont(value, 0.99), 4) AS p99_review_time_ms FROM events GROUP BY 2"


def _period(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reviews = table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), F.col("value").alias("analysis_time_ms"))
        out = metrics.period_metrics(reviews, name)
        return out.select("period", F.col("period_start").cast("timestamp_ntz").alias("period_start"), "total_reviews", *[F.round(c, 4).alias(c) for c in out.columns[3:]])

    run.__name__ = f"period_metrics_{name}"
    return run


for _name in metrics.PERIODS:
    query(_period_sql(_name))(_period(_name))


@query("SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS period_start, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def merged_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's exact percentiles from the states of its days and the values of three narrow ranges."""
    out = metrics.exact_percentiles(table(spark, sf_dir, "events"), "ts", "value", "monthly", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select(F.col("period_start").cast("timestamp_ntz").alias("period_start"), *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query("""WITH f AS (SELECT page_id % 40 AS diff_id, url AS path, CASE WHEN page_id % 3 = 0 THEN 'Added' ELSE 'Modified' END AS change_type FROM pages)
SELECT diff_id, CASE WHEN bool_and(suffix(path, '.md') OR suffix(path, '.rst') OR contains(path, 'docs/')) THEN 'Documentation'
WHEN bool_and(contains(path, '.yml') OR contains(path, '.yaml') OR contains(path, '.toml') OR contains(path, '.json') OR contains(path, 'Dockerfile') OR
contains(path, 'Makefile')) THEN 'Configuration'
WHEN bool_or(contains(path, 'package.json') OR contains(path, 'requirements.txt') OR contains(path, 'go.mod')) AND count(*) <= 3 THEN 'DependencyUpdate'
WHEN bool_or(contains(path, 'test') OR contains(path, 'spec')) AND count(*) = 1 THEN 'BugFix' WHEN bool_or(change_type = 'Added') THEN 'NewFeature' ELSE
'Refactor' END AS change_category, count(*) AS n_files FROM f GROUP BY 1""")
def change_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "Added").otherwise("Modified")
    files = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("diff_id"), F.col("url").alias("path"), kind.alias("change_type"))
    return diffs.change_category(files)


@query("""SELECT user_id AS function_name, event_type AS hash FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND""")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    entries = events.select(F.col("user_id").alias("function_name"), F.col("event_type").alias("hash"), F.col("ts").alias("inserted_at"), F.col("event_id").alias("seq"))
    now = events.agg(F.max("ts")).first()[0]
    return state.cache_get(entries, F.lit(now)).select("function_name", "hash")


@query("""SELECT event_id AS seq, user_id AS function_name, event_type AS hash FROM events e LEFT JOIN (SELECT user_id AS u, max(event_type) AS now_hash FROM events
GROUP BY 1 HAVING bool_or(event_type = 'purchase')) c ON e.user_id = c.u
WHERE now_hash IS NULL OR now_hash = event_type""")
def invalidate_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("function_name"), F.col("event_type").alias("hash"))
    known = events.groupBy("function_name").agg(F.max("hash").alias("hash"), F.bool_or(F.col("hash") == "purchase").alias("known"))
    current = known.filter("known").select("function_name", "hash")
    return state.invalidate_by_hash(events, current).select("seq", "function_name", "hash")


@query("""WITH c AS (SELECT event_id, user_id, event_type IN ('error', 'click', 'view') AS failed FROM events), r AS (SELECT *, count(*) FILTER (NOT failed) OVER
(PARTITION BY user_id ORDER BY event_id) AS run FROM c),
n AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, run ORDER BY event_id) AS in_run FROM r)
SELECT event_id, user_id, failed, coalesce(max(in_run) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >=
3, false) AS open FROM n""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").isin("error", "click", "view").alias("failed"))
    return state.breaker(calls, "user_id", "event_id").select("event_id", "user_id", "failed", "open")


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return review.cascade(children, table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey")


@query(f"{_HITS} SELECT category, severity, count(*) AS n, CAST(grouping(category, severity) AS BIGINT) AS level FROM hits GROUP BY ROLLUP (category, severity)")
def rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rollup_report(scan.scan_lines(document_lines(spark, sf_dir)))


def _part_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each part: two files, the second one new when the size is even."""
    parts = table(spark, sf_dir, "part")
    new = F.when(F.col("p_size") % 2 == 0, "new file mode 100644\n").otherwise("")
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("diff --git a/lib/"), "p_brand", F.lit(".py b/lib/"), "p_brand", F.lit(".py\n--- a/lib/x.py\n+++ b/lib/"), "p_brand", F.lit(".py\n@@ -1,2 +"), size, F.lit(",3 @@ def f\n same\n+def "), F.replace("p_name", F.lit(" "), F.lit("_")),
        F.lit("():\n-"), "p_type", F.lit("\n+  return 1\ndiff --git a/web/"), size, F.lit(".tsx b/web/"), size, F.lit(".tsx\n"), new, F.lit("+++ b/web/"), size, F.lit(".tsx\n@@ -0,0 +1 @@\n+let x = 1"),
    )
    return parts.select(F.col("p_partkey").alias("diff_id"), text.alias("diff_content"), F.lit("").alias("language"))


@query("""SELECT p_partkey AS diff_id, 'lib/' || p_brand || '.py' AS path, 'python' AS language, CAST(1 AS INT) AS line_start, p_size + 1 AS file_line, 'def ' ||
replace(p_name, ' ', '_') || '():' AS line FROM part
UNION ALL SELECT p_partkey, 'lib/' || p_brand || '.py', 'python', 2, p_size + 2, '  return 1' FROM part UNION ALL SELECT p_partkey, 'web/' || p_size ||
'.tsx', 'typescript', 1, 1, 'let x = 1' FROM part""")
def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.added_lines(_part_diffs(spark, sf_dir)).drop("section")


@query("""SELECT p_partkey AS diff_id, 'lib/' || p_brand || '.py' AS path, 'python' AS language, CAST(2 AS INT) AS n_added, CAST(1 AS INT) AS n_removed FROM part
UNION ALL SELECT p_partkey, 'web/' || p_size || '.tsx', 'typescript', 1, 0 FROM part""")
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.files(_part_diffs(spark, sf_dir)).select("diff_id", "path", "language", F.size("added_lines").alias("n_added"), F.size("removed_lines").alias("n_removed"))


@query("""SELECT p_partkey AS diff_id, CAST(3 AS BIGINT) AS additions, CAST(1 AS BIGINT) AS deletions, 'lib,web' AS modules, replace(p_name, ' ', '_') AS functions,
CASE WHEN p_size % 2 = 0 THEN 'NewFeature' ELSE 'Refactor' END AS change_category, CAST(2 AS BIGINT) AS n_files FROM part""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diffs.summary(_part_diffs(spark, sf_dir))
    return out.withColumn("modules", F.array_join("modules", ",")).withColumn("functions", F.array_join("functions", ","))


@query("""
SELECT p_partkey AS diff_id, CAST(1 AS INT) AS old_start, CAST(2 AS INT) AS old_count, p_size AS new_start, CAST(3 AS INT) AS new_count, 'def f' AS heading
FROM part UNION ALL SELECT p_partkey, 0, 0, 1, 1, '' FROM part""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = diffs.diff_lines(_part_diffs(spark, sf_dir)).select("diff_id", "line")
    return diffs.hunks(lines).drop("line")


@query("SELECT page_id AS path, html AS source FROM pages WHERE page_id % 3 = 0")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("source"))
    old = pages.withColumn("source", F.when(F.col("path") % 3 == 0, F.concat("source", F.lit(" "))).otherwise(F.col("source")))
    return search.changed_files(old, pages)


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) SELECT doc_id, array_to_string(list_concat(a[1:0], ['fixed'], a[2:]), chr(10)) AS text FROM p""")
def apply_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    return docs.select("doc_id", F.array_join(review.apply_fix(F.col("lines"), F.lit(1), F.lit(1), F.lit("fixed")), "\n").alias("text"))


@query(f"""
WITH {_EDGES} SELECT src, dst FROM edges WHERE src IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND dst IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return graph.induced(customer_edges(spark, sf_dir), rich).select("src", "dst")


@query(f"{_HITS} SELECT 'stage1_deterministic' AS filter_stage, count(*) AS n FROM hits")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.funnel(scan.findings(document_lines(spark, sf_dir)))


@query("""SELECT o_orderkey AS src, (SELECT max(p_partkey) FROM part WHERE p_brand = o.brand) AS dst, line FROM
(SELECT DISTINCT o_orderkey, 1 + o_orderkey % 9 AS line, 'Brand#' || (1 + o_orderkey % 5) || (1 + o_custkey % 5) AS brand FROM orders) o WHERE EXISTS (SELECT
1 FROM part WHERE p_brand = o.brand)""")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a function of ten lines in a file of its own with one call, to the brand of the parts; the last part of a brand is its definition."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct()
    file = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    own = orders.select(F.col("o_orderkey").alias("id"), file.alias("name"), file.alias("file_path"), F.lit(1).alias("line_start"), F.lit(10).alias("line_end"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.lit("parts").alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    brand = F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 5 + 1).cast("string"), (F.col("o_custkey") % 5 + 1).cast("string"))
    calls = orders.select(file.alias("file_path"), (F.col("o_orderkey") % 9 + 1).alias("line"), brand.alias("callee"))
    return graph.call_edges(own.unionByName(parts), calls).select("src", "dst", "line")


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS type_info FROM customer")
def type_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer")
    kinds = people.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("return_type"), F.col("c_name").alias("kind"))
    return search.type_info(kinds).select("c_custkey", "c_mktsegment", "type_info")
