"""Queries of whole reviews, the judge, and what else needs code of its own: literal texts dealt over the rows of a table, with the rows that they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, types
from ..functions import fixed_values as fixed
from ..operators import dataflow, graph, judge, metrics, review, scan, search
from ..operators.rounds import scratch
from ..sources import git, patches, symbols, testsets
from ..streaming import state
from .queries import _EDGES, _HITS, ORACLE_SQL, QUERIES, _text, query
from .reviews import evaluate_samples as evaluate_samples_by
from .reviews import review_findings, review_records
from .tables import customer_edges, document_lines, event_definitions, order_definitions, seed, table

#: Path and added lines of the file in each kind of diff, and what a review must find: rule, category, severity, line, fix.
_CODE = (
    ("a/loop.py", ("for r in rows:", "  s += 'x'")), ("a/key.py", ('PASSWORD = "abcdefghijklmnop"',)), ("a/old.py", ("pickle.loads(b)  # nolint", "except:")), ("a/test_x.py", ("os.system(request.x)",)),
    ("a/db.py", ("# for x", "conn = connect()", "a += connect()")), ("a/page.js", ("document.write(req.q)", "x = 1")), ("a/calm.py", ()),
    ("a/sql.py", ('cur.execute(f"SELECT a FROM t WHERE b = {x}")',)), ("a/path.py", ('data = open("../etc/passwd")',)), ("a/load.py", ("obj = yaml.load(body)",)), ("a/hash.py", ("digest = md5(data)",)),
    ("a/tls.py", ("get(url, verify=False)",)), ("a/go.py", ("return redirect(request.url)",)), ("a/ssrf.py", ("requests.get(query)",)), ("a/n1.py", ("x = 1", "for r in rows:", "  .execute(r)")),
    ("a/async.py", ("async def run(x):", "  time.sleep(1)")), ("a/copy.py", ("first = sorted(names)[0]",)), ("a/io.py", ("for r in rows:", "  .write(r)")), ("a/regex.py", ("for r in rows:", "  re.match(r)")),
    ("a/many.py", ("def f(a, b, c, d, e, g):",)), ("a/default.py", ("def f(a=[]):",)),
)
_FOUND = (
    (0, "PERF-002", "performance", "minor", 1, None), (1, "SEC-002", "security", "critical", 1, fixed.FIX_TEMPLATES["SEC-002"]), (2, "STYLE-003", "style", "minor", 2, None), (3, "SEC-003", "security", "minor", 1, None),
    (4, "PERF-005", "performance", "major", 2, None), (4, "PERF-005", "performance", "major", 3, fixed.LOOP_HINT), (5, "SEC-005", "security", "major", 1, fixed.FIX_TEMPLATES["SEC-005"]),
    (7, "SEC-001", "security", "critical", 1, fixed.FIX_TEMPLATES["SEC-001"]), (8, "SEC-004", "security", "critical", 1, None), (9, "SEC-006", "security", "critical", 1, fixed.FIX_TEMPLATES["SEC-006"]),
    (10, "SEC-007", "security", "major", 1, None), (11, "SEC-008", "security", "major", 1, None), (12, "SEC-009", "security", "major", 1, None), (13, "SEC-010", "security", "critical", 1, None),
    (14, "PERF-001", "performance", "major", 2, None), (15, "PERF-003", "performance", "major", 1, fixed.FIX_TEMPLATES["PERF-003"]), (16, "PERF-004", "performance", "minor", 1, None),
    (17, "PERF-006", "performance", "minor", 1, None), (18, "PERF-007", "performance", "minor", 1, None), (19, "STYLE-002", "style", "minor", 1, None), (20, "STYLE-004", "style", "major", 1, fixed.FIX_TEMPLATES["STYLE-004"]),
)


def _sql(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else _text(value)


_FOUND_SQL = "found(k, rule_id, category, severity, line_start, fix) AS (VALUES " + ", ".join(f"({', '.join(map(_sql, row))})" for row in _FOUND) + ")"
_PATH_SQL = "paths(k, path, code) AS (VALUES " + ", ".join(f"({k}, {_text(path)}, {_text(chr(10).join(lines))})" for k, (path, lines) in enumerate(_CODE)) + ")"


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each part, of one of the files of ``_CODE``."""
    texts = [f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1 +1,{len(lines)} @@\n-old" + "".join(f"\n+{line}" for line in lines) for p, lines in _CODE]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("diff_id"), _pick(texts, F.col("p_partkey")).alias("diff_content"), F.lit("").alias("language"))


@query(f"""WITH {_FOUND_SQL}, {_PATH_SQL} SELECT p_partkey AS diff_id, path AS file_path, rule_id, severity, CAST(line_start AS INT) AS line_start, code AS snippet, fix AS auto_fix_code
FROM part JOIN found ON p_partkey % {len(_CODE)} = k JOIN paths USING (k)""")
def review_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From diffs to findings, filtered, routed and with fixes."""
    return review_findings(_submitted(spark, sf_dir)).select("diff_id", "file_path", "rule_id", "severity", "line_start", "snippet", "auto_fix_code")


@query(f"""WITH {_FOUND_SQL}, {_PATH_SQL} SELECT p_partkey || '#1' AS diff_id, path AS file_path, rule_id, severity, CAST(line_start AS INT) AS line_start, code AS snippet, fix AS auto_fix_code
FROM part JOIN found ON p_partkey % {len(_CODE)} = k JOIN paths USING (k) WHERE suffix(path, '.py')""")
def review_of_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From bundles of patches to committed findings: read by path, reviewed, written and read back."""
    patches.register(spark)
    bundles, out = scratch(spark, "bundles"), scratch(spark, "findings")
    patches.bundled(_submitted(spark, sf_dir), bundles)
    read = spark.read.format("patches").load(bundles).filter(F.col("path").endswith(".py"))
    submitted = read.select(F.concat_ws("#", "diff_id", "section").alias("diff_id"), "diff_content", "language")
    found = review_findings(submitted).select("diff_id", "file_path", "rule_id", "severity", "line_start", "snippet", "auto_fix_code")
    found.write.format("findings").mode("append").save(out)
    return patches.read_findings(spark, out, found.schema)


_SEVERITY_SUMS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count" for s in fixed.SEVERITIES)


@query(f"""WITH {_FOUND_SQL} SELECT p_partkey AS diff_id, 'completed' AS review_status, count(rule_id) AS total_issues, {_SEVERITY_SUMS},
CAST(1 AS BIGINT) AS files_analyzed, CAST(0 AS INT) AS llm_calls FROM part LEFT JOIN found ON p_partkey % {len(_CODE)} = k GROUP BY p_partkey""")
def review_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a diff, those without findings or additions included."""
    submitted = _submitted(spark, sf_dir)
    return review_records(submitted, review_findings(submitted))


@query(f"""WITH {_FOUND_SQL}, {_PATH_SQL} SELECT 'r' || p_partkey AS review_id, rule_id, category, severity, path AS file_path, CAST(line_start AS INT) AS line_start,
CAST(0 AS INT) AS line_end, coalesce(fix, '') AS suggestion,
coalesce(fix, '') AS auto_fix_code, CAST(1.0 AS DOUBLE) AS llm_confidence, 'stage1_deterministic' AS filter_stage FROM part JOIN found ON p_partkey % {len(_CODE)}
= k JOIN paths USING (k)""")
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review_findings(_submitted(spark, sf_dir))
    return review.finding_rows(found, F.concat(F.lit("r"), F.col("diff_id").cast("string"))).drop("title", "description")


#: Of a document's truths one, at a line that its id chooses; and what some of the rules find in all documents.
_TESTSET = _HITS + """, truths AS (SELECT doc_id, 'security' AS category, 1 + doc_id % 6 AS line FROM documents UNION ALL SELECT doc_id, 'performance', 2 FROM documents WHERE doc_id % 2 = 0),
found AS (SELECT doc_id, category, line_start FROM hits WHERE category = 'security'),
m AS (SELECT DISTINCT doc_id, category FROM truths t JOIN found f USING (doc_id, category) WHERE abs(line - line_start) <= 3)"""
_SECURITY = tuple(r["rule_id"] for r in scan.active_rules() if r["category"] == "security" and r["language"] == "all")


def _testset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truths and samples: each document as a diff of one new file."""
    docs = table(spark, sf_dir, "documents")
    file = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    body = F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    text = F.concat(F.lit("diff --git a/x b/x\n+++ b/"), file, F.lit("\n@@ -0,0 +1 @@\n"), body)
    samples = docs.select(F.col("doc_id").alias("diff_id"), text.alias("diff_content"), F.lit("").alias("language"))
    one = docs.select(file.alias("file"), F.lit("security").alias("category"), (F.col("doc_id") % 6 + 1).alias("line"), F.col("doc_id").alias("gt_seq"))
    two = docs.filter("doc_id % 2 = 0").select(file.alias("file"), F.lit("performance").alias("category"), F.lit(2).cast("long").alias("line"), F.col("doc_id").alias("gt_seq"))
    return one.unionByName(two), samples


@query(f"""{_TESTSET}, c AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM found) - (SELECT count(*) FROM m) AS fp, (SELECT count(*) FROM truths) -
(SELECT count(*) FROM m) AS fn, (SELECT count(*) FROM truths) AS total_samples), r AS (SELECT *, tp / greatest(tp + fn, 1) AS rc, tp / greatest(tp + fp, 1) AS pr FROM c)
SELECT tp, fp, fn, total_samples, round(rc, 4) AS recall, round(pr, 4) AS precision, round(2 * rc * pr / greatest(rc + pr, 0.001), 4) AS f1_score, round(fp
/ greatest(fp + tp, 1), 4) AS false_positive_rate FROM r""")
def evaluate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a test set, here all documents as diffs, to the metrics of the security rules."""
    return evaluate_samples_by(*_testset(spark, sf_dir), only=_SECURITY)[0]


@query(f"""{_TESTSET}, g AS (SELECT category, count(*) AS n FROM truths GROUP BY 1), p AS (SELECT category, count(*) AS np FROM found GROUP BY 1), t AS (SELECT
category, count(*) AS tp FROM m GROUP BY 1)
SELECT category, round(coalesce(tp, 0) / greatest(n, 1), 4) AS recall, round(coalesce(tp, 0) / greatest(coalesce(np, 0), 1), 4) AS precision, n AS count
FROM g LEFT JOIN p USING (category) LEFT JOIN t USING (category)""")
def evaluate_samples_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_samples_by(*_testset(spark, sf_dir), only=_SECURITY)[1]


@query("SELECT o_orderkey, o_orderstatus = 'F' AS is_deterministic FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 100000")
def route_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that rules are not sure of go to a judge, here one that confirms great prices."""
    found = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("is_deterministic"))
    return review.route(found, lambda df: df.withColumn("is_issue", F.col("o_totalprice") > 100_000)).select("o_orderkey", "is_deterministic")


@query("""WITH c AS (SELECT event_id, user_id, value, event_type IN ('error', 'click', 'view') AS failed FROM events), r AS (SELECT *, count(*) FILTER (NOT failed)
OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
n AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, run ORDER BY event_id) AS in_run FROM r),
o AS (SELECT *, coalesce(max(in_run) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3, false) AS open
FROM n)
SELECT event_id, CASE WHEN open THEN event_id % 2 = 0 WHEN failed THEN false ELSE value > 50 END AS is_issue, CAST(CASE WHEN open THEN 0.3 WHEN failed
THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM o""")
def judged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge with a breaker says: while open the rule's own word, after a failure no issue."""
    failed = F.col("event_type").isin("error", "click", "view")
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", failed.alias("failed"), (F.col("event_id") % 2 == 0).alias("is_deterministic"), (F.col("value") > 50).alias("answer"), F.lit(0.9).alias("answer_confidence"))
    return state.judged(state.breaker(calls, "user_id", "event_id")).select("event_id", "is_issue", "confidence")


@query("""WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events QUALIFY n <= 3),
t AS (SELECT user_id, coalesce(min(n) FILTER (event_type = 'purchase'), max(n)) AS tried, count(*) FILTER (event_type = 'purchase') = 0 AS failed, CAST(arg_min(event_id,
n) FILTER (event_type = 'purchase') AS VARCHAR) AS answer FROM a GROUP BY 1)
SELECT user_id, CAST(tried AS INT) AS tried, CAST(0.25 * (tried - 1) * tried AS DOUBLE) AS waited_s, failed, answer FROM t""")
def judge_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "purchase").alias("failed"), F.col("event_id").cast("string").alias("answer"))
    return judge.retried(attempts, "user_id", "event_id")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS is_issue, CAST(CASE p_partkey % 5 WHEN 0 THEN 0.5 WHEN
1 THEN 0.25 END AS DOUBLE) AS confidence, CASE p_partkey % 5 WHEN 0 THEN p_name END AS reasoning FROM part""")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a fence marked json, in a plain one, and bare; then prose, and JSON without a verdict."""
    parts = table(spark, sf_dir, "part")
    kinds = (
        F.concat(F.lit('Sure.\n```json\n{"is_issue": true, "confidence": 0.5, "reasoning": "'), "p_name", F.lit('"}\n```\nBye ```x```')), F.lit('```\n{"is_issue": false, "confidence": 0.25}\n```'),
        F.lit(' {"is_issue": true} '), F.lit("I can not tell."), F.lit('{"reasoning": "none"}'),
    )
    answer = F.element_at(F.array(*kinds), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    return parts.withColumn("v", judge.verdict(answer)).select("p_partkey", "v.is_issue", "v.confidence", "v.reasoning")


@query("""WITH t AS (SELECT p_partkey, p_name, p_brand, ['security', 'performance', 'logic', 'style'][CAST(p_partkey % 4 AS INT) + 1] AS category FROM part)
SELECT p_partkey, E'Is this a real issue in the code below, or a false alarm?\\nCategory: ' || category || E'\\nIssue: ' || p_name || ' - ' || p_brand
|| E'\\nCode (python):\\n```\\nx = 1\\n```\\nAnswer in JSON: {"is_issue": true or false, "confidence": 0.0 to 1.0, "reasoning": "..."}' AS judgment,
E'Change the code below as little as possible so that this issue is gone.\\nIssue: ' || p_name || ' (' || category || E', major)\\n' || p_brand || E'\\nCode (python):\\n```\\nx = 1\\n```\\nAnswer in JSON: {"fix_code": "..."}'
AS fix,
'Review the code below for ' || CASE category WHEN 'security' THEN 'unsafe use of input, secrets and permissions' WHEN 'performance' THEN 'needless work in loops and slow calls'
WHEN 'logic' THEN 'wrong conditions, bounds and states' ELSE 'correctness and clarity' END ||
E'.\\nLanguage: python\\n```\\nx = 1\\n```' AS review FROM t""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = _pick(["security", "performance", "logic", "style"], F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("description"), category.alias("category"), F.lit("major").alias("severity"), F.lit("python").alias("language"), F.lit("x = 1").alias("snippet"))
    return rows.select("p_partkey", judge.judgment_prompt().alias("judgment"), judge.fix_prompt().alias("fix"), judge.review_prompt().alias("review"))


_SIMILAR = ORACLE_SQL["find_similar"]


@query(f"""WITH s AS (SELECT snippet_id, file, line_no, round(similarity, 2) AS similarity FROM ({_SIMILAR}))
SELECT *, CAST(row_number() OVER (PARTITION BY snippet_id ORDER BY similarity DESC, file, line_no) AS INT) AS rank FROM s""")
def ranked_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir).select(F.col("diff_id").alias("file"), F.col("line_start").alias("line_no"), "line")
    found = search.similar_lines(lines, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("snippet_id"), "text"))
    return search.ranked_similar_lines(found.withColumn("similarity", F.round("share", 2))).select("snippet_id", "file", "line_no", "similarity", "rank")


@query("""SELECT s_suppkey AS diff_id, unnest(['src/' || replace(s_name, '#', '_') || '.py', 'README.md']) AS path FROM supplier""")
def git_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("src/"), F.replace("s_name", F.lit("#"), F.lit("_")), F.lit(".py\n\nREADME.md\n"))
    return git.changed_files(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("diff_id"), text.alias("text")))


@query("""SELECT s_name AS file, unnest([1, 2, 3]) AS line, left(unnest([sha1(s_name), sha1('x' || s_name), sha1(s_name)]), 8) AS "commit", unnest([s_name, 'Eve',
s_name]) AS author, unnest([s_suppkey, s_suppkey + 60, s_suppkey]) AS seconds FROM supplier""")
def git_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blamed(spark, sf_dir).select("file", "line", "commit", "author", F.unix_timestamp("time").alias("seconds"))


def _blamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit that is told once and has lines before and after another's."""
    one, two, at = F.sha1("s_name"), F.sha1(F.concat(F.lit("x"), "s_name")), F.col("s_suppkey")
    told = lambda author, time: F.concat(F.lit("\nauthor "), author, F.lit("\nauthor-time "), time.cast("string"), F.lit("\nsummary x"))
    text = F.concat(one, F.lit(" 1 1 1"), told(F.col("s_name"), at), F.lit("\n\ta = 1\n"), two, F.lit(" 1 2 1"), told(F.lit("Eve"), at + 60), F.lit("\n\tb = 2\n"), one, F.lit(" 2 3 1\n\tc = 3\n"))
    return git.blame(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("file"), text.alias("text")))


@query("""SELECT DISTINCT s_name AS file, l_linenumber AS line, left(CASE l_linenumber WHEN 2 THEN sha1('x' || s_name) ELSE sha1(s_name) END, 8) AS "commit",
CASE l_linenumber WHEN 2 THEN 'Eve' ELSE s_name END AS author FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 3""")
def blamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote the lines that items point at: each is told once however many items there are, and those beyond a file's end are left out."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("file"))
    wanted = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("line")).distinct().join(suppliers, "l_suppkey")
    return git.blame_lines(wanted, _blamed(spark, sf_dir)).select("file", "line", "commit", "author")


_ANNOTATIONS, _TYPES = ("int", "float64", "str", "boolean", "nil"), "['Int', 'Float', 'String', 'Bool', 'Null']"


@query(f"""WITH t AS (SELECT c_custkey, {_TYPES} AS y, c_custkey % 5 + 1 AS i, c_custkey // 5 % 5 + 1 AS j, c_custkey // 25 % 5 + 1 AS k, c_custkey // 125 % 3 AS form FROM customer),
u AS (SELECT c_custkey, form, CASE form WHEN 0 THEN 'Optional[' || y[i] || ']' WHEN 1 THEN 'Union[' || y[i] || ', ' || y[j] || ']' ELSE 'Union[Optional[' || y[i] || '], ' || y[j] || ']' END AS a,
y[k] AS b, y[i] = y[k] AS first, y[j] = y[k] OR (y[j] IN ('Int', 'Float') AND y[k] IN ('Int', 'Float')) AS second, y[i] IN ('Int', 'Float') AND y[k] IN ('Int', 'Float') AS numbers FROM t)
SELECT c_custkey, a, b, CASE form WHEN 0 THEN first OR b = 'Null' WHEN 1 THEN first OR numbers OR second ELSE first OR b = 'Null' OR second END AS compatible FROM u""")
def type_compat_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional types, unions, and unions of optional types against plain ones, from either side."""
    key, known = F.col("c_custkey"), F.array(*map(F.lit, _ANNOTATIONS))
    i, j, k = (F.get(known, (F.floor(key / n) % 5).cast("int")) for n in (1, 5, 25))
    form = F.floor(key / 125) % 3
    a = F.when(form == 0, F.concat(F.lit("Optional["), i, F.lit("]"))).when(form == 1, F.concat(F.lit("Union["), i, F.lit(","), j, F.lit("]")))
    a = a.otherwise(F.concat(F.lit("Union[Optional["), i, F.lit("], "), j, F.lit("]")))
    typed = table(spark, sf_dir, "customer").select("c_custkey", types.annotation_type(a).alias("a"), types.annotation_type(k).alias("b"))
    turned = F.col("c_custkey") % 2 == 0
    left, right = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    return typed.withColumn("compatible", types.types_compatible(left, right))


@query("""SELECT left(sha1(c_name), 8) AS hash, c_name AS author, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '@x' ELSE '' END AS email, '' AS date, '' AS subject FROM customer""")
def git_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\n"), "c_mktsegment", F.lit("@x"))).otherwise("")
    return git.commits(table(spark, sf_dir, "customer").select(F.concat(F.sha1("c_name"), F.lit("\n"), "c_name", email).alias("text")))


@query("""SELECT n_name AS file, CAST(n AS INT) AS pos, left(sha1(n_name || n), 7) AS hash, CASE WHEN n % 4 = 0 THEN '' ELSE 'change ' || n END AS message FROM nation,
(SELECT unnest(range(1, 11)) AS n)""")
def git_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve commits a file, of which ten are kept."""
    line = lambda n: F.concat(F.left(F.sha1(F.concat("n_name", n.cast("string"))), F.lit(7)), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit(" change "), n.cast("string"))))
    log = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), line), "\n")
    return git.history(table(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), log.alias("text")))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.struct(F.col("n_name").alias("file"), F.col("n_nationkey").alias("line"), F.lit("security").alias("category"), F.lit("major").alias("severity"))
    other = F.struct(F.lit("z").alias("file"), F.lit(7).alias("line"), F.lit("style").alias("category"), F.lit("info").alias("severity"))
    none = F.lit(None).cast("string")
    samples = F.array(F.struct(F.col("n_name").alias("diff"), F.lit("c").alias("code"), F.lit("go").alias("language")), F.struct(none.alias("diff"), F.lit("code").alias("code"), none.alias("language")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("set_id"), F.to_json(F.struct(F.array(truth, other).alias("ground_truth"), samples.alias("samples"))).alias("value"))


@query("""
SELECT n_nationkey AS set_id, n_name AS file, n_nationkey AS line, 'security' AS category, 'major' AS severity, CAST(0 AS INT) AS gt_seq FROM nation UNION
ALL SELECT n_nationkey, 'z', 7, 'style', 'info', 1 FROM nation""")
def testset_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testsets.parse(_sets(spark, sf_dir))[0]


@query("SELECT n_nationkey AS set_id, CAST(0 AS INT) AS sample_id, n_name AS diff_content, 'go' AS language FROM nation UNION ALL SELECT n_nationkey, 1, 'code', '' FROM nation")
def testset_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testsets.parse(_sets(spark, sf_dir))[1]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each even part, one in another language for the odd ones."""
    key, name = F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_"))
    python = F.concat(F.lit("import os\n\nclass A"), key, F.lit(":\n    def inner(self):\n        return 1\n\ndef "), name, F.lit("(a: int) -> str:\n    return inner(a)\n\nlimit: int = 3\n"))
    other = F.concat(F.lit("class B"), key, F.lit(" {\n}\n// def "), name, F.lit("\n"))
    even = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), key, F.when(even, ".py").otherwise(".js")).alias("path"), F.when(even, python).otherwise(other).alias("source"))


_SYMBOLS = """WITH t AS (SELECT p_partkey, replace(p_name, ' ', '_') AS f FROM part), s AS (
SELECT 'import os' AS name, 'import' AS kind, p_partkey, 1 AS line_start, 1 AS line_end, 'import os' AS signature, NULL AS return_type FROM t WHERE p_partkey
% 2 = 0
UNION ALL SELECT 'A' || p_partkey, 'class', p_partkey, 3, 5, 'class A' || p_partkey || ':', NULL FROM t WHERE p_partkey % 2 = 0 UNION ALL SELECT f, 'function',
p_partkey, 7, 8, 'def ' || f || '(a: int) -> str:', 'str' FROM t WHERE p_partkey % 2 = 0
UNION ALL SELECT 'limit', 'variable', p_partkey, 10, 10, 'limit: int = 3', 'int' FROM t WHERE p_partkey % 2 = 0 UNION ALL SELECT 'B' || p_partkey, 'class',
p_partkey, 1, 1, 'class B' || p_partkey, NULL FROM t WHERE p_partkey % 2 = 1
UNION ALL SELECT f, 'function', p_partkey, 3, 3, 'def ' || f, NULL FROM t WHERE p_partkey % 2 = 1)
SELECT name, kind, 'p' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.js' END AS file, CAST(line_start AS INT) AS line_start, CAST(line_end
AS INT) AS line_end, signature, return_type FROM s"""


@query(_SYMBOLS)
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By syntax tree where the file is Python, by pattern elsewhere; what stands inside a class is not visited."""
    return symbols.symbols(_sources(spark, sf_dir)).drop("visibility")


@query(f"SELECT name, kind, line_start FROM ({_SYMBOLS}) WHERE file = 'p8.py'")
def symbols_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbols_in_file(_sources(spark, sf_dir), "p8.py").select("name", "kind", "line_start")


@query("SELECT p_partkey, p_partkey % 3 <> 0 OR p_partkey % 2 = 1 AS parses FROM part")
def fixed_code_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("p_partkey") % 3 == 0, F.concat("source", F.lit("def (:\n"))).otherwise(F.col("source"))
    return _sources(spark, sf_dir).select("p_partkey", symbols.parses(F.col("path"), broken).alias("parses"))


@query("""SELECT 'p' || p_partkey || '.py' AS file_path, CAST(8 AS INT) AS line, 'inner' AS callee, replace(p_name, ' ', '_') AS caller FROM part WHERE p_partkey % 2 = 0""")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the nearest definition before them."""
    lines = _sources(spark, sf_dir).select(F.col("path").alias("file_path"), F.posexplode(F.split("source", "\n", -1)).alias("pos", "text"))
    return graph.call_sites(lines.select("file_path", (F.col("pos") + 1).alias("line"), "text"))


@query(f"""WITH f AS (SELECT p_partkey, 'p' || p_partkey || '.py' AS file, replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 2 = 0),
last AS (SELECT 'inner' AS name, max(file) AS file FROM f)
SELECT f.name AS caller, f.file AS caller_file, last.name AS callee, last.file AS callee_file, CAST(8 AS INT) AS line FROM f, last""")
def source_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From source files to the edges of the call graph: call sites and definitions by pattern, each call with the innermost symbol around it.

    What is defined more than once, as the method ``inner`` is in every file, is the last file's.
    """
    lines = _sources(spark, sf_dir).filter("path LIKE '%.py'").select(F.col("path").alias("file_path"), F.posexplode(F.split("source", "\n", -1)).alias("pos", "text"))
    edges, defined = graph.source_calls(lines.select("file_path", (F.col("pos") + 1).alias("line"), "text"))
    side = lambda at: defined.select(F.col("id").alias("src" if at == "caller" else "dst"), F.col("name").alias(at), F.col("file_path").alias(f"{at}_file"))
    return edges.join(side("caller"), "src").join(side("callee"), "dst").select("caller", "caller_file", "callee", "callee_file", "line")


_BLOCKS = """blocks AS (SELECT n_name AS function, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) + 1 AS INT) AS id, 'Statement' AS kind, c_mktsegment
AS label, CAST(c_custkey % 50 AS INT) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey),
whole AS (SELECT * FROM blocks UNION ALL SELECT DISTINCT function, 0, 'Entry', 'entry', 0 FROM blocks UNION ALL SELECT DISTINCT function, 1, 'Exit', 'exit',
0 FROM blocks)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return graph.cfg_blocks(rows.select(F.col("n_name").alias("function"), F.lit("Statement").alias("kind"), F.col("c_mktsegment").alias("label"), (F.col("c_custkey") % 50).cast("int").alias("line"), F.col("c_custkey").alias("seq")))


@query(f"WITH {_BLOCKS} SELECT function, id, label AS name, kind, line FROM whole")
def cfg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return graph.cfg_graph(blocks, blocks.select("function", F.col("id").alias("src"), F.col("id").alias("dst")))[0]


@query(f"WITH {_BLOCKS} SELECT DISTINCT function, CAST(id // 2 AS INT) AS src, id AS dst, 'control_flow' AS kind FROM whole WHERE id > 0")
def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    edges = blocks.filter("id > 0").select("function", F.floor(F.col("id") / 2).cast("int").alias("src"), F.col("id").alias("dst"))
    return graph.cfg_graph(blocks, edges.unionByName(edges))[1]


@query(f"""
WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(11 AS BIGINT) AS id UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.id) SELECT bool_or(id = (SELECT max(c_custkey)
FROM customer)) AS exit_reachable FROM r""")
def exit_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    return graph.exit_reachable(customer_edges(spark, sf_dir), seed(spark, 11), last)


@query("SELECT s_suppkey AS id, s_name || ' (' || s_nationkey || '.py:' || s_suppkey || ')' AS label FROM supplier")
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.col("s_nationkey").cast("string"), F.lit(".py")).alias("file_path"), F.col("s_suppkey").alias("line"))
    return graph.labels(nodes)


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS function, l_returnflag AS variable, l_linenumber AS id FROM lineitem), top AS (SELECT function, max(id) AS top
FROM d GROUP BY 1),
r AS (SELECT a.function, a.id, list_sort(list_distinct(list(b.id) FILTER (b.id = a.id OR (b.id <> t.top AND NOT EXISTS (SELECT 1 FROM d k WHERE k.function
= a.function AND k.variable = a.variable AND k.id = b.id))))) AS ids
FROM d a JOIN d b ON a.function = b.function JOIN top t ON a.function = t.function GROUP BY a.function, a.id, a.variable)
SELECT o_orderkey AS function, p.id, array_to_string(coalesce(ids, []), ',') AS reaching_ids FROM orders, (SELECT CAST(unnest(range(1, 8)) AS INT) AS id) p
LEFT JOIN r ON o_orderkey = r.function AND r.id = p.id""")
def reaching_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions that reach each of the seven points that an order may have."""
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("function"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("id"))
    out = dataflow.reaching_at(dataflow.reaching(order_definitions(spark, sf_dir)), points)
    return out.select("function", "id", F.array_join(F.col("reaching_ids").cast("array<string>"), ",").alias("reaching_ids"))


@query("""WITH d AS (SELECT user_id AS function, event_type AS variable, event_id AS id, ['request.args', 'os.environ', 'cursor.execute(q)', 'html.escape(x)', 'sys.argv',
'eval(x)', 'print(x)'][CAST(event_id % 7 AS INT) + 1] AS v FROM events),
u AS (SELECT DISTINCT user_id AS function, unnest(['purchase', 'view', 'signup', 'error', 'click', 'nowhere']) AS variable FROM events), s AS (SELECT function, variable, array_to_string(list(v
ORDER BY id), '|') AS sources FROM d GROUP BY 1, 2)
SELECT u.function, u.variable, coalesce(sources, '') AS sources FROM u LEFT JOIN s USING (function, variable)""")
def trace_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_definitions(spark, sf_dir)
    uses = d.select("function").distinct().withColumn("variable", F.explode(F.array(*map(F.lit, ("purchase", "view", "signup", "error", "click", "nowhere")))))
    return dataflow.trace_to_source(d, uses).select("function", "variable", F.array_join(F.transform("sources", lambda s: s["source_value"]), "|").alias("sources"))


_ENV = """a AS (SELECT user_id AS scope, event_type AS variable, event_id AS seq, ['Int', 'String', 'Any'][CAST(event_id % 3 AS INT) + 1] AS type FROM events),
env AS (SELECT scope, variable, arg_max(type, seq) AS type FROM a GROUP BY 1, 2)"""


def _environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _pick(["Int", "String", "Any"], F.col("event_id"))
    return types.environment(table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("variable"), F.col("event_id").alias("seq"), kinds.alias("type")))


@query(f"""
WITH {_ENV} SELECT scope, variable, coalesce(type, 'Any') AS type FROM (SELECT DISTINCT scope, unnest(['purchase', 'view', 'signup', 'error', 'click', 'unheard']) AS variable FROM a)
LEFT JOIN env USING (scope, variable)""")
def type_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = _environment(spark, sf_dir)
    names = table(spark, sf_dir, "events").select(F.col("user_id").alias("scope")).distinct()
    return types.types_of(env, names.withColumn("variable", F.explode(F.array(*map(F.lit, ("purchase", "view", "signup", "error", "click", "unheard"))))))


@query(f"WITH {_ENV} SELECT scope, variable FROM env WHERE type = 'Any'")
def uncertain_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.uncertain(_environment(spark, sf_dir))


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events as entries, and an entry for each customer in good standing."""
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("function_name"), F.col("event_type").alias("hash"), F.col("ts").alias("inserted_at"), F.col("event_id").alias("seq"))
    people = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    last = entries.agg(F.max("inserted_at").alias("at"))
    new = people.join(last).select(F.col("c_custkey").alias("function_name"), F.col("c_mktsegment").alias("hash"), F.col("at").alias("inserted_at"), F.lit(0).cast("long").alias("seq"))
    return entries, new


@query("""SELECT user_id AS function_name, event_type AS hash, event_id AS seq FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT c_custkey, c_mktsegment, 0 FROM customer WHERE c_acctbal >= 0""")
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cache_put(*_cache(spark, sf_dir)).select("function_name", "hash", "seq")


@query("SELECT user_id AS function_name, event_id AS seq FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def cache_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of keys goes with all of their entries."""
    entries, new = _cache(spark, sf_dir)
    return state.invalidate(entries, new).select("function_name", "seq")


@query("""SELECT count(*) AS cached_functions FROM (SELECT c_custkey AS f FROM customer WHERE c_acctbal >= 0 UNION SELECT user_id FROM
(SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND)""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, new = _cache(spark, sf_dir)
    now = entries.agg(F.max("inserted_at")).first()[0]
    return state.cache_stats(state.cache_put(entries, new), F.lit(now))


def _rates_sql(name: str) -> str:
    return f"""SELECT '{name}' AS period, CAST(date_trunc('{metrics.PERIODS[name]}', ts) AS TIMESTAMP) AS period_start, count(*) AS total_reviews, CAST(sum(event_id %
7) AS BIGINT) AS total_findings, CAST(sum(event_id % 3) AS BIGINT) AS llm_calls,
coalesce(round(sum(CAST(event_type = 'purchase' AS INT)) * 100.0::DOUBLE / nullif(sum(event_id % 7), 0), 2), 0) AS adoption_rate, coalesce(round(sum(event_id
% 2) * 100.0::DOUBLE / nullif(sum(event_id % 5), 0), 2), 0) AS auto_fix_pass_rate FROM events GROUP BY 2"""


def _rates(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    n = F.col("event_id")
    reviews = table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), (n % 7).alias("findings"), (n % 3).alias("llm_calls"), (F.col("event_type") == "purchase").cast("int").alias("adopted"), (n % 5).alias("fixes"), (n % 2).alias("fixes_passed"))
    return metrics.period_rates(reviews, name).withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query(_rates_sql("weekly"))
def period_rates_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, "weekly")


@query(f"SELECT * FROM ({_rates_sql('daily')}) ORDER BY period_start DESC LIMIT 10")
def newest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.newest_metrics(_rates(spark, sf_dir, "daily"), "daily")


@query("""SELECT event_id, format('{:.1f}', round(event_id % 9000 / 1000.0::DOUBLE + 1e-9, 1)) || 's' AS shown, CAST(event_id % 101 AS VARCHAR) || '%' AS sure, left(sha256(event_type),
8) || '-' || substr(sha256(event_type), 9, 3) AS review_id,
CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE '' END AS created, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000 AS took
FROM events""")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", formats.seconds((n % 9000) + 1e-6).alias("shown"), formats.percent((n % 101) / 100.0).alias("sure"), formats.review_id(F.col("event_type")).alias("review_id"),
        formats.iso_or_empty(F.when(n % 2 == 0, ts)).alias("created"), formats.elapsed_ms(F.date_trunc("day", ts), ts).alias("took"),
    )


_GREEDY = """WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS seq FROM lineitem),
t AS (SELECT l_orderkey AS file, l_linestatus AS category, list({{'line': l_linenumber, 'seq': seq}} ORDER BY seq) AS ts FROM i WHERE l_returnflag = 'R'
GROUP BY 1, 2),
p AS (SELECT l_orderkey AS file, l_linestatus AS category, l_linenumber AS line, seq, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY
seq) AS n FROM i WHERE l_discount > 0.05),
r AS (SELECT file, category, ts, CAST([] AS BIGINT[]) AS used, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pred_seq, CAST(NULL AS BIGINT) AS gt_seq
FROM t
UNION ALL SELECT file, category, ts, CASE WHEN m IS NULL THEN used ELSE list_append(used, m) END, n, pred_seq, m
FROM (SELECT r.file, r.category, r.ts, r.used, p.n, p.seq AS pred_seq, list_filter(r.ts, lambda x: abs(x.line - p.line) <= 3 AND NOT list_contains(r.used,
x.seq))[1].seq AS m FROM r JOIN p ON r.file = p.file AND r.category = p.category AND p.n = r.n + 1))
SELECT file, category, pred_seq, gt_seq FROM r WHERE gt_seq IS NOT NULL""".format(
    order="l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax"
)
ORACLE_SQL["eval_greedy"] = _GREEDY

__all__ = ["QUERIES"]
