"""The corpus operators as queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, filter_audit, fingerprint, language_id, line_dedup, mixing, near_dup, packing, token_count, token_output, topk, toxicity, url_filter
from .common import table, written


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return judged.withColumn("score", F.round("score", 6))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    sources = mixing.ranked_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    mixed = mixing.mix(sized, mixing.water_fill(sources))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults: by crc32 of ``conv_id:turn`` a row in twenty is dropped, emptied, loses its full stops, is repeated, or becomes the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = (F.crc32(key.cast("binary")) % 20).alias("fault")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault).filter("fault <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(damaged(rows), rows)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest,
'^[^/?#]*([^?#]*)', 1) AS path,
         '~~' || regexp_replace(translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0/._?=&#%:\-]', '~',
'g') AS m,
         CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 5 AS fold FROM split),
ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path,
'/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule, row_number() OVER () AS rid FROM parts),
verdicts AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM ruled),
spots AS (SELECT rid, ruled, fold, m, unnest(range(3, length(m) + 1)) AS i FROM verdicts),
cells AS (
  SELECT rid, ruled, fold, (instr(a, substr(m, i - 2, 1)) - 1) * 1444 + (instr(a, substr(m, i - 1, 1)) - 1) * 38 + instr(a, substr(m, i, 1)) - 1 AS cell
  FROM spots, (SELECT 'abcdefghijklmnopqrstuvwxyz0/.-_?=&#%:~' AS a)),
seen AS (SELECT cell, count(*) FILTER (ruled = 'allow') AS n, count(*) FILTER (ruled = 'block') AS k FROM cells WHERE ruled IS NOT NULL AND fold <> 0 GROUP
BY cell),
grid AS (
  SELECT g.range AS cell, side, CAST(coalesce(CASE side WHEN 'allow' THEN n ELSE k END, 0) AS DOUBLE) AS n
  FROM range(54872) g LEFT JOIN seen ON g.range = seen.cell CROSS JOIN (VALUES ('allow'), ('block')) s(side)),
last0 AS (SELECT side, cell % 38 AS c, sum(n) AS n FROM grid GROUP BY 1, 2),
p0 AS (SELECT side, c, CASE WHEN sum(n) OVER w > 0 THEN (n + count(*) FILTER (n > 0) OVER w * (1.0::DOUBLE / 38)) / (sum(n) OVER w + count(*) FILTER (n
> 0) OVER w) ELSE 1.0::DOUBLE / 38 END AS p FROM last0 WINDOW w AS (PARTITION BY side)),
last1 AS (SELECT side, cell % 1444 AS c, sum(n) AS n FROM grid GROUP BY 1, 2),
p1 AS (
  SELECT l.side, l.c, CASE WHEN sum(n) OVER w > 0 THEN (n + count(*) FILTER (n > 0) OVER w * p) / (sum(n) OVER w + count(*) FILTER (n > 0) OVER w) ELSE
p END AS p
  FROM last1 l JOIN p0 ON l.side = p0.side AND l.c % 38 = p0.c WINDOW w AS (PARTITION BY l.side, l.c // 38)),
p2 AS (
  SELECT g.side, g.cell, CASE WHEN sum(n) OVER w > 0 THEN (n + count(*) FILTER (n > 0) OVER w * p) / (sum(n) OVER w + count(*) FILTER (n > 0) OVER w) ELSE
p END AS p
  FROM grid g JOIN p1 ON g.side = p1.side AND g.cell % 1444 = p1.c WINDOW w AS (PARTITION BY g.side, g.cell // 38)),
gains AS (SELECT a.cell, ln(a.p) - ln(b.p) AS gain FROM p2 a JOIN p2 b ON a.cell = b.cell AND a.side = 'allow' AND b.side = 'block'),
means AS (SELECT rid, avg(gain) AS score FROM cells JOIN gains USING (cell) GROUP BY rid),
scored AS (SELECT v.*, coalesce(score, 0) AS score FROM verdicts v LEFT JOIN means USING (rid)),
bins AS (SELECT greatest(least(floor(score * 100), 400), -400) AS step, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS
bad FROM scored WHERE ruled IS NOT NULL AND fold = 0 GROUP BY 1),
cuts AS (
  SELECT c, round((SELECT coalesce(sum(good), 0) FROM bins WHERE step >= c) / (SELECT sum(good) FROM bins) + (SELECT coalesce(sum(bad), 0) FROM bins WHERE
step < c) / (SELECT sum(bad) FROM bins), 12) AS worth
  FROM (SELECT step AS c FROM bins UNION SELECT 0)),
cut AS (SELECT CASE WHEN (SELECT sum(good) FROM bins) > 0 AND (SELECT sum(bad) FROM bins) > 0 THEN (SELECT c FROM cuts ORDER BY worth DESC, abs(c), c LIMIT
1) ELSE 0 END / 100 AS cut)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= (SELECT cut FROM cut) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS
score FROM scored
"""

OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS BIGINT) AS weight FROM sources),
running AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS BIGINT) AS left_size,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS left_weight
  FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * left_weight <= weight * left_size AS clamped FROM running),
free AS (SELECT left_size AS fs, left_weight AS fw FROM marked WHERE NOT clamped ORDER BY CAST(cap AS DOUBLE) / weight, left_size LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (SELECT fs FROM free) AS DOUBLE) / (SELECT fw FROM free) END AS target
  FROM marked),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole, CAST(round(s.target) AS BIGINT) - s.whole * s.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', '17', CAST(d.doc_id AS VARCHAR))), d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(least(rest - before, size), 0) AS BIGINT) AS taken FROM ordered
"""

OP5_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS
w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i :
i + 3], ' '))) END AS s FROM worded),
each AS MATERIALIZED (SELECT doc_id, unnest(s) AS h FROM shingled),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingled),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM each a JOIN each b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM sizes LEFT JOIN least ON a = doc_id
"""

OP7_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS rid FROM documents),
keyed AS (
  SELECT *, list_transform(lines, lambda l: translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz')) AS keys FROM d),
each AS (SELECT rid, unnest(list_distinct(keys)) AS key FROM keyed),
common AS MATERIALIZED (SELECT key FROM each WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10),
gone AS (SELECT rid, list(key) AS gone FROM each SEMI JOIN common USING (key) GROUP BY rid),
told AS (
  SELECT doc_id, lines, coalesce(gone, []) AS gone, list_filter(lines, lambda l, i: NOT list_contains(coalesce(gone, []), keys[i])) AS kept
  FROM keyed LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM told
"""

OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)),
keyed AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS k
  FROM conversations),
struck AS (
  SELECT c, turn, role, text, xor(list_reduce(list_prepend(4294967295, k), lambda v, b: xor(t[(xor(v, b) & 255) + 1], v >> 8)), 4294967295) % 20 AS f FROM keyed, crc),
rows AS (
  SELECT c, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM struck, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows),
seen AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS following FROM placed),
turns AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more, count(*) OVER (PARTITION BY c) AS n FROM seen),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY c),
back(c, i, d) AS (
  SELECT DISTINCT c, n + 1, [0, 6, 3, 0] FROM turns
  UNION ALL
  SELECT c, i, [least(b[1], 3 + least(b[3], 3 + b[4])), least(b[2], 3 + least(b[3], 3 + b[4])), least(b[3], 3 + b[4]), least(b[4], 3 + b[3])] FROM (
    SELECT t.c, t.i, CASE WHEN gone THEN [4 + d[1], 4 + d[2], 4 + d[3], 4 + d[4]] ELSE [
      least(4 + d[1], 3 + more + d[3], CASE initial WHEN 's' THEN more + d[2] WHEN 'u' THEN more + d[3] ELSE 99999999 END),
      least(4 + d[2], 3 + more + d[3], CASE initial WHEN 'u' THEN more + d[3] ELSE 99999999 END),
      least(4 + d[3], 3 + more + d[4], CASE initial WHEN 'a' THEN more + d[4] ELSE 99999999 END),
      least(4 + d[4], 3 + more + d[3], CASE initial WHEN 'u' THEN more + d[3] ELSE 99999999 END)] END AS b
    FROM back JOIN turns t ON t.c = back.c AND t.i = back.i - 1)),
nodes AS MATERIALIZED (
  SELECT x.c, x.i, x.d, y.d AS e, role, text, initial, more FROM back x LEFT JOIN back y ON y.c = x.c AND y.i = x.i + 1 LEFT JOIN turns t ON t.c = x.c AND t.i = x.i),
walk(c, i, st, k, edit, piece) AS (
  SELECT DISTINCT c, CAST(1 AS BIGINT), 1, 0, '', CAST(NULL AS VARCHAR) FROM turns
  UNION ALL
  SELECT c, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN st WHEN 'K' THEN CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE
    CASE st WHEN 3 THEN 4 ELSE 3 END END, k + 1, edit, CASE edit WHEN 'K' THEN role || ':' || text WHEN 'R' THEN CASE st WHEN 3 THEN 'assistant:' ELSE 'user:' END || text
    WHEN 'I' THEN CASE st WHEN 3 THEN 'assistant:' ELSE 'user:' END END
  FROM (
    SELECT n.*, st, k, CASE WHEN d[st] = 4 + e[st] THEN 'D' WHEN d[st] = 3 + d[CASE st WHEN 3 THEN 4 ELSE 3 END] THEN 'I'
      WHEN d[st] = more + e[CASE WHEN initial = 's' AND st = 1 THEN 2 WHEN initial = 'u' AND st <> 3 THEN 3 WHEN initial = 'a' AND st = 3 THEN 4 END] THEN 'K' ELSE 'R' END AS edit
    FROM walk w JOIN nodes n ON n.c = w.c AND n.i = w.i WHERE n.e IS NOT NULL OR st IN (2, 3))),
told AS (SELECT c, string_agg(edit, '' ORDER BY k) AS audit, sha256(coalesce(string_agg(piece, chr(10) ORDER BY k), '')) AS sha FROM walk GROUP BY c),
costs AS (SELECT c, d[1] AS cost FROM back WHERE i = 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS c FROM conversations) LEFT JOIN counts USING (c) LEFT JOIN costs USING (c) LEFT JOIN told USING (c)
"""

OP13_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
masked AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM worded),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, count(*) AS n FROM masked LEFT JOIN said USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps AS (
  SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1 : k - 1]), 0) AS INT) AS before FROM orders, range(1, 6) r(k)),
joined AS (SELECT part, filter_order, step, mask, good, bad, n, bit, mask & bit > 0 AS fails, mask & before > 0 AS earlier FROM counted, steps)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT
  earlier), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS
  BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (fails AND NOT earlier AND good = 1), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (fails AND
  NOT earlier AND bad = 1), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM joined GROUP BY part, filter_order, step
"""

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_token_output": op9_token_output,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}

ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op3_mixing": OP3_SQL, "op5_minhash_near_dedup": OP5_SQL, "op7_exact_top_k": OP7_SQL, "op11_line_dedup": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_filter_audit": OP13_SQL}
