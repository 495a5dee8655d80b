"""The rule scan: every line, or every file, against the catalogue in one narrow pass."""

from __future__ import annotations

import json
import warnings

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import RULE_COLUMNS, RULES, SUPPRESSIONS, TEST_MARKERS
from .rounds import kept

FLAGS = "(?imdU)"  # case-insensitive, multi-line, \n alone ends a line, Unicode classes
RULE_DICTS = tuple(dict(zip(RULE_COLUMNS, r, strict=True)) for r in RULES)


def active_rules(rules=RULE_DICTS, disabled: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[dict]:
    """Rules with a pattern that are deterministic and not ``disabled``; of ``only`` these where given."""
    return [r for r in rules if r["is_deterministic"] and r["pattern"] and r["rule_id"] not in disabled and (not only or r["rule_id"] in only)]


def file_scoped(rule: dict) -> bool:
    """A pattern that names a line end, or has one, is matched over whole files."""
    return r"\n" in rule["pattern"] or "\n" in rule["pattern"]


def usable(spark: SparkSession, rules: list[dict]) -> list[dict]:
    """The rules whose pattern is valid; the others are left out, with a warning."""
    out = []
    for rule in rules:
        try:
            spark._jvm.java.util.regex.Pattern.compile(FLAGS + rule["pattern"])
        except IllegalArgumentException as e:
            warnings.warn(f"rule {rule['rule_id']} is not used: {e}", stacklevel=3)
        else:
            out.append(rule)
    return out


def _gate(rule: dict, language: Column) -> Column:
    return F.lit(True) if rule["language"] == "all" else language.eqNullSafe(rule["language"])


def _described(rule: dict) -> list[Column]:
    title = f"[{rule['rule_id']}] {rule['name']}"
    return [F.lit(rule[c]).cast("string").alias(c) for c in ("rule_id", "category", "severity", "description", "cwe_id", "owasp_category")] + [F.lit(title).alias("title")]


#: Characters beyond ASCII that a pattern's letters match too when the case is ignored, and these letters.
FOLDS = ("\u017f\u212a\u0130\u0131", "skii")


def needles(pattern: str) -> frozenset[str] | None:
    """Lower-case strings of which any text that the pattern matches, lower-cased, holds one; None where none can be told."""
    from re import _parser as parser
    from re import error

    def best(sets):
        sets = [s for s in sets if s]
        return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    def of(sequence):
        runs, sets = [""], []
        for op, value in sequence:
            if str(op) == "LITERAL" and value < 128:
                runs[-1] += chr(value).lower()
                continue
            runs.append("")
            if str(op) == "BRANCH":
                parts = [of(p) for p in value[1]]
                sets.append(frozenset().union(*parts) if all(parts) else None)
            elif str(op) == "SUBPATTERN":
                sets.append(of(value[-1]))
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                sets.append(of(value[2]))
        return best([*sets, *(frozenset([r]) for r in runs if r)])

    try:
        return of(parser.parse(pattern))
    except (error, ValueError, ArithmeticError, LookupError):
        return None


def _may_match(rule: dict, lowered: Column) -> Column:
    parts = needles(rule["pattern"]) or ()
    out = F.lit(not parts)
    for part in sorted(parts):
        out = out | lowered.contains(part)
    return out


def scan_lines(lines: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Findings of the line-scoped rules in ``lines`` (line, language, any more): one a rule and line. One pass, no shuffle; a null line has none.

    A rule's pattern is only tried on lines that hold a string which each of its matches holds.
    """
    rules = usable(lines.sparkSession, [r for r in (active_rules() if rules is None else rules) if not file_scoped(r)])
    lowered = lines.withColumn("_lowered", F.lower(F.translate("line", *FOLDS)))
    hits = [F.when(_gate(r, F.col("language")) & _may_match(r, F.col("_lowered")) & F.col("line").rlike(FLAGS + r["pattern"]), F.struct(*_described(r))) for r in rules]
    if not hits:
        return lines.limit(0).select("*", *_described(dict.fromkeys(RULE_COLUMNS)))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return lowered.withColumn("_hit", F.explode(found)).select(*lines.columns, "_hit.*")


def automaton(strings: list[str]):
    """Finds which of ``strings`` a text holds, in one pass over it however many they are: a trie with failure links."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, s in enumerate(strings):
        found.add_word(s, k)
    if strings:
        found.make_automaton()
    return found


def scan_lines_with_many(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """As ``scan_lines``, for catalogues of hundreds of rules: neither the plan nor the time of a line grows with the rules that it has no string of.

    One pass of an automaton tells which rules' strings a line holds, and the patterns of these rules alone are tried. A rule whose matches hold no common string
    is tried on every line.
    """
    rules = usable(lines.sparkSession, [r for r in rules if not file_scoped(r)])
    if not rules:
        return scan_lines(lines, rules)
    parts = [needles(r["pattern"]) for r in rules]
    always = [k for k, p in enumerate(parts) if not p]
    strings = sorted({s for p in parts if p for s in p})
    asking = [[k for k, p in enumerate(parts) if p and s in p] for s in strings]

    @F.pandas_udf("array<int>")
    def candidates(lowered: pd.Series) -> pd.Series:
        found = automaton(strings)
        told = lambda text: sorted({k for _, s in found.iter(text) for k in asking[s]}.union(always)) if strings else always
        return lowered.map(lambda text: None if text is None else told(text))

    described = F.from_json(F.lit(json.dumps([{c: r[c] for c in ("rule_id", "category", "severity", "description", "cwe_id", "owasp_category")} | {"title": f"[{r['rule_id']}] {r['name']}", "pattern": FLAGS + r["pattern"], "language": r["language"]} for r in rules])), RULES_JSON)
    rows = lines.withColumn("_rules", candidates(F.lower(F.translate("line", *FOLDS)))).filter(F.size("_rules") > 0)
    rule = rows.withColumn("_hit", F.explode(F.transform("_rules", lambda k: F.get(described, k))))
    fits = ((F.col("_hit.language") == "all") | F.col("language").eqNullSafe(F.col("_hit.language"))) & F.regexp_like("line", F.col("_hit.pattern"))
    return rule.filter(fits).select(*lines.columns, *[F.col(f"_hit.{c}").alias(c) for c in ("rule_id", "category", "severity", "description", "cwe_id", "owasp_category", "title")])


RULES_JSON = "array<struct<rule_id:string,category:string,severity:string,description:string,cwe_id:string,owasp_category:string,title:string,pattern:string,language:string>>"


def match_positions(code: Column, pattern: str) -> Column:
    """For each match of a pattern that can't be empty: the newlines before it plus 1, as an array."""
    found, between = F.regexp_extract_all(code, F.lit(pattern), 0), F.split(code, pattern, -1)
    breaks = lambda s: F.regexp_count(s, F.lit("\n"))
    steps = F.transform(found, lambda m, i: F.struct(breaks(F.get(between, i)).alias("gap"), breaks(m).alias("own")))
    lines = F.aggregate(
        steps,
        F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("out")),
        lambda a, s: F.struct((a["line"] + s["gap"] + s["own"]).alias("line"), F.concat(a["out"], F.array(a["line"] + s["gap"])).alias("out")),
        lambda a: a["out"],
    )
    return F.coalesce(lines, F.array().cast("array<int>"))


def scan_files(files: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Findings of the file-scoped rules in ``files`` (added_lines, language, any more): one a match, at the line where it begins."""
    rules = usable(files.sparkSession, [r for r in (active_rules() if rules is None else rules) if file_scoped(r)])
    keep = [c for c in files.columns if c not in ("added_lines", "removed_lines")]
    if not rules:
        return files.limit(0).select(*keep, F.lit(None).cast("string").alias("line"), F.lit(0).alias("line_start"), *_described(dict.fromkeys(RULE_COLUMNS)))
    code = F.array_join(F.coalesce("added_lines", F.array().cast("array<string>")), "\n")
    each = files.withColumn("_code", code).filter("_code <> ''")
    def matches(rule: dict) -> Column:
        at = match_positions(F.col("_code"), FLAGS + rule["pattern"])
        return F.when(_gate(rule, F.col("language")), F.transform(at, lambda line: F.struct(line.alias("line_start"), *_described(rule)))).otherwise(F.array())

    hits = [matches(r) for r in rules]
    each = each.withColumn("_hit", F.explode(F.flatten(F.array(*hits))))
    line = F.get("added_lines", F.least(F.col("_hit.line_start"), F.size("added_lines")) - 1)
    return each.select(*keep, line.alias("line"), "_hit.*")


def findings(lines: DataFrame, files: DataFrame | None = None, rules: list[dict] | None = None) -> DataFrame:
    """Findings in their full form, of lines (diff_id, path, language, line_start, line) and, where given, of file-scoped rules over ``files``.

    Where lines and files have a ``section`` of their diff, findings carry it.
    """
    section = ["section"] if "section" in lines.columns else []
    out = scan_lines(lines.select("diff_id", *section, "path", "language", "line_start", "line"), rules)
    if files is not None:
        out = out.unionByName(scan_files(files.select("diff_id", *section, "path", "language", "added_lines"), rules))
    return out.select(
        "diff_id", *section, "rule_id", "category", "severity", "title", "description", F.col("path").alias("file_path"), "line_start", F.col("line").alias("line_content"),
        F.trim("line").alias("snippet"), "language", F.lit(True).alias("is_deterministic"), F.lit("stage1_deterministic").alias("filter_stage"),
        F.lit(1.0).alias("llm_confidence"), "cwe_id", "owasp_category",
    )


FEW_FILES = 200_000  # keys of files, of 100 bytes or so, that may be sent to every executor


def with_code(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the whole added code of their file, joined by newlines, as ``snippet``; null for a file that ``files`` lacks and for a null diff_id.

    A file is told by diff, path and, where findings carry it, its section of the diff; each is one row of ``files``. The scan's result is kept, and where
    its files are few enough their keys are sent out, so that only code of files with findings travels; beyond that both sides are shuffled.
    """
    section = ["section"] if "section" in found.columns else []
    keys = ["diff_id", *section, "file_path"]
    found = kept(found.drop("snippet"))
    wanted = found.select(*keys).distinct()
    few = wanted.limit(FEW_FILES + 1).count() <= FEW_FILES
    texts = files.select("diff_id", *section, F.col("path").alias("file_path"), "added_lines").join(F.broadcast(wanted) if few else wanted, keys, "left_semi")
    code = F.array_join(F.coalesce("added_lines", F.array().cast("array<string>")), "\n").alias("snippet")
    columns = [F.col(c) for c in found.columns]
    columns.insert(found.columns.index("language"), F.col("snippet"))
    return found.join(texts.select(*keys, code), keys, "left").select(*columns)


def is_test_file(path: Column) -> Column:
    out = F.lit(False)
    for marker in TEST_MARKERS:
        out = out | F.coalesce(path.contains(marker), F.lit(False))
    return out


def is_suppressed(line: Column) -> Column:
    out = F.lit(False)
    for mark in SUPPRESSIONS:
        out = out | F.coalesce(line.contains(mark), F.lit(False))
    return out


def context_filter(found: DataFrame, path: str = "file_path", line: str = "line_content") -> DataFrame:
    """Security findings in test files become minor; findings on lines that ask for none go. Case matters; null paths and lines have no marker."""
    lowered = is_test_file(F.col(path)) & (F.col("category") == "security")
    return found.withColumn("severity", F.when(lowered, "minor").otherwise(F.col("severity"))).filter(~is_suppressed(F.col(line)))
