"""Schemas of the tables, declared: nothing is inferred. Keys and domains are what tests hold rows against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.fixed_values import CATEGORIES, SEVERITIES

TABLES = {
    "symbols": "id long, name string, kind string, language string, file_path string, line_start int, line_end int, col_start int, col_end int, signature string, return_type string, visibility string, is_exported boolean, commit_sha string, repo_id int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "call_edges": "id long, caller_id long, callee_id long, call_line int, call_type string, arg_count int, is_conditional boolean, created_at timestamp_ntz",
    "symbol_references": "id long, source_symbol_id long, target_symbol_id long, ref_type string, ref_line int, created_at timestamp_ntz",
    "taint_summaries": "id long, symbol_id long, parameter_name string, taint_propagates boolean, taint_sources array<struct<type:string,location:string>>, taint_sinks array<struct<type:string,location:string>>, sanitizers array<struct<function:string,kind:string>>, summary_hash string, commit_sha string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "review_records": "id string, mr_id string, repo_url string, branch_name string, commit_sha string, review_status string, total_issues int, critical_count int, major_count int, minor_count int, info_count int, files_analyzed int, analysis_time_ms long, llm_calls int, cache_hit_rate decimal(5,2), created_at timestamp_ntz, completed_at timestamp_ntz",
    "findings": "id long, review_id string, rule_id string, category string, severity string, title string, description string, file_path string, line_start int, line_end int, symbol_name string, taint_source string, taint_sink string, evidence array<struct<type:string,location:string,snippet:string>>, suggestion string, auto_fix_code string, auto_fix_applied boolean, auto_fix_status string, llm_confidence decimal(5,2), filter_stage string, is_false_positive boolean, reviewer_feedback string, created_at timestamp_ntz",
    "rules": "id long, rule_id string, name string, category string, severity string, language string, description string, pattern string, fix_suggestion string, is_enabled boolean, is_deterministic boolean, cwe_id string, owasp_category string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "evaluation_metrics": "period string, period_start date, recall decimal(5,2), precision decimal(5,2), false_positive_rate decimal(5,2), auto_fix_pass_rate decimal(5,2), adoption_rate decimal(5,2), avg_review_time_ms long, p50_review_time_ms long, p99_review_time_ms long, total_reviews int, total_findings int, llm_call_count int",
}

KEYS = {
    "symbols": ("file_path", "name", "line_start"), "call_edges": ("caller_id", "callee_id", "call_line"), "taint_summaries": ("symbol_id", "parameter_name"),
    "review_records": ("id",), "findings": ("id",), "rules": ("rule_id",), "evaluation_metrics": ("period", "period_start"),
}

DOMAINS = {
    "review_records": {"review_status": ("pending", "analyzing", "completed", "failed")},
    "findings": {"category": CATEGORIES, "severity": SEVERITIES},
    "rules": {"category": CATEGORIES, "severity": SEVERITIES},
}


def repeated_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).filter("n > 1")


def outside_domain(df: DataFrame, table: str) -> DataFrame:
    """Rows with a value outside its column's domain; a null is in none."""
    bad: Column = F.lit(False)
    for column, values in DOMAINS.get(table, {}).items():
        bad = bad | F.coalesce(~F.col(column).isin(*values), F.lit(True))
    return df.filter(bad)
