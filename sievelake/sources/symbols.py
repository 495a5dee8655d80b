"""Symbols of source files: by Python's own syntax tree for Python, by pattern otherwise; and whether fixed code still parses."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.search import symbols_of
from .diffs import guess_language

SYMBOL = "name string, kind string, file string, line_start int, line_end int, signature string, return_type string, visibility string"


def python_symbols(path: str, source: str) -> list[tuple]:
    """Top-level functions, classes, assignments and imports; what stands inside a matched node is not visited. Code that doesn't parse has none."""
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError):
        return []
    lines, out = source.split("\n"), []
    while body:
        node = body.pop(0)
        text = lines[node.lineno - 1].strip()
        make = lambda name, kind, returns=None, node=node, text=text: (name, kind, path, node.lineno, node.end_lineno, text, returns, "unknown")
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                out.append(make(node.name, "function", ast.unparse(node.returns) if node.returns else None))
            case ast.ClassDef():
                out.append(make(node.name, "class"))
            case ast.Import() | ast.ImportFrom():
                out.append(make(ast.unparse(node), "import"))
            case ast.Assign():
                out += [make(t.id, "variable") for t in node.targets if isinstance(t, ast.Name)]
            case ast.AnnAssign() if isinstance(node.target, ast.Name):
                out.append(make(node.target.id, "variable", ast.unparse(node.annotation)))
            case _:
                body = [x for field in ("body", "orelse", "finalbody") for x in getattr(node, field, []) if isinstance(x, ast.stmt)] + body
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files`` (path, source): a syntax tree's for Python, a pattern's for other known languages, none for unknown ones or null sources."""
    known = files.filter(F.col("source").isNotNull()).withColumn("_language", guess_language(F.col("path")))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOL.split(", ")]
        for rows in batches:
            yield pd.DataFrame([s for p, t in zip(rows["path"], rows["source"], strict=True) for s in python_symbols(p, t)], columns=names)

    trees = known.filter("_language = 'python'").select("path", "source").mapInPandas(parse, SYMBOL)
    others = symbols_of(known.filter("_language NOT IN ('python', 'unknown')").select(F.col("path").alias("file"), F.col("source").alias("text")))
    return trees.unionByName(others.withColumn("return_type", F.lit(None).cast("string")))


def symbols_in_file(files: DataFrame, path: str) -> DataFrame:
    """The symbols of one file: no other is read further."""
    return symbols(files.filter(F.col("path") == path))


@F.pandas_udf(T.BooleanType())
def parses(path: pd.Series, source: pd.Series) -> pd.Series:
    """Whether code is valid, where that can be told: Python is compiled, other languages pass."""

    def fine(p: str, text: str) -> bool:
        if not p or not p.endswith(".py"):
            return True
        try:
            compile(text or "", p, "exec")
        except (SyntaxError, ValueError):
            return False
        return True

    return pd.Series([fine(p, t) for p, t in zip(path, source, strict=True)])
