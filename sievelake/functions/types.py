"""Types as canonical text: List[Int], Optional[String], Union[Int, Null], Custom(x)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Annotations by type.
SCALARS = {
    "Int": ("int", "i32", "i64", "int32", "int64", "integer"), "Float": ("float", "f64", "f32", "float64", "double", "number"), "String": ("str", "string", "String"),
    "Bool": ("bool", "boolean"), "Null": ("None", "null", "nil", "NoneType"), "Any": ("Any", "any", "unknown"), "List[Any]": ("list",), "Dict[Any, Any]": ("dict",),
}
_BY_NAME = {name: kind for kind, names in SCALARS.items() for name in names}

INTEGER = r"^[+-]?[0-9]{1,19}$"
FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def parse_annotation(text: str) -> str:
    """An annotation's canonical type. Unions split at every comma, however nested; what is unknown is Custom."""
    text = text.strip()
    if text in _BY_NAME:
        return _BY_NAME[text]
    for head, make in (("List[", "List[{}]"), ("Optional[", "Optional[{}]")):
        if text.startswith(head):
            return make.format(parse_annotation(text[len(head) : -1]))
    if text.startswith("Union["):
        return f"Union[{', '.join(parse_annotation(t) for t in text[6:-1].split(','))}]"
    return f"Custom({text})"


def _split(text: str) -> list[str]:
    depth, parts, start = 0, [], 0
    for k, c in enumerate(text):
        depth += (c in "[(") - (c in ")]")
        if c == "," and not depth:
            parts.append(text[start:k].strip())
            start = k + 1
    return [*parts, text[start:].strip()]


def compatible(a: str, b: str) -> bool:
    """Equal; one is Any; Optional of the other or against Null; a member of a Union; Int and Float."""
    if a == b or "Any" in (a, b) or {a, b} == {"Int", "Float"}:
        return True
    for x, y in ((a, b), (b, a)):
        if x.startswith("Optional["):
            return x[9:-1] == y or y == "Null"
    for x, y in ((a, b), (b, a)):
        if x.startswith("Union["):
            return any(compatible(t, y) for t in _split(x[6:-1]))
    return False


@F.pandas_udf(T.StringType())
def annotation_type(text: pd.Series) -> pd.Series:
    return text.map(parse_annotation, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def types_compatible(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else compatible(x, y) for x, y in zip(a, b, strict=True)])


def literal_type(value: Column) -> Column:
    """The type of a literal's text, by the first rule that holds; Any where none does; null of null."""
    first = F.substring(value, 1, 1)
    fits = value.rlike(INTEGER) & F.coalesce(F.regexp_replace(value, r"^\+", "").try_cast("decimal(20,0)").between(F.lit(-(2**63)), F.lit(2**63 - 1)), F.lit(False))
    return F.when(value.isNotNull(), F.when(value.isin("True", "False", "true", "false"), "Bool").when(fits, "Int").when(value.rlike(FLOAT), "Float").when(first.isin('"', "'", "`"), "String")
        .when(value.isin("None", "null", "nil"), "Null").when(first == "[", "List[Any]").when(first == "{", "Dict[Any, Any]").otherwise("Any"))


def environment(assignments: DataFrame, order: str = "seq") -> DataFrame:
    """scope, variable and type: the last of the ``assignments`` (scope, variable, type, order) of each variable."""
    return assignments.groupBy("scope", "variable").agg(F.max_by("type", order).alias("type"))


def types_of(env: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` (scope, variable) with their type; Any where the environment has none."""
    return names.join(env, ["scope", "variable"], "left").withColumn("type", F.coalesce("type", F.lit("Any")))


def uncertain(env: DataFrame) -> DataFrame:
    """scope and variable of what may be anything."""
    return env.filter("type = 'Any'").select("scope", "variable")
