"""Filters from declarative specs: conditions in nested and/or groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cells import all_of, any_of, blank_of, col, java_regex, num, num_of, require, text_of

OPERATORS = ("equals", "notEquals", "contains", "notContains", "startsWith", "endsWith", "gt", "gte", "lt", "lte", "isEmpty", "notEmpty", "regex")
NUMERIC = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: str = ""
    case_sensitive: bool = False


@dataclass(frozen=True)
class Group:
    """Conditions and groups joined by ``and`` or ``or``; an empty group is true."""

    conditions: tuple[Condition | Group, ...] = field(default_factory=tuple)
    op: str = "and"

    def columns(self) -> list[str]:
        return [n for c in self.conditions for n in (c.columns() if isinstance(c, Group) else [c.column])]


def from_json(spec: dict) -> Condition | Group:
    """{"op": "and", "conditions": [{"column", "operator", "value", "caseSensitive"}, ...]}"""
    if "conditions" in spec:
        return Group(tuple(from_json(c) for c in spec["conditions"]), spec.get("op", "and").lower())
    return Condition(spec["column"], spec["operator"], spec.get("value", ""), spec.get("caseSensitive", False))


def _number(value: str) -> float:
    try:
        out = float(value)
    except ValueError:
        raise ValueError(f"{value!r} is no number") from None
    if out in (float("inf"), float("-inf")) or out != out:
        raise ValueError(f"{value!r} is no finite number")
    return out


def compile_condition(df: DataFrame, c: Condition) -> Column:
    require(df, [c.column])
    if c.operator == "isEmpty":
        return blank_of(df, c.column)
    if c.operator == "notEmpty":
        return ~blank_of(df, c.column)
    if c.operator in NUMERIC:
        x = num_of(df, c.column)
        if isinstance(df.schema[c.column].dataType, T.NumericType):
            x = col(c.column)  # bare, so that the comparison reaches the scan
        return getattr(x, NUMERIC[c.operator])(F.lit(_number(c.value)))
    text, value = text_of(df, c.column), c.value
    if c.operator == "regex":
        return text.rlike(java_regex(value, c.case_sensitive))
    if c.operator == "equals" and c.case_sensitive and value and isinstance(df.schema[c.column].dataType, T.StringType):
        return col(c.column) == value
    if not c.case_sensitive:
        text, value = F.lower(text), value.lower()
    if c.operator in ("equals", "notEquals"):
        return text == value if c.operator == "equals" else text != value
    if c.operator in ("contains", "notContains"):
        return text.contains(value) if c.operator == "contains" else ~text.contains(value)
    if c.operator == "startsWith":
        return text.startswith(value)
    if c.operator == "endsWith":
        return text.endswith(value)
    raise ValueError(f"unknown operator {c.operator!r}")


def compile_filter(df: DataFrame, spec: Condition | Group) -> Column:
    """The spec as a condition; null where a comparison has nothing to compare, which a filter takes as false. There is no negation over it, and bare comparisons reach the scan."""
    if isinstance(spec, Condition):
        return compile_condition(df, spec)
    if spec.op not in ("and", "or"):
        raise ValueError(f"unknown group operator {spec.op!r}")
    parts = [compile_filter(df, c) for c in spec.conditions]
    return all_of(parts) if spec.op == "and" or not parts else any_of(parts)


def filter_rows(df: DataFrame, spec: Condition | Group) -> DataFrame:
    return df.filter(compile_filter(df, spec))


# --- conditions from what a user picks in a column's overview -------------------------------------------------------


def with_value(spec: Group, column: str, value: str, include: bool = True) -> Group:
    """``spec`` and also only (or not) one value of a column; the blank value is a test for emptiness."""
    if value.strip() == "":
        return also(spec, Condition(column, "isEmpty" if include else "notEmpty"))
    return also(spec, Condition(column, "equals" if include else "notEquals", value, True))


def with_range(spec: Group, column: str, low: float | None = None, high: float | None = None) -> Group:
    bounds = [Condition(column, op, repr(x)) for op, x in (("gte", low), ("lte", high)) if x is not None]
    return also(spec, *bounds)


def also(spec: Group, *more: Condition | Group) -> Group:
    if spec.op == "and" or not spec.conditions:
        return Group((*spec.conditions, *more), "and")
    return Group((spec, *more), "and")
