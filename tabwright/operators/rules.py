"""Rules across the columns of a row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.cells import all_of, any_of, blank_of, col, date_of, num_of, require, strip, text_of

COMPARE = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__", "!=": "__ne__"}


@dataclass(frozen=True)
class Rule:
    """kind: columnsEqual, numericCompare, dateOrder, conditionalRequired, exactlyOne, atLeastOne, atMostOne, sumEquals or allowedCombinations. options: as each takes."""

    name: str
    kind: str
    columns: tuple[str, ...]
    options: tuple[tuple[str, object], ...] = ()

    def get(self, key: str, default=None):
        return dict(self.options).get(key, default)


def broken(df: DataFrame, rule: Rule) -> Column:
    """Whether a row breaks the rule; rows that it says nothing about don't."""
    require(df, rule.columns)
    c = rule.columns
    empty = [blank_of(df, x) for x in c]
    if rule.kind == "columnsEqual":
        same = strip(text_of(df, c[0])) == strip(text_of(df, c[1]))
        return same if rule.get("negate") else ~same
    if rule.kind in ("numericCompare", "dateOrder"):
        made = num_of if rule.kind == "numericCompare" else date_of
        a, b = made(df, c[0]), made(df, c[1])
        wrong = (~empty[0] & a.isNull()) | (~empty[1] & b.isNull())
        op = COMPARE[rule.get("op", "<=")] if rule.kind == "numericCompare" else "__le__" if rule.get("allow_equal") else "__lt__"
        return wrong | (~empty[0] & ~empty[1] & ~F.coalesce(getattr(a, op)(b), F.lit(False)))
    if rule.kind == "conditionalRequired":
        when, on = rule.get("when", "nonBlank"), text_of(df, c[0])
        asked = {"equals": strip(on) == str(rule.get("value", "")).strip(), "nonBlank": ~empty[0], "blank": empty[0]}[when]
        return asked & any_of(empty[1:])
    filled = reduce(lambda a, b: a + b, [F.when(e, 0).otherwise(1) for e in empty])
    if rule.kind in ("exactlyOne", "atLeastOne", "atMostOne"):
        return {"exactlyOne": filled != 1, "atLeastOne": filled < 1, "atMostOne": filled > 1}[rule.kind]
    if rule.kind == "sumEquals":
        xs = [num_of(df, x) for x in c]  # parts, then the total
        wrong = any_of([~e & x.isNull() for e, x in zip(empty, xs)])
        total = xs[-1]
        allowed = F.abs(total) * F.lit(float(rule.get("tolerance", 0))) / 100 if rule.get("percent") else F.lit(float(rule.get("tolerance", 0)))
        parts = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs[:-1]])
        off = F.when(empty[-1], ~all_of(empty[:-1])).otherwise(F.abs(parts - total) > allowed)
        return wrong | F.coalesce(off, F.lit(False))
    if rule.kind == "allowedCombinations":
        own = F.concat_ws("\x1f", *[strip(text_of(df, x)) for x in c])
        allowed = ["\x1f".join(str(v).strip() for v in row) for row in rule.get("allowed", ())]
        return ~all_of(empty) & ~own.isin(allowed) if allowed else ~all_of(empty)
    raise ValueError(f"unknown rule {rule.kind!r}")


def _names(df: DataFrame, rules: list[Rule]) -> Column:
    return F.filter(F.array(*[F.when(broken(df, r), r.name) for r in rules]), lambda x: x.isNotNull())


def check_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, violations: one row per rule, none left out, from one pass."""
    flat = df.agg(*[F.count(F.when(broken(df, r), 1)).alias(f"n{i}") for i, r in enumerate(rules)])
    return flat.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("violations")) for i, r in enumerate(rules)])))


def violating_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that break any of the rules, with ``broken_rules``."""
    return df.withColumn("broken_rules", _names(df, rules)).filter(F.size("broken_rules") > 0)


def rule_samples(df: DataFrame, rules: list[Rule], key: str, n: int = 100) -> DataFrame:
    """rule, key, cells (what the rule looks at, by column): the first ``n`` rows by key of each rule, from one pass."""
    looked = [F.struct(F.lit(r.name).alias("rule"), F.map_from_arrays(F.array(*map(F.lit, dict.fromkeys(r.columns))), F.array(*[text_of(df, c) for c in dict.fromkeys(r.columns)])).alias("cells")) for r in rules]
    hits = F.filter(F.array(*[F.when(broken(df, r), x) for r, x in zip(rules, looked)]), lambda x: x.isNotNull())
    ranked = df.select(col(key).alias("key"), F.inline(hits)).withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy("key")))
    return ranked.filter(F.col("_k") <= n).select("rule", F.col("key").alias(key), "cells")
