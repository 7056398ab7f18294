"""Diagnostics of a table, and checks against a declared profile."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.cells import CLASSES, all_of, blank_of, class_of_column, date_of, is_bool, java_regex, num_of, strip, text_of

BLANK_HEAVY = 0.5


def header_issues(headers: list[str]) -> list[tuple[str, str, int, str]]:
    """(issue, column, count, detail) of a header row as it was read."""
    out = []
    for issue, keyed in (("duplicateHeaders", headers), ("duplicateHeadersCaseInsensitive", [h.strip().lower() for h in headers])):
        many = {k for k, n in Counter(k for k in keyed if k.strip()).items() if n > 1}
        places = [i for i, k in enumerate(keyed) if k in many]
        if places:
            out.append((issue, "", len(places), ",".join(map(str, places))))
    blanks = [i for i, h in enumerate(headers) if not h.strip()]
    if blanks:
        out.append(("blankHeaders", "", len(blanks), ",".join(map(str, blanks))))
    return out


def _class_counts(kind: Column, i: int) -> list[Column]:
    return [F.count(F.when(kind == k, 1)).alias(f"{k}{i}") for k in CLASSES]


def _dominant(i: int) -> Column:
    best, n = F.lit(None).cast("string"), F.col(f"text{i}")
    for k in ("number", "date", "bool"):
        more = F.col(f"{k}{i}") > n
        best, n = F.when(more, k).otherwise(best), F.when(more, F.col(f"{k}{i}")).otherwise(n)
    return best


def diagnose(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """issue, column, count, detail: one row per issue found, all from one pass over the cells."""
    made = [F.count(F.lit(1)).alias("rows")]
    cells = df.select(*[x for i, c in enumerate(df.columns) for x in (class_of_column(df, c).alias(f"_kind{i}"), text_of(df, c).alias(f"_text{i}"))])
    for i in range(len(df.columns)):
        text = F.col(f"_text{i}")
        made += _class_counts(F.col(f"_kind{i}"), i)
        made += [F.count(F.when(text.contains("�"), 1)).alias(f"damaged{i}"), F.count(F.when(text != strip(text), 1)).alias(f"edges{i}")]
    flat = cells.agg(*made)
    found = []
    for i, c in enumerate(df.columns):
        filled = F.col(f"number{i}") + F.col(f"date{i}") + F.col(f"bool{i}") + F.col(f"text{i}")
        best = _dominant(i)
        share = F.when(best == "number", F.col(f"number{i}")).when(best == "date", F.col(f"date{i}")).when(best == "bool", F.col(f"bool{i}"))
        one = lambda issue, n, detail: F.struct(F.lit(issue).alias("issue"), F.lit(c).alias("column"), n.cast("long").alias("count"), detail.cast("string").alias("detail"))  # noqa: E731, B023
        none = F.lit("")
        found += [
            one("emptyColumn", F.when(filled == 0, F.col("rows")), none),
            one("replacementChars", F.col(f"damaged{i}"), none),
            one("mixedTypes", F.when(best.isNotNull(), filled - share), best),
            one("whitespace", F.col(f"edges{i}"), none),
            one("blankHeavy", F.when((filled > 0) & (F.col(f"blank{i}") > BLANK_HEAVY * F.col("rows")), F.col(f"blank{i}")), none),
        ]
    issues = flat.select(F.explode(F.array(*found)).alias("x")).select("x.*").filter("count > 0")
    if headers is not None and (own := header_issues(headers)):
        issues = issues.unionByName(df.sparkSession.createDataFrame(own, "issue string, column string, count long, detail string"))
    return issues


def issue_rows(df: DataFrame, issue: str, column: str) -> DataFrame:
    """The rows that an issue of ``diagnose`` is about."""
    text = text_of(df, column)
    if issue == "replacementChars":
        return df.filter(text.contains("�"))
    if issue == "whitespace":
        return df.filter(text != strip(text))
    if issue in ("blankHeavy", "emptyColumn"):
        return df.filter(blank_of(df, column))
    if issue == "mixedTypes":
        best = df.select(class_of_column(df, column).alias("_kind")).agg(*_class_counts(F.col("_kind"), 0)).select(_dominant(0)).first()[0]
        kind = class_of_column(df, column)
        return df.filter(F.lit(best is not None) & (kind != "blank") & (kind != (best or "")))
    raise ValueError(f"issue {issue!r} is not about rows")


# --- profiles -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnRule:
    """kind: number, date, bool or text (None: any). pattern: of the whole cell."""

    column: str
    required: bool = False
    unique: bool = False
    kind: str | None = None
    pattern: str | None = None
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class FileProfile:
    rules: tuple[ColumnRule, ...]
    allow_extra: bool = True
    check_order: bool = False
    columns: tuple[str, ...] = field(default_factory=tuple)


def _whole(pattern: str) -> str:
    java_regex(pattern)
    return f"^(?:{re.sub(r'[$]$', '', pattern[1:] if pattern.startswith('^') else pattern)})\\z"


def rule_breaks(df: DataFrame, rule: ColumnRule) -> dict[str, Column]:
    """issue -> whether a row breaks it, for the rules that one row can break."""
    c, empty, out = rule.column, blank_of(df, rule.column), {}
    if rule.required:
        out["requiredBlank"] = empty
    if rule.kind and rule.kind != "text":
        ok = {"number": num_of(df, c).isNotNull(), "date": date_of(df, c).isNotNull(), "bool": is_bool(text_of(df, c))}[rule.kind]
        out["typeMismatch"] = ~empty & ~ok
    if rule.pattern:
        out["regexMismatch"] = ~empty & ~strip(text_of(df, c)).rlike(_whole(rule.pattern))
    if rule.low is not None or rule.high is not None:
        x = num_of(df, c)
        fine = all_of([x >= b if at == "low" else x <= b for at, b in (("low", rule.low), ("high", rule.high)) if b is not None])
        out["outOfRange"] = ~empty & ~F.coalesce(fine, F.lit(False))
    return out


def column_issues(columns: list[str], profile: FileProfile) -> list[tuple[str, str, int]]:
    """(issue, column, 1) of what the columns' names break."""
    wanted = list(profile.columns) or [r.column for r in profile.rules]
    names: list[tuple[str, str, int]] = [("missingColumn", c, 1) for c in wanted if c not in columns]
    if not profile.allow_extra:
        names += [("extraColumn", c, 1) for c in columns if c not in wanted]
    if profile.check_order:
        there = [c for c in wanted if c in columns]
        if [c for c in columns if c in there] != there:
            names.append(("columnOrder", "", 1))
    return names


def _cell_counts(df: DataFrame, profile: FileProfile) -> tuple[list[Column], list[tuple[str, str]]]:
    """Aggregates that count what cells break, and (issue, column) of each."""
    made, labels = [], []
    for r in profile.rules:
        if r.column not in df.columns:
            continue
        for issue, bad in rule_breaks(df, r).items():
            made.append(F.count(F.when(bad, 1)))
            labels.append((issue, r.column))
        if r.unique:
            made.append(F.count(F.lit(1)) - F.countDistinct(text_of(df, r.column)))
            labels.append(("nonUnique", r.column))
    return made, labels


def cell_issues_by(df: DataFrame, profile: FileProfile, by: str) -> DataFrame:
    """by, issues: how many cells of each group break the profile, all groups in one pass."""
    made, _ = _cell_counts(df, profile)
    return df.groupBy(by).agg(sum(made, F.lit(0)).cast("long").alias("issues"))


def validate_profile(df: DataFrame, profile: FileProfile) -> DataFrame:
    """issue, column, count: what the table breaks. All cell rules are counted in one pass."""
    names = column_issues(df.columns, profile)
    made, labels = _cell_counts(df, profile)
    out = df.sparkSession.createDataFrame(names, "issue string, column string, count long") if names else None
    if made:
        flat = df.agg(*[m.alias(f"n{i}") for i, m in enumerate(made)])
        rows = F.array(*[F.struct(F.lit(a).alias("issue"), F.lit(c).alias("column"), F.col(f"n{i}").cast("long").alias("count")) for i, (a, c) in enumerate(labels)])
        cells = flat.select(F.inline(rows)).filter("count > 0")
        out = cells if out is None else out.unionByName(cells)
    return out if out is not None else df.sparkSession.createDataFrame([], "issue string, column string, count long")


def profile_issue_rows(df: DataFrame, rule: ColumnRule, issue: str) -> DataFrame:
    """The rows that break one rule; for nonUnique, all rows of values that repeat."""
    if issue == "nonUnique":
        value = text_of(df, rule.column)
        many = df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_v")
        return df.withColumn("_own", value).join(many, F.col("_own") == F.col("_v"), "left_semi").drop("_own")
    return df.filter(rule_breaks(df, rule)[issue])


