"""Cell transforms over chosen columns, with a report of what failed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import text as fn
from tabwright.functions.cells import blank, col, collapse, inert, java_regex, quoted, require, strip, text_of, unique


@dataclass(frozen=True)
class Transform:
    """kind: a key of KINDS, splitByDelimiter, splitByRegex or mergeColumns; options as each takes."""

    kind: str
    options: dict = field(default_factory=dict)


def _replace(c: Column, o: dict) -> Column:
    if o.get("case_sensitive", True):
        return F.replace(c, F.lit(o["find"]), F.lit(o.get("replace", "")))
    return F.regexp_replace(c, f"(?iu){quoted(o['find'])}", inert(o.get("replace", "")))


#: kind -> (new text or null where the cell can't be transformed, whether blank cells are left alone)
KINDS: dict[str, tuple[Callable[[Column, dict], Column], bool]] = {
    "trim": (lambda c, o: strip(c), False),
    "collapseWhitespace": (lambda c, o: collapse(c), False),
    "uppercase": (lambda c, o: F.upper(c), False),
    "lowercase": (lambda c, o: F.lower(c), False),
    "titleCase": (lambda c, o: fn.title_case(c), False),
    "replaceText": (_replace, False),
    "replaceRegex": (lambda c, o: F.regexp_replace(c, java_regex(o["pattern"], o.get("case_sensitive", True)), o.get("replace", "")), False),
    "fillBlank": (lambda c, o: F.when(blank(c), o["value"]).otherwise(c), False),
    "normalizeBooleans": (lambda c, o: fn.normalise_bool(c), True),
    "normalizeDates": (lambda c, o: fn.normalise_date(c, o.get("format", "%Y-%m-%d")), True),
    "normalizeNumbers": (lambda c, o: fn.normalise_number(c, o.get("decimal_comma", False)), True),
    "addPrefix": (lambda c, o: F.when(c != "", F.concat(F.lit(o["value"]), c)).otherwise(c), False),
    "addSuffix": (lambda c, o: F.when(c != "", F.concat(c, F.lit(o["value"]))).otherwise(c), False),
}


def _results(df: DataFrame, spec: Transform, columns: list[str], scope: Column | None) -> dict[str, tuple[Column, Column]]:
    """column -> (new text, whether it failed)"""
    if spec.kind not in KINDS:
        raise ValueError(f"unknown transform {spec.kind!r}")
    require(df, columns)
    made, skips_blank = KINDS[spec.kind]
    here = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    out = {}
    for c in columns:
        text = text_of(df, c)
        todo = here & ~blank(text) if skips_blank else here
        new = made(text, spec.options)
        failed = todo & new.isNull()
        out[c] = F.when(todo & new.isNotNull(), new).otherwise(text), failed
    return out


def transform(df: DataFrame, spec: Transform, columns: list[str], scope: Column | None = None, on_error: str = "skipInvalid") -> DataFrame:
    """``df`` with the columns transformed (as text). Cells that can't be are left as they are, or with ``failAll`` make the job fail when it runs."""
    if on_error not in ("skipInvalid", "failAll"):
        raise ValueError(f"unknown on_error {on_error!r}")
    found = _results(df, spec, columns, scope)

    def final(c: str) -> Column:
        new, failed = found[c]
        if on_error == "failAll":
            new = F.when(failed, F.raise_error(F.concat(F.lit(f"{spec.kind} of {c}: "), text_of(df, c)))).otherwise(new)
        return new.alias(c)

    return df.select(*[final(c) if c in found else col(c) for c in df.columns])


def transform_report(df: DataFrame, spec: Transform, columns: list[str], scope: Column | None = None) -> DataFrame:
    """column, affected, failed: one row per column."""
    found = _results(df, spec, columns, scope)
    counts = df.agg(*[F.count(F.when(new != text_of(df, c), 1)).alias(f"a{i}") for i, (c, (new, _)) in enumerate(found.items())], *[F.count(F.when(failed, 1)).alias(f"f{i}") for i, (_, failed) in enumerate(found.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("affected"), F.col(f"f{i}").alias("failed")) for i, c in enumerate(found)])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def transform_failures(df: DataFrame, spec: Transform, columns: list[str], key: str, n: int = 20, scope: Column | None = None) -> DataFrame:
    """column, key, value of the first ``n`` cells, by column and key, that can't be transformed."""
    found = _results(df, spec, columns, scope)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value"), failed.alias("failed")) for c, (_, failed) in found.items()])
    return df.select(col(key), F.inline(cells)).filter("failed").select("column", col(key), "value").orderBy("column", key).limit(n)


def transform_examples(df: DataFrame, spec: Transform, column: str, key: str, n: int = 20, scope: Column | None = None) -> DataFrame:
    """The first changed cells: key, before, after."""
    new, _ = _results(df, spec, [column], scope)[column]
    return df.select(key, text_of(df, column).alias("before"), new.alias("after")).filter("before <> after").orderBy(key).limit(n)


def split_column(df: DataFrame, column: str, delimiter: str, regex: bool = False, scope: Column | None = None, parts: int | None = None) -> DataFrame:
    """The column makes way for ``name 1..k``; k is the most parts of any row unless given. Rows out of scope keep their cell in part 1."""
    require(df, [column])
    text = text_of(df, column)
    cut = F.split(text, java_regex(delimiter) if regex else quoted(delimiter), -1)
    if scope is not None:
        cut = F.when(F.coalesce(scope, F.lit(False)), cut).otherwise(F.array(text))
    if parts is None:
        parts = df.agg(F.max(F.size(cut))).first()[0] or 1
    taken = [c for c in df.columns if c != column]
    names = []
    for i in range(parts):
        names.append(unique(f"{column} {i + 1}", [*taken, *names]))
    new = [F.coalesce(F.get(cut, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return df.select(*[x for c in df.columns for x in (new if c == column else [col(c)])])


def merge_columns(df: DataFrame, columns: list[str], separator: str = " ", name: str | None = None) -> DataFrame:
    """Columns joined in the given order, in the place of the leftmost; blanks keep their separators."""
    require(df, columns)
    if len(columns) < 2:
        raise ValueError("a merge needs two columns")
    rest = [c for c in df.columns if c not in columns]
    own = unique(name or "+".join(columns), rest)
    pieces = [text_of(df, columns[0])]
    for c in columns[1:]:
        pieces += [F.lit(separator), text_of(df, c)]
    at = min(df.columns.index(c) for c in columns)
    out = [col(c) for c in rest]
    out.insert(sum(c not in columns for c in df.columns[:at]), F.concat(*pieces).alias(own))
    return df.select(*out)
