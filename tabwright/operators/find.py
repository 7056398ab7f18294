"""Find and replace in cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cells import col, inert, java_regex, quoted, require, text_of


@dataclass(frozen=True)
class Find:
    query: str
    regex: bool = False
    case_sensitive: bool = False
    whole_cell: bool = False
    columns: tuple[str, ...] | None = None
    limit: int | None = None

    def pattern(self) -> str:
        own = java_regex(self.query) if self.regex else quoted(self.query)
        own = f"^(?:{own})\\z" if self.whole_cell else own
        return own if self.case_sensitive else f"(?iu){own}"


def _columns(df: DataFrame, spec: Find, key: str | None = None) -> list[str]:
    if spec.columns is not None:
        require(df, spec.columns)
        return [c for c in df.columns if c in spec.columns]
    return [c for c in df.columns if c != key]


def find(df: DataFrame, spec: Find, key: str, scope: Column | None = None) -> DataFrame:
    """key, column, value of each cell that matches, by key and the columns' order. Without a limit nothing is cut off."""
    if not spec.query:
        return df.select(key, F.lit("").alias("column"), F.lit("").alias("value")).limit(0)
    names = _columns(df, spec, key)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), text_of(df, c).alias("value")) for i, c in enumerate(names)])
    rows = df if scope is None else df.filter(scope)
    hits = rows.select(key, F.explode(F.filter(cells, lambda x: x["value"].rlike(spec.pattern()))).alias("_cell"))
    hits = hits.orderBy(key, "_cell.i").select(key, "_cell.column", "_cell.value")
    return hits if spec.limit is None else hits.limit(spec.limit)


def replace_all(df: DataFrame, spec: Find, replacement: str, scope: Column | None = None) -> DataFrame:
    """``df`` with all matches in text cells replaced, and ``_changed``, the number of cells that changed in the row.

    A literal replacement is inert; with a regex, ``$1`` and ``${name}`` are groups.
    """
    names = [c for c in _columns(df, spec) if isinstance(df.schema[c].dataType, T.StringType)]
    to = replacement if spec.regex else inert(replacement)
    here = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    new = {c: F.when(here & F.lit(bool(spec.query)), F.regexp_replace(col(c), spec.pattern(), to)).otherwise(col(c)) for c in names}
    changed = sum((F.when(new[c] != col(c), 1).otherwise(0) for c in names), F.lit(0))
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns], changed.alias("_changed"))
