"""Columns and cells: selection, layout, renames, patches, rows by number, windows of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.cells import col, require, unique
from tabwright.operators.order import with_position


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in the table's own order; all must exist."""
    require(df, names)
    return df.select(*[col(c) for c in df.columns if c in set(names)])


def delete_columns(df: DataFrame, names: list[str]) -> DataFrame:
    require(df, names)
    if set(names) >= set(df.columns):
        raise ValueError("at least one column must stay")
    return df.select(*[col(c) for c in df.columns if c not in set(names)])


def rename_column(df: DataFrame, name: str, to: str) -> DataFrame:
    require(df, [name])
    if to != name and to in df.columns:
        raise ValueError(f"column {to!r} is there already")
    return df.withColumnRenamed(name, to)


def move_column(df: DataFrame, name: str, to: int) -> DataFrame:
    require(df, [name])
    rest = [c for c in df.columns if c != name]
    rest.insert(max(0, min(to, len(rest))), name)
    return df.select(*map(col, rest))


def insert_column(df: DataFrame, at: int, name: str, value: Column | None = None) -> DataFrame:
    """A new column, empty unless a value is given; a name that is taken gets a number."""
    own = unique(name, df.columns)
    made = (F.lit("") if value is None else value).alias(own)
    columns: list[Column] = [col(c) for c in df.columns]
    columns.insert(max(0, min(at, len(columns))), made)
    return df.select(*columns)


def replace_columns(df: DataFrame, at: int, remove: int, put: dict[str, Column]) -> DataFrame:
    """``remove`` columns from place ``at`` on make way for new ones, which may be computed from them."""
    names = df.columns
    if not 0 <= at <= len(names) or at + remove > len(names):
        raise ValueError("no such columns")
    left, right = names[:at], names[at + remove :]
    taken, made = [*left, *right], []
    for name, value in put.items():
        own = unique(name, taken)
        taken.append(own)
        made.append(value.alias(own))
    return df.select(*map(col, left), *made, *map(col, right))


@dataclass(frozen=True)
class Layout:
    hidden: tuple[str, ...] = ()
    pinned: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


@dataclass
class Laid:
    df: DataFrame
    missing: list[str] = field(default_factory=list)


def lay_out(df: DataFrame, layout: Layout) -> Laid:
    """Pinned columns, then those listed, then the others in the table's order, without hidden ones. Names that don't exist are reported."""
    wanted = list(dict.fromkeys([*layout.pinned, *layout.order, *df.columns]))
    shown = [c for c in wanted if c in df.columns and c not in layout.hidden]
    missing = [c for c in dict.fromkeys([*layout.pinned, *layout.order, *layout.hidden]) if c not in df.columns]
    return Laid(df.select(*map(col, shown or df.columns)), missing)


def delete_rows(df: DataFrame, rows: DataFrame | Column, on: str | list[str] | None = None) -> DataFrame:
    """Without the rows that a condition or a table of keys names."""
    if isinstance(rows, Column):
        return df.filter(~F.coalesce(rows, F.lit(False)))
    return df.join(rows.select(*([on] if isinstance(on, str) else on or rows.columns)).distinct(), on, "left_anti")


def patch_cells(df: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Overwrites cells from rows (key, column, value); of several for one cell the greatest value counts. Values are cast to the column's type."""
    named = [c for c in df.columns if c != key]
    by_row = patches.groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.struct("value"))).alias(f"_patch_{i}") for i, c in enumerate(named)])
    kinds = dict(df.dtypes)
    joined = df.join(by_row, key, "left")
    new = [F.when(F.col(f"_patch_{i}").isNotNull(), F.col(f"_patch_{i}.value").cast(kinds[c])).otherwise(col(c)).alias(c) for i, c in enumerate(named)]
    return joined.select(col(key), *new).select(*map(col, df.columns))


def window_of_rows(df: DataFrame, order_by: list[Column | str], start: int, count: int) -> DataFrame:
    """Rows start .. start + count of the ordered table."""
    return df.orderBy(*order_by).offset(max(start, 0)).limit(max(count, 0))


def rows_from(df: DataFrame, order_by: list[Column | str], start: int) -> DataFrame:
    """Rows from place ``start`` (0-based) on."""
    return with_position(df, order_by, "_pos").filter(F.col("_pos") >= start).drop("_pos")
