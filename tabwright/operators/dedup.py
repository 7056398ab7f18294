"""Finding and removing duplicate rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.cells import all_of, blank_of, collapse, require, strip, text_of


@dataclass(frozen=True)
class Dedup:
    """columns: of the key (empty: all but order_by). A key is blank only if all its parts are."""

    columns: tuple[str, ...] = ()
    trim: bool = False
    collapse_whitespace: bool = False
    case_insensitive: bool = False
    blank_keys_equal: bool = True
    exclude_blank_keys: bool = False
    within: tuple[str, ...] = ()


def _columns(df: DataFrame, spec: Dedup, order_by: list[str]) -> list[str]:
    names = list(spec.columns) or [c for c in df.columns if c not in order_by]
    require(df, names)
    return names


def _keyed(df: DataFrame, spec: Dedup, order_by: list[str], scope: Column | None) -> DataFrame:
    """Adds _key (null: not considered). A blank key that equals no other carries the row's order as well."""
    names = _columns(df, spec, order_by)

    def part(name: str) -> Column:
        text = text_of(df, name)
        text = strip(text) if spec.trim else text
        text = collapse(text) if spec.collapse_whitespace else text
        return F.lower(text) if spec.case_insensitive else text

    key = F.array(*map(part, names))
    empty = all_of([blank_of(df, n) for n in names])
    if not spec.blank_keys_equal:
        key = F.when(empty, F.concat(key, F.array(*[F.col(c).cast("string") for c in order_by]))).otherwise(key)
    considered = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    if spec.within:
        key = F.concat(F.array(*[F.col(c).cast("string") for c in spec.within]), key)
    if spec.exclude_blank_keys:
        considered = considered & ~empty
    return df.withColumn("_key", F.when(considered, key))


def duplicate_report(df: DataFrame, spec: Dedup, order_by: list[str], scope: Column | None = None) -> DataFrame:
    """One row: considered, groups (of more than one row), excess, remaining."""
    sizes = _keyed(df, spec, order_by, scope).filter("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sizes.agg(whole("n").alias("considered"), F.count(F.when(F.col("n") > 1, 1)).alias("groups"), whole(F.col("n") - 1).alias("excess"), F.count(F.lit(1)).alias("remaining"))


def duplicate_groups(df: DataFrame, spec: Dedup, order_by: list[str], groups: int = 50, rows: int = 8, scope: Column | None = None) -> DataFrame:
    """A sample for people to look at: the groups that come first, their size, and the order keys of their first rows."""
    keyed = _keyed(df, spec, order_by, scope).filter("_key IS NOT NULL")
    first = F.min(F.struct(*order_by)).alias("first")
    top = keyed.groupBy("_key").agg(first, F.count(F.lit(1)).alias("size")).filter("size > 1").orderBy("first").limit(groups)
    ranked = keyed.join(F.broadcast(top), "_key").withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order_by))).filter(F.col("_rank") <= rows)
    return ranked.groupBy("_key", "first", "size").agg(F.array_sort(F.collect_list(F.struct(*order_by))).alias("rows")).orderBy("first").select(F.col("_key").alias("key"), "size", "rows")


def duplicate_rows(df: DataFrame, spec: Dedup, order_by: list[str], scope: Column | None = None) -> DataFrame:
    """All rows of groups of more than one."""
    keyed = _keyed(df, spec, order_by, scope)
    many = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return keyed.join(many, "_key", "left_semi").drop("_key")


def deduplicate(df: DataFrame, spec: Dedup, order_by: list[str], keep: str = "first", scope: Column | None = None) -> DataFrame:
    """One row of each group stays: first, last, or mostComplete (most cells that aren't blank; the earliest of ties). Rows that aren't considered stay.

    The keeper comes from a partial aggregate of order keys, so a key with any number of rows is one small row per task.
    ``order_by`` must tell rows apart.
    """
    if keep not in ("first", "last", "mostComplete"):
        raise ValueError(f"unknown keep {keep!r}")
    keyed = _keyed(df, spec, order_by, scope)
    row = F.struct(*order_by)
    if keep == "first":
        best = F.min(row)
    elif keep == "last":
        best = F.max(row)
    else:
        filled = sum((F.when(blank_of(df, c), 0).otherwise(1) for c in df.columns), F.lit(0))
        best = F.min(F.struct((-filled).alias("f"), row.alias("row")))["row"]
    keepers = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(best.alias("_best"))
    left = keyed.join(keepers.withColumnRenamed("_key", "_of"), F.col("_key") == F.col("_of"), "left")
    return left.filter(F.col("_best").isNull() | (row == F.col("_best"))).select(*[F.col(f"`{c}`") for c in df.columns])
