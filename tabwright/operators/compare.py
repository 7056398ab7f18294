"""Comparison of two tables, by position or by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.cells import blank_of, date_of, num_of, require, strip, text_of
from tabwright.operators.order import with_position

STATUSES = ("unchanged", "changed", "added", "removed", "conflict")


@dataclass(frozen=True)
class Compare:
    """keys: left columns of the key (empty: by position). mapping: pairs (left, right); default: columns of one place, as far as both tables go."""

    order_by: tuple[str, ...]
    keys: tuple[str, ...] = ()
    mapping: tuple[tuple[str, str], ...] = ()
    trim: bool = False
    case_insensitive: bool = False
    numeric_equal: bool = False
    date_equal: bool = False
    blank_equal: bool = False


@dataclass
class Comparison:
    """records: status, left_key, right_key (order keys), key, and l and r, structs of the compared cells. cells: one row per differing cell."""

    records: DataFrame
    cells: DataFrame
    summary: DataFrame


def _canonical(df: DataFrame, name: str, spec: Compare) -> Column:
    """Cells are equal if this is: blank, number, date, trimmed and folded text are tried in that order."""
    text = text_of(df, name)
    own = strip(text) if spec.trim else text
    own = F.concat(F.lit("t:"), F.lower(own) if spec.case_insensitive else own)
    if spec.date_equal:
        day = date_of(df, name)
        own = F.when(day.isNotNull(), F.concat(F.lit("d:"), F.unix_micros(day).cast("string"))).otherwise(own)
    if spec.numeric_equal:
        x = num_of(df, name) + F.lit(0.0)
        own = F.when(x.isNotNull(), F.concat(F.lit("n:"), x.cast("string"))).otherwise(own)
    if spec.blank_equal:
        own = F.when(blank_of(df, name), F.lit("b:")).otherwise(own)
    return own


def _pairs(left: DataFrame, right: DataFrame, spec: Compare) -> list[tuple[str, str]]:
    pairs = list(spec.mapping) or list(zip(left.columns, right.columns))
    require(left, [a for a, _ in pairs])
    require(right, [b for _, b in pairs])
    missing = [k for k in spec.keys if k not in [a for a, _ in pairs]]
    if missing:
        raise ValueError(f"keys must be mapped: {missing}")
    return pairs


def _side(df: DataFrame, names: list[str], keys: list[str], spec: Compare, side: str) -> DataFrame:
    """Key, order key, canonical cells and raw cells of one table."""
    order = F.struct(*[F.col(c) for c in spec.order_by])
    key = F.array(*[_canonical(df, k, spec) for k in keys]) if keys else F.col("_pos")
    return df.select(
        key.alias("_key"), order.alias(f"{side}_key"), F.array(*[_canonical(df, n, spec) for n in names]).alias(f"_{side}c"), F.array(*[text_of(df, n) for n in names]).alias(f"_{side}v")
    )


def compare_tables(left: DataFrame, right: DataFrame, spec: Compare) -> Comparison:
    pairs = _pairs(left, right, spec)
    names = [a for a, _ in pairs]
    if not spec.keys:
        l_ = _side(with_position(left, list(spec.order_by)), names, [], spec, "left")
        r_ = _side(with_position(right, list(spec.order_by)), [b for _, b in pairs], [], spec, "right")
        both = l_.join(r_, "_key", "full")
        status = F.when(F.col("right_key").isNull(), "removed").when(F.col("left_key").isNull(), "added").when(F.col("_leftc") == F.col("_rightc"), "unchanged").otherwise("changed")
        records = both.withColumn("status", status).withColumn("_key", F.array(F.col("_key").cast("string")))
    else:
        to = dict(pairs)
        l_ = _side(left, names, list(spec.keys), spec, "left")
        r_ = _side(right, [b for _, b in pairs], [to[k] for k in spec.keys], spec, "right")
        records = _keyed(l_, r_)
    cells = _cells(records, names)
    summary = records.groupBy("status").agg(F.count(F.lit(1)).alias("records"))
    return Comparison(records.select("status", F.col("_key").alias("key"), "left_key", "right_key", F.col("_leftv").alias("left_cells"), F.col("_rightv").alias("right_cells")), cells, summary)


def _keyed(l_: DataFrame, r_: DataFrame) -> DataFrame:
    """Keys that are unique on both sides are compared. Of other keys every row is a conflict: left rows point at the key's first right row, further right rows stand alone.

    Counts and first right rows come from partial aggregates, so that a key with any number of rows is one row per task.
    """
    lc = l_.groupBy("_key").agg(F.count(F.lit(1)).alias("_ln"))
    rc = r_.groupBy("_key").agg(F.count(F.lit(1)).alias("_rn"), F.min("right_key").alias("_first"))
    counts = lc.join(rc, "_key", "full").withColumns({"_ln": F.coalesce("_ln", F.lit(0)), "_rn": F.coalesce("_rn", F.lit(0))})
    lead = r_.join(counts.filter("_rn > 0"), "_key").filter(F.col("right_key") == F.col("_first"))
    left = l_.join(counts.select("_key", "_ln", "_rn"), "_key").join(lead.select("_key", "right_key", "_rightc", "_rightv"), "_key", "left")
    of_left = F.when((F.col("_ln") > 1) | (F.col("_rn") > 1), "conflict").when(F.col("_rn") == 0, "removed").when(F.col("_leftc") == F.col("_rightc"), "unchanged").otherwise("changed")
    left = left.withColumn("status", of_left)
    alone = r_.join(counts, "_key").filter((F.col("_ln") == 0) | (F.col("right_key") != F.col("_first")))
    alone = alone.withColumn("status", F.when((F.col("_rn") > 1), "conflict").otherwise("added"))
    columns = ["status", "_key", "left_key", "right_key", "_leftc", "_rightc", "_leftv", "_rightv"]
    return left.select(*columns).unionByName(alone.select(*[c for c in columns if c in alone.columns]), allowMissingColumns=True)


def _cells(records: DataFrame, names: list[str]) -> DataFrame:
    """key, column, before, after of every differing cell of changed records."""
    both = F.arrays_zip(F.array(*map(F.lit, names)).alias("column"), "_leftc", "_rightc", F.col("_leftv").alias("before"), F.col("_rightv").alias("after"))
    each = records.filter("status = 'changed'").select(F.col("_key").alias("key"), "left_key", "right_key", F.explode(both).alias("x"))
    return each.filter(F.col("x._leftc") != F.col("x._rightc")).select("key", "left_key", "right_key", "x.column", "x.before", "x.after")


def rows_of(comparison: Comparison, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return comparison.records.filter(F.col("status") == status)


def results_page(comparison: Comparison, start: int, count: int, statuses: list[str] | None = None) -> DataFrame:
    """A page of records in the left table's order; added rows and lone right rows come last, in the right's."""
    rows = comparison.records if statuses is None else comparison.records.filter(F.col("status").isin(statuses))
    return rows.orderBy(F.col("left_key").asc_nulls_last(), F.col("right_key").asc_nulls_last()).offset(start).limit(count)


def change_report(before: DataFrame, after: DataFrame, spec: Compare) -> DataFrame:
    """Every changed cell between two versions of a table, for writing as JSON."""
    return compare_tables(before, after, spec).cells


