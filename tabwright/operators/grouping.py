"""Group-by with blank rules, normalised keys and ordered aggregates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cells import any_of, blank_of, col, num_of, require, strip, text_of, unique
from tabwright.operators import sketches
from tabwright.operators.quantile import group_quantiles

NUMERIC = ("sum", "mean", "min", "max", "median")
ORDERED = ("first", "last", "concat", "concatDistinct")
AGGREGATES = ("count", "countNonblank", "countDistinct", *NUMERIC, *ORDERED)
CONCAT_BYTES = 2000


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None
    name: str | None = None
    separator: str = ", "
    max_bytes: int = CONCAT_BYTES


@dataclass(frozen=True)
class GroupBy:
    """order: key, countDesc or firstSeen. order_by: columns that give rows an order, for first, last, concat and first-seen. ordered: False saves the sort of the result where a sink or another operator follows."""

    keys: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]
    normalise: bool = False
    blank_keys: str = "keep"
    order: str = "key"
    order_by: tuple[str, ...] = ()
    approximate: bool = False
    ordered: bool = True


def _names(spec: GroupBy) -> list[str]:
    taken, out = list(spec.keys), []
    for a in spec.aggregates:
        own = unique(a.name or f"{a.function}({a.column or '*'})", taken)
        taken.append(own)
        out.append(own)
    return out


def _row(spec: GroupBy) -> Column:
    if not spec.order_by:
        raise ValueError("first, last, concat, normalised keys and first-seen order need order_by")
    return F.struct(*[F.col(c) for c in spec.order_by])


def capped(text: Column, most: int) -> Column:
    """At most so many bytes, cut between code points, with an ellipsis where something is cut off."""
    cut = F.encode(text, "UTF-8")
    # a code point that the cut splits leaves continuation bytes behind; the longest valid prefix is 0 to 3 bytes shorter
    fits = F.coalesce(*[F.when(F.is_valid_utf8(F.substring(cut, 1, most - k)), F.decode(F.substring(cut, 1, most - k), "UTF-8")) for k in range(4)])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(fits, F.lit("…")))


def aggregate(df: DataFrame, a: Aggregate, row: Column | None, approximate: bool = False) -> Column:
    if a.function == "count":
        return F.count(F.lit(1))
    if a.function not in AGGREGATES or a.column is None:
        raise ValueError(f"unknown aggregate {a.function!r}, or no column for it")
    require(df, [a.column])
    text, empty, x = text_of(df, a.column), blank_of(df, a.column), num_of(df, a.column)
    if a.function == "countNonblank":
        return F.count(F.when(~empty, 1))
    if a.function == "countDistinct":
        # whole numbers, days and truth values are as many as their texts, which needn't be made then
        own = col(a.column) if isinstance(df.schema[a.column].dataType, (T.IntegralType, T.DateType, T.BooleanType)) else F.when(~empty, strip(text))
        if approximate:
            return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(own.cast("string"), sketches.LG_K)), F.lit(0))
        return F.countDistinct(own)
    if a.function == "sum":
        return F.sum(x)
    if a.function == "mean":
        return F.avg(x)
    if a.function in ("min", "max"):
        return getattr(F, a.function)(x)
    if a.function == "median":
        return F.percentile_approx(x, 0.5)
    if a.function in ("first", "last"):
        return (F.min_by if a.function == "first" else F.max_by)(col(a.column), row)
    raise AssertionError(f"{a.function} has a pass of its own")


def _concat(rows: DataFrame, keys: list[str], a: Aggregate, df: DataFrame, row: Column, name: str) -> DataFrame:
    """keys, ``name``: values in row order. As a result is capped, no more values than it has bytes are ever gathered: a salted rank cuts a group's parts first, so a group of any size is never in one task."""
    require(df, [a.column])
    most = a.max_bytes + 1
    solid = rows.filter(~blank_of(df, a.column)).select(*keys, row.alias("_row_"), strip(text_of(df, a.column)).alias("_text_"))
    if a.function == "concatDistinct":
        solid = solid.groupBy(*keys, "_text_").agg(F.min("_row_").alias("_row_"))
    salted = solid.withColumn("_salt_", F.pmod(F.xxhash64("_row_"), F.lit(32)))
    for by in ([*keys, "_salt_"], keys):
        salted = salted.withColumn("_rank_", F.row_number().over(Window.partitionBy(*by).orderBy("_row_"))).filter(F.col("_rank_") <= most)
    said = F.transform(F.array_sort(F.collect_list(F.struct("_row_", "_text_"))), lambda v: v["_text_"])
    return salted.groupBy(*keys).agg(capped(F.array_join(said, a.separator), a.max_bytes).alias(name))


def group_by(df: DataFrame, spec: GroupBy) -> DataFrame:
    """One row per group: keys, then aggregates."""
    require(df, spec.keys)
    if not spec.keys:
        raise ValueError("a group-by needs a key")
    if spec.blank_keys not in ("keep", "exclude") or spec.order not in ("key", "countDesc", "firstSeen"):
        raise ValueError("unknown blank_keys or order")
    rows = df
    if spec.blank_keys == "exclude":
        rows = rows.filter(~any_of([blank_of(df, k) for k in spec.keys]))
    ordered = spec.normalise or spec.order == "firstSeen" or any(a.function in ORDERED for a in spec.aggregates)
    row = _row(spec) if ordered else None
    names = _names(spec)
    keys = [f"_g{i}" for i in range(len(spec.keys))]
    rows = rows.withColumns({g: F.lower(strip(text_of(df, k))) if spec.normalise else col(k) for g, k in zip(keys, spec.keys)})
    apart = lambda a: a.function.startswith("concat") or (a.function == "median" and not spec.approximate)
    made = [aggregate(df, a, row, spec.approximate).alias(n) for a, n in zip(spec.aggregates, names) if not apart(a)]
    shown = F.min_by(F.struct(*[text_of(df, k).alias(f"k{i}") for i, k in enumerate(spec.keys)]), row) if spec.normalise else F.first(F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(spec.keys)]))
    extra = [F.count(F.lit(1)).alias("_n"), shown.alias("_shown")] + ([F.min(row).alias("_seen")] if spec.order == "firstSeen" else [])
    out = rows.groupBy(*keys).agg(*made, *extra)
    for a, n in zip(spec.aggregates, names):
        if apart(a):
            if a.function == "median":
                require(df, [a.column])
                made_ = group_quantiles(rows, {g: F.col(g) for g in keys}, num_of(df, a.column), [0.5]).withColumnRenamed("q0", n)
            else:
                made_ = _concat(rows, keys, a, df, row, n)
            own = made_.select(*[F.col(g).alias(f"{g}_of") for g in keys], col(n))
            on = [F.col(g).eqNullSafe(F.col(f"{g}_of")) for g in keys]
            out = out.join(own, on, "left").drop(*[f"{g}_of" for g in keys])
            out = out if a.function == "median" else out.withColumn(n, F.coalesce(col(n), F.lit("")))
    out = out.select(*[F.col(f"_shown.k{i}").alias(k) for i, k in enumerate(spec.keys)], *[col(n) for n in names], *[c for c in ("_n", "_seen") if c in out.columns])
    by = [col(k) for k in spec.keys]
    order = {"key": by, "countDesc": [F.col("_n").desc(), *by], "firstSeen": [F.col("_seen")]}[spec.order]
    return (out.orderBy(*order) if spec.ordered else out).drop("_n", "_seen")


def group_report(df: DataFrame, spec: GroupBy) -> DataFrame:
    """One row: group_count, scanned_rows, blank_key_rows, invalid_numeric (cells, once for each numeric aggregate, that are neither blank nor numbers)."""
    require(df, spec.keys)
    lost = any_of([blank_of(df, k) for k in spec.keys]) if spec.blank_keys == "exclude" else F.lit(False)
    wrong = [F.when(~lost & ~blank_of(df, a.column) & num_of(df, a.column).isNull(), 1).otherwise(0) for a in spec.aggregates if a.function in NUMERIC]
    keys = [F.lower(strip(text_of(df, k))) if spec.normalise else text_of(df, k) for k in spec.keys]
    return df.agg(
        F.countDistinct(F.when(~lost, F.struct(*keys))).alias("group_count"),
        F.count(F.when(~lost, 1)).alias("scanned_rows"),
        F.count(F.when(lost, 1)).alias("blank_key_rows"),
        F.coalesce(F.sum(sum(wrong, F.lit(0))), F.lit(0)).cast("long").alias("invalid_numeric"),
    )


def group_sample(df: DataFrame, spec: GroupBy, n: int = 20) -> DataFrame:
    """The first ``n`` groups in the spec's order, to look at before a whole group-by."""
    return group_by(df, replace(spec, ordered=True)).limit(n)


def selection_stats(df: DataFrame, columns: list[str], scope: Column | None = None) -> DataFrame:
    """One row over all cells of a rectangle: cells, nonblank, numbers, total, mean, low, high."""
    require(df, columns)
    rows = df if scope is None else df.filter(scope)
    cells = rows.select(F.explode(F.array(*[F.struct(num_of(df, c).alias("x"), blank_of(df, c).alias("empty")) for c in columns])).alias("c"))
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(~F.col("c.empty"), 1)).alias("nonblank"), F.count("c.x").alias("numbers"), F.sum("c.x").alias("total"), F.avg("c.x").alias("mean"), F.min("c.x").alias("low"), F.max("c.x").alias("high"))
