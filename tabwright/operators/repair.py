"""Repair of missing values.

Fills along the row order carry a value inside a run of equal group keys, as the rows stand; a run ends where the key
changes. They work on range parts: inside a part by window, across parts through one summary row per part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cells import blank_of, col, num_of, rendered, require, strip, text_of
from tabwright.operators.order import PART, PLACE, ordered_parts, running
from tabwright.operators.quantile import group_quantiles

KINDS = ("normalizeNullTokens", "fillConstant", "fillForward", "fillBackward", "fillMean", "fillMedian", "fillMode", "interpolate")


@dataclass(frozen=True)
class Repair:
    kind: str
    columns: tuple[str, ...]
    value: str = ""
    tokens: tuple[str, ...] = ("NULL", "N/A", "NA", "null", "n/a", "-")
    groups: tuple[str, ...] = ()
    extrapolate: bool = False
    by_group: bool = False


def _put(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    return [new[c].cast(df.schema[c].dataType).alias(c) if c in new else col(c) for c in df.columns]


def _as_cell(df: DataFrame, name: str, x: Column) -> Column:
    return rendered(x) if isinstance(df.schema[name].dataType, T.StringType) else x


def repair(df: DataFrame, spec: Repair, order_by: list[str] | None = None, scope: Column | None = None) -> DataFrame:
    """``df`` with blank cells of the columns filled (null tokens: made blank)."""
    require(df, [*spec.columns, *spec.groups])
    here = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    if spec.kind == "normalizeNullTokens":
        tokens = [t.strip() for t in spec.tokens]
        return df.select(*_put(df, {c: F.when(here & strip(text_of(df, c)).isin(tokens), F.lit(None)).otherwise(col(c)) for c in spec.columns}))
    if spec.kind == "fillConstant":
        return df.select(*_put(df, {c: F.when(here & blank_of(df, c), F.lit(spec.value)).otherwise(col(c)) for c in spec.columns}))
    if spec.kind in ("fillMean", "fillMedian", "fillMode"):
        values = fill_values(df if scope is None else df.filter(scope), spec)
        joined = df.crossJoin(F.broadcast(values))
        return joined.select(*_put(df, {c: F.when(here & blank_of(df, c), _as_cell(df, c, F.col(f"_fill{i}")) if spec.kind != "fillMode" else F.col(f"_fill{i}")).otherwise(col(c)) for i, c in enumerate(spec.columns)}))
    if not order_by:
        raise ValueError(f"{spec.kind} needs an order")
    if spec.kind in ("fillForward", "fillBackward"):
        return _fill(df, spec, order_by, scope)
    if spec.kind == "interpolate":
        return _interpolate(df, spec, order_by, scope)
    raise ValueError(f"unknown repair {spec.kind!r}")


def fill_values(df: DataFrame, spec: Repair) -> DataFrame:
    """One row with _fill0.. : the mean, median or mode (of ties the smallest text) of each column's cells that aren't blank."""
    if spec.kind == "fillMean":
        return df.agg(*[F.avg(num_of(df, c)).alias(f"_fill{i}") for i, c in enumerate(spec.columns)])
    if spec.kind == "fillMedian":
        numbers = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), num_of(df, c).alias("x")) for i, c in enumerate(spec.columns)])))
        medians = group_quantiles(numbers, {"i": F.col("i")}, F.col("x"), [0.5])
        return medians.agg(*[F.max(F.when(F.col("i") == i, F.col("q0"))).alias(f"_fill{i}") for i in range(len(spec.columns))])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(~blank_of(df, c), text_of(df, c)).alias("v")) for i, c in enumerate(spec.columns)])
    counts = df.select(F.inline(cells)).filter("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), "v")).alias("v"))
    return best.agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"_fill{i}") for i in range(len(spec.columns))])


def _known(df: DataFrame, name: str) -> Column:
    return F.when(~blank_of(df, name), F.struct(col(name).alias("v")))


def _fill(df: DataFrame, spec: Repair, order_by: list[str], scope: Column | None) -> DataFrame:
    """Forward fill along the order; backward is forward along the reverse order."""
    order = [F.col(c).asc() if spec.kind == "fillForward" else F.col(c).desc() for c in order_by]
    key = F.struct(*[text_of(df, g) for g in spec.groups]) if spec.groups else F.struct(F.lit(""))
    rows = df.withColumn("_key", key).withColumn("_here", F.lit(True) if scope is None else F.coalesce(scope, F.lit(False)))
    rows = rows.withColumns({f"_v{i}": _known(df, c) for i, c in enumerate(spec.columns)})
    if spec.by_group and spec.groups:
        # rows are dealt by group and order, so a group is one run, over as many parts as it needs
        order = [F.col("_key"), *order]
    parts = ordered_parts(rows, order)
    inside = Window.partitionBy(PART).orderBy(PLACE)
    change = F.coalesce((F.lag("_key").over(inside) != F.col("_key")).cast("int"), F.lit(0))
    parts = parts.withColumn("_change", change)
    parts = parts.withColumn("_run", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy(PART, "_run").orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumns({f"_f{i}": F.last(f"_v{i}", ignorenulls=True).over(so_far) for i in range(len(spec.columns))})
    # per part: its first and last key, whether it is one run, and what its last run knows at its end
    summary = parts.groupBy(PART).agg(F.min_by("_key", PLACE).alias("_first"), F.max_by("_key", PLACE).alias("_last"), F.max("_run").alias("_runs"), *[F.max_by(f"_f{i}", PLACE).alias(f"_e{i}") for i in range(len(spec.columns))])
    # the last run of a part of one run may go on from the part before; such parts hand on the last value that any of them knows
    line = Window.orderBy(PART)
    joins_on = F.coalesce(F.lag("_last").over(line) == F.col("_first"), F.lit(False))
    summary = summary.withColumn("_joins", joins_on).withColumn("_stretch", F.sum(F.when(F.col("_joins") & (F.col("_runs") == 0), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    known = Window.partitionBy("_stretch").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumns({f"_o{i}": F.last(f"_e{i}", ignorenulls=True).over(known) for i in range(len(spec.columns))})
    carried = summary.select(PART, *[F.when(F.col("_joins"), F.lag(f"_o{i}").over(line)).alias(f"_c{i}") for i in range(len(spec.columns))])
    done = parts.join(F.broadcast(carried), PART)

    def final(i: int, c: str) -> Column:
        given = F.coalesce(F.col(f"_f{i}"), F.when(F.col("_run") == 0, F.col(f"_c{i}")))
        return F.when(F.col("_here") & F.col(f"_v{i}").isNull() & given.isNotNull(), given["v"]).otherwise(col(c))

    return done.select(*_put(df, {c: final(i, c) for i, c in enumerate(spec.columns)}))


def _interpolate(df: DataFrame, spec: Repair, order_by: list[str], scope: Column | None) -> DataFrame:
    """Blanks between numbers get the straight line by row distance; before the first and after the last, the next number if ``extrapolate``."""
    rows = df.withColumn("_here", F.lit(True) if scope is None else F.coalesce(scope, F.lit(False)))
    rows = rows.withColumns({f"_x{i}": F.when(F.col("_here"), num_of(df, c)) for i, c in enumerate(spec.columns)})
    parts = running(ordered_parts(rows, list(order_by)), [F.count(F.lit(1)).alias("_before")]).withColumn("_pos", F.col("_before") + F.col(PLACE))
    n = range(len(spec.columns))
    spot = lambda i: F.when(F.col(f"_x{i}").isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(f"_x{i}").alias("x")))
    # what comes next is the last one seen on the way back: a window that only grows costs one step a row
    back = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(PART).orderBy(F.desc(PLACE)).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumns({f"_l{i}": F.last(spot(i), ignorenulls=True).over(back) for i in n} | {f"_n{i}": F.last(spot(i), ignorenulls=True).over(ahead) for i in n})
    summary = parts.groupBy(PART).agg(*[F.max(spot(i)).alias(f"_last{i}") for i in n], *[F.min(spot(i)).alias(f"_first{i}") for i in n])
    before, after = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    ends = summary.select(PART, *[F.max(f"_last{i}").over(before).alias(f"_pl{i}") for i in n], *[F.min(f"_first{i}").over(after).alias(f"_pn{i}") for i in n])
    done = parts.join(F.broadcast(ends), PART)

    def final(i: int, c: str) -> Column:
        a, b = F.coalesce(F.col(f"_l{i}"), F.col(f"_pl{i}")), F.coalesce(F.col(f"_n{i}"), F.col(f"_pn{i}"))
        line = a["x"] + (b["x"] - a["x"]) * (F.col("_pos") - a["p"]) / (b["p"] - a["p"])
        value = F.when(a.isNotNull() & b.isNotNull(), line)
        if spec.extrapolate:
            value = F.coalesce(value, a["x"], b["x"])
        return F.when(F.col("_here") & blank_of(df, c) & value.isNotNull(), _as_cell(df, c, value)).otherwise(col(c))

    return done.select(*_put(df, {c: final(i, c) for i, c in enumerate(spec.columns)}))


def remove_blank_rows(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """Without the rows of whose cells in the columns a share of at least ``threshold`` is blank."""
    require(df, columns)
    n = sum((F.when(blank_of(df, c), 1).otherwise(0) for c in columns), F.lit(0))
    return df.filter(n / len(columns) < threshold)


def remove_blank_columns(df: DataFrame, columns: list[str], threshold: float, scope: Column | None = None) -> DataFrame:
    """Without the columns of whose cells a share of at least ``threshold`` is blank; not all may go."""
    require(df, columns)
    rows = df if scope is None else df.filter(scope)
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(blank_of(df, c), 1)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    gone = {c for i, c in enumerate(columns) if got["n"] and got[f"b{i}"] / got["n"] >= threshold}
    if gone >= set(df.columns):
        raise ValueError("all columns would go")
    return df.select(*[col(c) for c in df.columns if c not in gone])


def repair_report(before: DataFrame, after: DataFrame, columns: list[str], key: str) -> DataFrame:
    """column, filled, still_blank, invalid_numeric of each column, before against after."""
    require(before, columns)
    a = before.select(col(key).alias("_k"), *[F.struct(blank_of(before, c).alias("e"), num_of(before, c).alias("x"), text_of(before, c).alias("t")).alias(f"_a{i}") for i, c in enumerate(columns)])
    b = after.select(col(key).alias("_k2"), *[F.struct(blank_of(after, c).alias("e"), text_of(after, c).alias("t")).alias(f"_b{i}") for i, c in enumerate(columns)])
    both = a.join(b, F.col("_k") == F.col("_k2"))
    flat = both.agg(*[x for i in range(len(columns)) for x in (
        F.count(F.when(F.col(f"_a{i}.e") & ~F.col(f"_b{i}.e"), 1)).alias(f"f{i}"), F.count(F.when(F.col(f"_b{i}.e"), 1)).alias(f"s{i}"), F.count(F.when(~F.col(f"_a{i}.e") & F.col(f"_a{i}.x").isNull(), 1)).alias(f"w{i}"))])
    return flat.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled"), F.col(f"s{i}").alias("still_blank"), F.col(f"w{i}").alias("invalid_numeric")) for i, c in enumerate(columns)])))


def _changes(before: DataFrame, after: DataFrame, columns: list[str], key: str) -> DataFrame:
    """_k, column, was, now of the cells whose texts differ."""
    require(before, columns)
    a = before.select(col(key).alias("_k"), F.array(*[F.coalesce(text_of(before, c), F.lit("")) for c in columns]).alias("_a"))
    b = after.select(col(key).alias("_k2"), F.array(*[F.coalesce(text_of(after, c), F.lit("")) for c in columns]).alias("_b"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.get("_a", F.lit(i)).alias("was"), F.get("_b", F.lit(i)).alias("now")) for i, c in enumerate(columns)])
    return a.join(b, F.col("_k") == F.col("_k2")).select("_k", F.inline(F.filter(cells, lambda x: x["was"] != x["now"])))


def repair_totals(before: DataFrame, after: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row: cells and rows that were changed, and in how many columns. A row counts once, whatever of it was changed."""
    changed = _changes(before, after, columns, key).groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.collect_set("column").alias("own"))
    columns_ = F.size(F.array_distinct(F.flatten(F.collect_set("own"))))
    return changed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count(F.lit(1)).alias("rows"), columns_.cast("long").alias("columns"))


def repair_fills(before: DataFrame, after: DataFrame, columns: list[str], key: str, n: int = 20) -> DataFrame:
    """column, value, cells: what blank cells of each column became, the ``n`` most frequent values; of ties the smallest."""
    became = _changes(before, after, columns, key).filter((strip(F.col("was")) == "") & (strip(F.col("now")) != ""))
    counts = became.groupBy("column", F.col("now").alias("value")).agg(F.count(F.lit(1)).alias("cells"))
    ranked = counts.withColumn("_k", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("cells"), "value")))
    return ranked.filter(F.col("_k") <= n).select("column", "value", "cells")


def repair_examples(before: DataFrame, after: DataFrame, columns: list[str], key: str, n: int = 20) -> DataFrame:
    """column, key, was, now of the first ``n`` changed cells of each column, to look at; a task gives at most ``n`` for each."""
    changed = _changes(before, after, columns, key)
    ranked = changed.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("_k"))).filter(F.col("_n") <= n)
    return ranked.select("column", F.col("_k").alias("key"), "was", "now")
