"""Unpivot, pivot and transpose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.cells import blank, col, num_of, require, text_of, unique
from tabwright.operators.order import with_position

PIVOTS = ("none", "count", "countNonblank", "sum", "mean", "median", "min", "max", "first", "last")


def unpivot(df: DataFrame, ids: list[str], values: list[str], attribute: str = "attribute", value: str = "value", omit_blanks: bool = False, source_row: list[str] | None = None) -> DataFrame:
    """One row per row and value column. ``source_row``: order columns, for the number of the source row, from 1."""
    require(df, [*ids, *values])
    if not values:
        raise ValueError("nothing to unpivot")
    taken = list(ids)
    attribute = unique(attribute, taken)
    value = unique(value, [*taken, attribute])
    rows, more = df, []
    if source_row:
        rows = with_position(df, source_row, "_pos")
        more = [(F.col("_pos") + 1).alias(unique("source_row", [*taken, attribute, value]))]
    same = len({df.schema[v].dataType for v in values}) == 1
    cell = (lambda v: col(v)) if same else (lambda v: text_of(df, v))
    parts = F.array(*[F.struct(F.lit(v).alias("a"), cell(v).alias("v")) for v in values])
    out = rows.select(*map(col, ids), *more, F.explode(parts).alias("_x"))
    out = out.select(*map(col, ids), F.col("_x.a").alias(attribute), F.col("_x.v").alias(value), *[F.col(c) for c in out.columns if c not in ids and c != "_x"])
    return out.filter(~blank(col(value).cast("string"))) if omit_blanks else out


def unpivot_preview(df: DataFrame, values: list[str]) -> DataFrame:
    """One row: rows that an unpivot would give, and how many of them are blank."""
    require(df, values)
    blanks = sum((F.when(blank(col(v).cast("string")), 1).otherwise(0) for v in values), F.lit(0))
    return df.agg((F.count(F.lit(1)) * len(values)).alias("rows"), F.coalesce(F.sum(blanks), F.lit(0)).cast("long").alias("blanks"))


@dataclass(frozen=True)
class Pivot:
    keys: tuple[str, ...]
    header: str
    value: str
    aggregation: str = "none"
    max_columns: int = 1000
    order_by: tuple[str, ...] = ()


def _headers(df: DataFrame, spec: Pivot) -> list[str]:
    found = [r[0] for r in df.select(_header(df, spec)).distinct().orderBy("_header").limit(spec.max_columns + 1).collect()]
    if len(found) > spec.max_columns:
        raise ValueError(f"the pivot would have more than {spec.max_columns} columns")
    return found


def _header(df: DataFrame, spec: Pivot) -> Column:
    text = text_of(df, spec.header)
    return F.when(text == "", "(blank)").otherwise(text).alias("_header")


def pivot(df: DataFrame, spec: Pivot) -> DataFrame:
    """One row per key, one column per header value (sorted). Coordinates without rows are 0 for counts, else null. With order_by, rows come in first-seen order."""
    if spec.aggregation not in PIVOTS:
        raise ValueError(f"unknown aggregation {spec.aggregation!r}")
    require(df, [*spec.keys, spec.header, spec.value])
    if spec.aggregation == "none":
        clash = pivot_conflicts(df, spec).limit(1).collect()
        if clash:
            raise ValueError(f"more than one value for {clash[0].asDict()}")
    headers = _headers(df, spec)
    x, text = num_of(df, spec.value), text_of(df, spec.value)
    if spec.aggregation in ("first", "last") and not spec.order_by:
        raise ValueError("first and last need order_by")
    row = F.struct(*[F.col(c) for c in spec.order_by]) if spec.order_by else F.lit(0)
    filled = ~blank(col(spec.value).cast("string"))
    made = {
        "none": F.first(col(spec.value)), "count": F.count(F.lit(1)), "countNonblank": F.count(F.when(filled, 1)), "sum": F.sum(x), "mean": F.avg(x), "median": F.percentile(x, 0.5),
        "min": F.min(x), "max": F.max(x), "first": F.min_by(col(spec.value), row), "last": F.max_by(col(spec.value), row),
    }[spec.aggregation]
    keyed = df.withColumn("_header", _header(df, spec)).withColumn("_text", text)
    out = keyed.groupBy(*map(col, spec.keys)).pivot("_header", headers).agg(made)
    if spec.aggregation in ("count", "countNonblank"):
        out = out.fillna(0, [h for h in headers if h in out.columns])
    if spec.order_by:
        seen = keyed.groupBy(*map(col, spec.keys)).agg(F.min(row).alias("_seen"))
        pairs = [out[f"`{k}`"].eqNullSafe(seen[f"`{k}`"]) for k in spec.keys]
        on = pairs[0]
        for p in pairs[1:]:
            on = on & p
        out = out.join(seen.select(*[seen[f"`{k}`"] for k in spec.keys], "_seen"), on).orderBy("_seen").select(*[out[f"`{c}`"] for c in out.columns])
    return out


def pivot_conflicts(df: DataFrame, spec: Pivot) -> DataFrame:
    """Keys and header of coordinates with more than one row, and how many."""
    return df.groupBy(*map(col, spec.keys), _header(df, spec).alias("header")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def pivot_preview(df: DataFrame, spec: Pivot) -> DataFrame:
    """One row: rows, columns (with the keys), duplicate_coordinates."""
    cells = df.groupBy(*map(col, spec.keys), _header(df, spec)).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.countDistinct(F.struct(*map(col, spec.keys))).alias("rows"), (F.countDistinct("_header") + len(spec.keys)).alias("columns"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_coordinates"))


def transpose(df: DataFrame, order_by: list[str], max_columns: int = 1000) -> DataFrame:
    """Columns become rows: Column, Row 1, Row 2... For small tables: every row becomes a column."""
    n = df.limit(max_columns + 1).count()
    if n > max_columns:
        raise ValueError(f"the table has more than {max_columns} rows to make columns of")
    placed = with_position(df, order_by, "_pos")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), text_of(df, c).alias("v")) for i, c in enumerate(df.columns)])
    long = placed.select("_pos", F.explode(cells).alias("_x")).select("_pos", "_x.i", "_x.c", "_x.v")
    out = long.groupBy("i", "c").pivot("_pos", list(range(n))).agg(F.first("v"))
    return out.orderBy("i").select(F.col("c").alias("Column"), *[F.col(str(i)).alias(f"Row {i + 1}") for i in range(n)])
