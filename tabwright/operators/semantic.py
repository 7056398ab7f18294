"""Semantic types of columns, and what to do with their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import text as fn
from tabwright.functions.cells import blank_of, col, rendered, require, strip, text_of

#: Least cells and share for a badge; most distinct values, and their share, of a categorical column.
MIN_CELLS, SHARE, CATEGORIES, CATEGORY_SHARE = 10, 0.95, 100, 0.1
TYPES = tuple(fn.PATTERNS)


def semantic_scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, detected (null: none), best, matching, nonblank: one row per column, over all rows.

    Cells become (column, value) pairs with counts first, so each distinct value is looked at once, whatever its number
    of rows, and its types are told after the shuffle.
    """
    columns = list(columns or df.columns)
    require(df, columns)
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.when(~blank_of(df, c), strip(text_of(df, c))).alias("v")) for i, c in enumerate(columns)])))
    values = cells.filter("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    told = values.select("i", "n", *[fn.matches(F.col("v"), t).alias(t) for t in TYPES])
    counts = told.groupBy("i").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values"), *[F.coalesce(F.sum(F.when(F.col(t), F.col("n"))), F.lit(0)).alias(t) for t in TYPES])
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column string")
    found = names.join(counts, "i", "left").fillna(0)
    # of equal counts the type that is listed first
    best = F.array_max(F.array(*[F.struct(F.col(t).alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(TYPES)]))
    found = found.withColumn("_best", best).withColumn("_n", F.col("_best.n")).withColumn("_t", F.when(F.col("_n") > 0, F.col("_best.t")))
    typed = (F.col("total") >= MIN_CELLS) & (F.col("_n") >= SHARE * F.col("total"))
    few = (F.col("total") >= MIN_CELLS) & ~typed & (F.col("values") <= CATEGORIES) & (F.col("values") <= CATEGORY_SHARE * F.col("total"))
    return found.select("column", F.when(typed, F.col("_t")).when(few, "categorical").alias("detected"), F.when(few, "categorical").otherwise(F.col("_t")).alias("best"), F.when(few, F.col("total")).otherwise(F.col("_n")).alias("matching"), F.col("total").alias("nonblank"))


def semantic_filter(df: DataFrame, column: str, kind: str, valid: bool = True) -> DataFrame:
    """Rows whose cell is (or is not) of the type; blank cells are in neither."""
    hit = fn.matches(text_of(df, column), kind)
    return df.filter(~blank_of(df, column) & (hit if valid else ~hit))


def _acted(df: DataFrame, column: str, kind: str, action: str) -> Column:
    text = text_of(df, column)
    hit = fn.matches(text, kind)
    if action == "normalize":
        new = fn.normalise_type(text, kind)
    elif action == "percentToDecimal":
        new, hit = rendered(fn.percent_to_decimal(text)), F.lit(True)
    elif action == "extractUrlHost":
        new, hit = fn.url_host(text), F.lit(True)
    elif action == "extractEmailDomain":
        new, hit = fn.email_domain(text), F.lit(True)
    else:
        raise ValueError(f"unknown action {action!r}")
    return F.when(hit & new.isNotNull(), new).otherwise(text)


def semantic_action(df: DataFrame, column: str, kind: str, action: str, scope: Column | None = None) -> DataFrame:
    """Normalises the cells of a type, or replaces them by a part; cells that it can't be done to stay."""
    here = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    new = F.when(here, _acted(df, column, kind, action)).otherwise(text_of(df, column))
    return df.select(*[new.alias(c) if c == column else col(c) for c in df.columns])
