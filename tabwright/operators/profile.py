"""Column profiles: types, blanks, distinct values, top values, quartiles, dates, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.cells import CLASSES, blank_of, class_of_column, date_of, num_of, require, strip, text_of
from tabwright.operators.quantile import group_quantiles


def _kind(counts: dict[str, Column]) -> Column:
    """The class that all cells that aren't blank have, else text; blank for an empty column."""
    filled = counts["number"] + counts["bool"] + counts["date"] + counts["text"]
    out = F.when(filled == 0, "blank")
    for k in ("number", "bool", "date"):
        out = out.when(counts[k] == filled, k)
    return out.otherwise("text")


#: Shares of q1, median and q3.
QUARTILES = (0.25, 0.5, 0.75)


def _exact(rows: DataFrame, n: int) -> DataFrame:
    """One row with distinct0.. and q0..: columns become (number, value) rows, so that one group-by counts the distinct values of all and one pass over ranks finds all quartiles."""
    values = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_value{i}").alias("v")) for i in range(n)]))).filter("v IS NOT NULL")
    distinct = values.groupBy("i", "v").agg(F.lit(1).alias("_")).groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    numbers = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_x{i}").alias("x")) for i in range(n)])))
    found = group_quantiles(numbers, {"i": F.col("i")}, F.col("x"), list(QUARTILES))
    both = distinct.join(found, "i", "left")
    quartiles = F.when(F.col("q0").isNotNull(), F.array("q0", "q1", "q2"))
    return both.agg(*[x for i in range(n) for x in (F.coalesce(F.max(F.when(F.col("i") == i, F.col("d"))), F.lit(0)).alias(f"distinct{i}"), F.max(F.when(F.col("i") == i, quartiles)).alias(f"q{i}"))])


def profile_columns(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None, approximate: bool = False, scope: Column | None = None) -> DataFrame:
    """One row per column: rows, blanks, the five classes' counts, kind, distinct, low, high, mean, q1, median, q3, earliest, latest, shortest, longest, mean_length.

    ``earliest`` and ``latest`` are original texts (of ties, the first by order_by, else by text). Distinct values and
    quartiles are counted by value and by rank beside the pass for all the rest; with ``approximate`` they are sketches
    of a fixed size in that pass.
    """
    columns = list(columns or df.columns)
    require(df, columns)
    rows = df if scope is None else df.filter(scope)
    # cells are read once, then aggregated as columns
    cells = [(class_of_column(df, c).alias(f"_kind{i}"), F.when(~blank_of(df, c), strip(text_of(df, c))).alias(f"_value{i}"), text_of(df, c).alias(f"_text{i}"), num_of(df, c).alias(f"_x{i}"), date_of(df, c).alias(f"_day{i}")) for i, c in enumerate(columns)]
    rows = rows.select(*[x for one in cells for x in one], *([F.struct(*order_by).alias("_tie")] if order_by else []))
    made: list[Column] = []
    for i in range(len(columns)):
        kind, value, text, x, day = (F.col(f"_{n}{i}") for n in ("kind", "value", "text", "x", "day"))
        size = F.char_length(value)
        tie = F.col("_tie") if order_by else text
        shown = F.when(day.isNotNull(), text)
        made += [F.count(F.when(kind == k, 1)).alias(f"{k}{i}") for k in CLASSES]
        made += [
            F.count(F.lit(1)).alias(f"rows{i}"),
            F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}"), F.avg(x).alias(f"mean{i}"),
            F.min_by(shown, F.when(day.isNotNull(), F.struct(day, tie))).alias(f"earliest{i}"),
            F.min_by(shown, F.when(day.isNotNull(), F.struct((-F.unix_micros(day)).alias("d"), tie))).alias(f"latest{i}"),
            F.min(size).alias(f"shortest{i}"), F.max(size).alias(f"longest{i}"), F.avg(size).alias(f"mean_length{i}"),
        ]
        if approximate:
            made += [F.approx_count_distinct(value, 0.016).alias(f"distinct{i}"), F.percentile_approx(x, F.array(*map(F.lit, QUARTILES)), 10_000).alias(f"q{i}")]
    flat = rows.agg(*made)
    if not approximate:
        flat = flat.crossJoin(F.broadcast(_exact(rows, len(columns))))
    out = []
    for i, c in enumerate(columns):
        counts = {k: F.col(f"{k}{i}") for k in CLASSES}
        out.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"rows{i}").alias("rows"), *[counts[k].alias({"blank": "blanks", "number": "numbers", "bool": "bools", "date": "dates", "text": "texts"}[k]) for k in CLASSES], _kind(counts).alias("kind"),
                F.col(f"distinct{i}").alias("distinct"), *[F.col(f"{n}{i}").alias(n) for n in ("low", "high", "mean")],
                F.get(f"q{i}", F.lit(0)).cast("double").alias("q1"), F.get(f"q{i}", F.lit(1)).cast("double").alias("median"), F.get(f"q{i}", F.lit(2)).cast("double").alias("q3"),
                *[F.col(f"{n}{i}").alias(n) for n in ("earliest", "latest", "shortest", "longest", "mean_length")],
            )
        )
    return flat.select(F.inline(F.array(*out)))


def top_values(df: DataFrame, column: str, k: int = 50, approximate: bool = False, scope: Column | None = None) -> DataFrame:
    """value, count of the k most frequent values (trimmed, not blank); count descending, then value. ``approximate``: a sketch of 1024 counters."""
    require(df, [column])
    rows = (df if scope is None else df.filter(scope)).filter(~blank_of(df, column)).select(strip(text_of(df, column)).alias("value"))
    if approximate:
        found = rows.agg(F.expr(f"approx_top_k(value, {int(k)}, 1024)").alias("top"))
        return found.select(F.inline("top")).toDF("value", "count").orderBy(F.desc("count"), "value")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def column_summaries(df: DataFrame) -> DataFrame:
    """column, kind, blanks, distinct, low, high, mean of every column."""
    return profile_columns(df).select("column", "kind", "blanks", "distinct", "low", "high", "mean")
