"""Outliers: detection within groups, reports, corrections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cells import blank_of, col, java_regex, num_of, rendered, require, strip, text_of
from tabwright.operators.quantile import group_quantiles

NUMERIC = ("iqr", "mad", "zscore", "percentile")
KINDS = (*NUMERIC, "rareCategory", "unexpectedCategory", "patternMismatch")


@dataclass(frozen=True)
class Outlier:
    """k: of iqr; threshold: of mad and zscore; low, high (0..100): of percentile; share: of rareCategory; allowed, pattern: of the others."""

    column: str
    kind: str
    groups: tuple[str, ...] = ()
    k: float = 1.5
    threshold: float = 3.5
    low: float = 1.0
    high: float = 99.0
    share: float = 0.01
    allowed: tuple[str, ...] = ()
    pattern: str = ""
    approximate: bool = False


def _keyed(df: DataFrame, spec: Outlier) -> DataFrame:
    """Adds _g0.. (trimmed group keys), _x (number), _v (trimmed text, null if blank)."""
    if spec.kind not in KINDS:
        raise ValueError(f"unknown outlier rule {spec.kind!r}")
    require(df, [spec.column, *spec.groups])
    new = {f"_g{i}": strip(text_of(df, g)) for i, g in enumerate(spec.groups)}
    return df.withColumns(new | {"_x": num_of(df, spec.column), "_v": F.when(~blank_of(df, spec.column), strip(text_of(df, spec.column)))})


def _groups(spec: Outlier) -> list[str]:
    return [f"_g{i}" for i in range(len(spec.groups))]


def _join(rows: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """Group statistics next to rows: a join that Spark broadcasts if the table of groups is small; one row without groups."""
    return rows.join(stats, names) if names else rows.crossJoin(F.broadcast(stats))


def _quantiles(rows: DataFrame, names: list[str], x: str, shares: dict[str, float], approximate: bool) -> DataFrame:
    """The group columns and the named quantiles of each group: exact ones by ranks, or of sketches of a fixed size."""
    if approximate:
        return rows.groupBy(*names).agg(*[F.percentile_approx(x, F.lit(s), 10_000).alias(n) for n, s in shares.items()])
    found = group_quantiles(rows, {g: F.col(g) for g in names}, F.col(x), list(shares.values()))
    if not names:  # one row, with nulls where there are no values
        found = found.agg(*[F.max(f"q{i}").alias(f"q{i}") for i in range(len(shares))])
    return found.select(*names, *[F.col(f"q{i}").alias(n) for i, n in enumerate(shares)])


def outlier_bounds(df: DataFrame, spec: Outlier) -> DataFrame:
    """Per group (_g0..): n, mean, median, sd, q1, q3, mad, low, high."""
    rows, names = _keyed(df, spec), _groups(spec)
    stats = rows.groupBy(*names).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("sd"))
    found = _quantiles(rows, names, "_x", {"median": 0.5, "q1": 0.25, "q3": 0.75, "_p_low": spec.low / 100, "_p_high": spec.high / 100}, spec.approximate)
    stats = stats.join(found, names, "left") if names else stats.crossJoin(F.broadcast(found))
    if spec.kind == "mad":
        off = _join(rows.select(*names, "_x"), found.select(*names, "median"), names).withColumn("_d", F.abs(F.col("_x") - F.col("median")))
        mad = _quantiles(off, names, "_d", {"mad": 0.5}, spec.approximate)
        stats = stats.join(mad, names, "left") if names else stats.crossJoin(F.broadcast(mad))
    else:
        stats = stats.withColumn("mad", F.lit(None).cast("double"))
    span = F.col("q3") - F.col("q1")
    low, high = {
        "iqr": (F.col("q1") - spec.k * span, F.col("q3") + spec.k * span),
        "zscore": (F.col("mean") - spec.threshold * F.col("sd"), F.col("mean") + spec.threshold * F.col("sd")),
        "percentile": (F.col("_p_low"), F.col("_p_high")),
    }.get(spec.kind, (F.lit(None).cast("double"), F.lit(None).cast("double")))
    return stats.withColumns({"low": low, "high": high}).drop("_p_low", "_p_high")


def _flag(df: DataFrame, spec: Outlier) -> DataFrame:
    """Rows with _flag and, for numeric rules, the group's statistics."""
    rows, names = _keyed(df, spec), _groups(spec)
    x = F.col("_x")
    if spec.kind in NUMERIC:
        found = _join(rows, outlier_bounds(df, spec), names)
        if spec.kind == "mad":
            bad = F.when(F.col("mad") == 0, x != F.col("median")).otherwise(F.abs(0.6745 * (x - F.col("median")) / F.col("mad")) > spec.threshold)
        elif spec.kind == "zscore":
            bad = (F.col("sd") > 0) & (F.abs((x - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))) > spec.threshold)
        else:
            bad = (x < F.col("low")) | (x > F.col("high"))
        return found.withColumn("_flag", F.coalesce(bad, F.lit(False)))
    if spec.kind == "rareCategory":
        solid = rows.filter("_v IS NOT NULL")
        each = solid.groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_c"))
        whole = each.groupBy(*names).agg(F.sum("_c").alias("_n"))
        rare = _join(each, whole, names).filter(F.col("_c") < F.lit(spec.share) * F.col("_n")).select(*names, "_v", F.lit(True).alias("_flag"))
        return rows.join(rare, [*names, "_v"], "left").withColumn("_flag", F.coalesce("_flag", F.lit(False)))
    if spec.kind == "unexpectedCategory":
        bad = ~F.col("_v").isin([a.strip() for a in spec.allowed]) if spec.allowed else F.lit(True)
    else:
        bad = ~F.col("_v").rlike(f"^(?:{java_regex(spec.pattern)})\\z")
    return rows.withColumn("_flag", F.col("_v").isNotNull() & bad)


def flag_outliers(df: DataFrame, spec: Outlier, name: str = "outlier") -> DataFrame:
    """``df`` with a boolean column. Cells that are blank, or no number under a numeric rule, are never outliers."""
    return _flag(df, spec).select(*map(col, df.columns), F.col("_flag").alias(name))


def outlier_report(df: DataFrame, spec: Outlier) -> DataFrame:
    """group (array of keys), considered, flagged, and for numeric rules mean, median, sd, q1, q3, mad, low, high; most flagged first."""
    names = _groups(spec)
    rows = _flag(df, spec)
    considered = F.count(F.when(F.col("_x").isNotNull() if spec.kind in NUMERIC else F.col("_v").isNotNull(), 1)).alias("considered")
    stats = [F.first(c).alias(c) for c in ("mean", "median", "sd", "q1", "q3", "mad", "low", "high")] if spec.kind in NUMERIC else []
    out = rows.groupBy(*names).agg(considered, F.count(F.when(F.col("_flag"), 1)).alias("flagged"), *stats)
    key = F.array(*names) if names else F.array().cast("array<string>")
    return out.select(key.alias("group"), *[c for c in out.columns if c not in names]).orderBy(F.desc("flagged"), "group")


def correct_outliers(df: DataFrame, spec: Outlier, action: str) -> DataFrame:
    """blank, groupMedian, capToBounds (the median where a rule has no bounds) or removeRows, on flagged cells."""
    if action == "removeRows":
        return _flag(df, spec).filter("NOT _flag").select(*map(col, df.columns))
    if action not in ("blank", "groupMedian", "capToBounds"):
        raise ValueError(f"unknown action {action!r}")
    if action != "blank" and spec.kind not in NUMERIC:
        raise ValueError(f"{action} needs a numeric rule")
    kind = df.schema[spec.column].dataType
    if action == "blank":
        new = F.lit(None)
    elif action == "groupMedian":
        new = F.col("median")
    else:
        new = F.when(F.col("low").isNull(), F.col("median")).when(F.col("_x") < F.col("low"), F.col("low")).otherwise(F.col("high"))
    if isinstance(kind, T.StringType) and action != "blank":
        new = rendered(new)
    made = F.when(F.col("_flag"), new.cast(kind)).otherwise(col(spec.column)).alias(spec.column)
    return _flag(df, spec).select(*[made if c == spec.column else col(c) for c in df.columns])
