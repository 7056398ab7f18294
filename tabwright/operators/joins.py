"""Joins on normalised keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.cells import blank_of, col, date_of, num_of, require, strip, text_of, unique

KINDS = ("inner", "left", "right", "full", "leftAnti", "rightAnti")


@dataclass(frozen=True)
class JoinSpec:
    """on: pairs (left column, right column). right_columns: those to keep (None: all)."""

    on: tuple[tuple[str, str], ...]
    kind: str = "inner"
    trim: bool = True
    case_insensitive: bool = False
    numeric_equal: bool = False
    date_equal: bool = False
    blank_equal: bool = False
    right_columns: tuple[str, ...] | None = None
    suffix: str = " (right)"
    lookup: bool = False
    max_output_rows: int | None = None


def _key(df: DataFrame, name: str, spec: JoinSpec) -> Column:
    """A tagged text, so that numbers, dates and text never meet; null (no match) where blank keys don't match."""
    text = text_of(df, name)
    own = strip(text) if spec.trim else text
    own = F.lower(own) if spec.case_insensitive else own
    key = F.concat(F.lit("t:"), own)
    if spec.date_equal:
        day = date_of(df, name)
        key = F.when(day.isNotNull(), F.concat(F.lit("d:"), F.unix_micros(day).cast("string"))).otherwise(key)
    if spec.numeric_equal:
        x = num_of(df, name) + F.lit(0.0)  # minus zero is zero
        key = F.when(x.isNotNull(), F.concat(F.lit("n:"), x.cast("string"))).otherwise(key)
    if spec.blank_equal:
        return key
    return F.when(~blank_of(df, name), key)


def _keyed(df: DataFrame, names: list[str], spec: JoinSpec, side: str) -> DataFrame:
    require(df, names)
    return df.withColumns({f"_{side}{i}": _key(df, n, spec) for i, n in enumerate(names)})


def _validate(spec: JoinSpec) -> None:
    if spec.kind not in KINDS:
        raise ValueError(f"unknown join {spec.kind!r}")
    if not spec.on:
        raise ValueError("a join needs at least one pair of key columns")


def join_tables(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """Columns of the left table, then the chosen ones of the right, with a suffix where names clash. Anti joins keep both sides' columns, the other side's being null."""
    _validate(spec)
    n = len(spec.on)
    l_ = _keyed(left, [a for a, _ in spec.on], spec, "l")
    r_ = _keyed(right, [b for _, b in spec.on], spec, "r")
    if spec.lookup:
        several = r_.filter(" AND ".join(f"_r{i} IS NOT NULL" for i in range(n))).groupBy(*[f"_r{i}" for i in range(n)]).count().filter("count > 1").limit(1).collect()
        if several:
            raise ValueError(f"the lookup table has a key more than once: {[v[2:] for v in several[0][:-1]]}")
    if spec.max_output_rows is not None:
        rows = join_preview(left, right, spec).first()["output_rows"]
        if rows > spec.max_output_rows:
            raise ValueError(f"the join would give {rows} rows; the limit is {spec.max_output_rows}")
    chosen = list(right.columns if spec.right_columns is None else spec.right_columns)
    require(right, chosen)
    taken, names = list(left.columns), []
    for c in chosen:
        own = c if c not in taken else unique(c + spec.suffix, taken)
        taken.append(own)
        names.append(own)
    r_ = r_.select(*[f"_r{i}" for i in range(n)], *[col(c).alias(f"_c{j}") for j, c in enumerate(chosen)])
    on = [F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(n)]
    mine = [col(c) for c in left.columns]
    theirs = [F.col(f"_c{j}").alias(name) for j, name in enumerate(names)]
    if spec.kind == "leftAnti":
        kinds = [right.schema[c].dataType for c in chosen]
        return l_.join(r_, on, "left_anti").select(*mine, *[F.lit(None).cast(k).alias(name) for k, name in zip(kinds, names)])
    if spec.kind == "rightAnti":
        return r_.join(l_, on, "left_anti").select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], *theirs)
    return l_.join(r_, on, spec.kind).select(*mine, *theirs)


def join_preview(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """One row: matched_pairs, left_unmatched, right_unmatched, left_duplicate_keys, right_duplicate_keys, output_rows, expands. From counts per key; no pairs are made."""
    _validate(spec)
    n = len(spec.on)
    l_ = _keyed(left, [a for a, _ in spec.on], spec, "k").groupBy(*[f"_k{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("lc"))
    r_ = _keyed(right, [b for _, b in spec.on], spec, "k").groupBy(*[f"_k{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("rc"))
    l_ = l_.select(*[F.col(f"_k{i}").alias(f"_l{i}") for i in range(n)], "lc")
    both = l_.join(r_, [F.col(f"_l{i}") == F.col(f"_k{i}") for i in range(n)], "full")
    lc, rc = F.coalesce("lc", F.lit(0)), F.coalesce("rc", F.lit(0))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    l_known = F.lit(True)
    r_known = F.lit(True)
    for i in range(n):
        l_known, r_known = l_known & F.col(f"_l{i}").isNotNull(), r_known & F.col(f"_k{i}").isNotNull()
    out = both.agg(
        whole(lc * rc).alias("matched_pairs"),
        whole(F.when(rc == 0, lc)).alias("left_unmatched"),
        whole(F.when(lc == 0, rc)).alias("right_unmatched"),
        whole(F.when(l_known & (lc > 1), 1)).alias("left_duplicate_keys"),
        whole(F.when(r_known & (rc > 1), 1)).alias("right_duplicate_keys"),
        whole(lc).alias("_left"),
        whole(rc).alias("_right"),
    )
    extra = {"inner": "matched_pairs", "left": "matched_pairs + left_unmatched", "right": "matched_pairs + right_unmatched", "full": "matched_pairs + left_unmatched + right_unmatched", "leftAnti": "left_unmatched", "rightAnti": "right_unmatched"}
    return out.withColumn("output_rows", F.expr(extra[spec.kind])).withColumn("expands", F.col("matched_pairs") > F.greatest("_left", "_right")).drop("_left", "_right")
