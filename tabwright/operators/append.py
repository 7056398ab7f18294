"""Appending tables whose columns differ."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.cells import col, text_of, unique, uniquified
from tabwright.operators.order import with_position


@dataclass(frozen=True)
class Append:
    """match: name, nameInsensitive, position or manual; schema: union, intersection or primary (the first input's).

    mapping (manual): output column -> {input: its column}. sources: add source_file and, given order_by, source_row (from 1).
    """

    match: str = "name"
    schema: str = "union"
    mapping: dict[str, dict[str, str]] = field(default_factory=dict)
    sources: bool = False
    order_by: tuple[str, ...] = ()
    duplicate_headers: str = "reject"
    continue_on_error: bool = False


@dataclass
class Plan:
    columns: list[str]
    #: input -> output column -> place of the input's column (None: blank)
    places: dict[str, dict[str, int | None]]
    failed: dict[str, str]


def _own_names(name: str, headers: list[str], spec: Append) -> dict[str, int]:
    keyed = [h.strip().lower() if spec.match == "nameInsensitive" else h.strip() for h in headers]
    twice = [k for k, n in Counter(keyed).items() if n > 1]
    if twice and spec.duplicate_headers == "reject":
        raise ValueError(f"{name}: columns appear more than once: {twice}")
    out: dict[str, int] = {}
    for i, k in enumerate(keyed):
        out.setdefault(k, i)
    return out


def append_plan(headers: dict[str, list[str]], spec: Append) -> Plan:
    """What goes where, from the inputs' headers alone."""
    if spec.match not in ("name", "nameInsensitive", "position", "manual") or spec.schema not in ("union", "intersection", "primary"):
        raise ValueError("unknown match or schema")
    failed: dict[str, str] = {}
    if spec.match == "manual":
        columns = list(spec.mapping)
        places: dict[str, dict[str, int | None]] = {}
        for name, own in headers.items():
            wanted = {c: spec.mapping[c].get(name) for c in columns}
            unknown = [v for v in wanted.values() if v and v not in own]
            if unknown:
                _fail(failed, name, f"no such columns: {unknown}", spec)
            else:
                places[name] = {c: own.index(v) if v else None for c, v in wanted.items()}
        return Plan(columns, places, failed)
    if spec.match == "position":
        widths = [len(h) for h in headers.values()]
        width = {"union": max(widths), "intersection": min(widths), "primary": widths[0]}[spec.schema]
        first = next(iter(headers.values()))
        columns = list(first[:width])
        for i in range(len(columns), width):
            columns.append(unique(f"Column {i + 1}", columns))
        return Plan(uniquified(columns), {n: {c: i if i < len(h) else None for i, c in enumerate(columns)} for n, h in headers.items()}, failed)
    keyed: dict[str, dict[str, int]] = {}
    for name, own in headers.items():
        try:
            keyed[name] = _own_names(name, own, spec)
        except ValueError as e:
            _fail(failed, name, str(e), spec)
    if not keyed:
        raise ValueError("no input can be appended")
    primary = next(iter(keyed.values()))
    seen: dict[str, str] = {}  # key -> spelling that was seen first
    for name, own in keyed.items():
        for k, i in own.items():
            seen.setdefault(k, headers[name][i].strip())
    keys = list(seen) if spec.schema == "union" else list(primary) if spec.schema == "primary" else [k for k in primary if all(k in own for own in keyed.values())]
    return Plan([seen[k] for k in keys], {n: {seen[k]: own.get(k) for k in keys} for n, own in keyed.items()}, failed)


def _fail(failed: dict[str, str], name: str, why: str, spec: Append) -> None:
    if not spec.continue_on_error:
        raise ValueError(why if name in why else f"{name}: {why}")
    failed[name] = why


def append_tables(inputs: dict[str, DataFrame], spec: Append) -> DataFrame:
    """All inputs' rows in one table; columns that an input lacks are null. Columns of one type in all inputs keep it, others become text."""
    plan = append_plan({n: df.columns for n, df in inputs.items()}, spec)
    source, number = unique("source_file", plan.columns), unique("source_row", plan.columns)
    kinds = {c: {inputs[n].schema[p[c]].dataType for n, p in plan.places.items() if p[c] is not None} for c in plan.columns}
    out: DataFrame | None = None
    for name, places in plan.places.items():
        df = inputs[name]
        if spec.sources and spec.order_by:
            df = with_position(df, list(spec.order_by), "_pos")
        columns: list[Column] = []
        for c in plan.columns:
            i, kind = places[c], kinds[c]
            own = next(iter(kind)).simpleString() if len(kind) == 1 else "string"
            value = F.lit(None).cast(own) if i is None else col(df.columns[i]) if len(kind) == 1 else text_of(df, df.columns[i])
            columns.append(value.alias(c))
        if spec.sources:
            columns.append(F.lit(name).alias(source))
            if spec.order_by:
                columns.append((F.col("_pos") + 1).alias(number))
        rows = df.select(*columns)
        out = rows if out is None else out.union(rows)
    return out


def append_report(inputs: dict[str, DataFrame], spec: Append) -> DataFrame:
    """input, status, mapped, missing (columns), rows of each input."""
    plan = append_plan({n: df.columns for n, df in inputs.items()}, spec)
    out: DataFrame | None = None
    for name, df in inputs.items():
        places = plan.places.get(name, {})
        mapped, missing = [c for c, i in places.items() if i is not None], [c for c, i in places.items() if i is None]
        names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("input"), F.lit("failed" if name in plan.failed else "ok").alias("status"), names(mapped).alias("mapped"), names(missing).alias("missing"), F.when(F.lit(name not in plan.failed), F.col("rows")).otherwise(0).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out
