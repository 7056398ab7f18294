"""Named views: a filter, a sort and a layout kept as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from tabwright.operators.filters import Condition, Group, filter_rows, from_json
from tabwright.operators.project import Layout, lay_out
from tabwright.operators.sort import SortKey, sort_rows


@dataclass(frozen=True)
class View:
    name: str
    filter: Condition | Group | None = None
    sort: tuple[SortKey, ...] = ()
    layout: Layout = Layout()


@dataclass
class Shown:
    df: DataFrame
    missing: list[str] = field(default_factory=list)
    filter_applied: bool = True


def load_view(text: str) -> View:
    spec = json.loads(text)
    layout = spec.get("layout", {})
    return View(
        spec["name"],
        from_json(spec["filter"]) if spec.get("filter") else None,
        tuple(SortKey(s["column"], s.get("descending", False)) for s in spec.get("sort", [])),
        Layout(tuple(layout.get("hidden", ())), tuple(layout.get("pinned", ())), tuple(layout.get("order", ()))),
    )


def apply_view(df: DataFrame, view: View, order_by: list[Column | str] = ()) -> Shown:
    """A filter that names a missing column isn't applied at all, missing sort keys are skipped; both are reported."""
    missing: list[str] = []
    applied = True
    if view.filter is not None:
        names = view.filter.columns() if isinstance(view.filter, Group) else [view.filter.column]
        gone = [n for n in names if n not in df.columns]
        missing += gone
        applied = not gone
        if applied:
            df = filter_rows(df, view.filter)
    keys = [k for k in view.sort if k.column in df.columns]
    missing += [k.column for k in view.sort if k.column not in df.columns]
    if keys:
        df = sort_rows(df, keys, order_by)
    laid = lay_out(df, view.layout)
    return Shown(laid.df, list(dict.fromkeys([*missing, *laid.missing])), applied)


def register_view(df: DataFrame, view: View) -> DataFrame:
    shown = apply_view(df, view).df
    shown.createOrReplaceTempView(view.name)
    return shown
