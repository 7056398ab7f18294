"""Sorting by named keys, numbers before text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cells import col, num_of, require, text_of


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False


def sort_columns(df: DataFrame, keys: list[SortKey], order_by: list[Column | str] = ()) -> list[Column]:
    """Numeric cells by value, then the others bytewise; typed columns as they are. ``order_by`` breaks ties."""
    require(df, [k.column for k in keys])
    out: list[Column] = []
    for k in keys:
        if isinstance(df.schema[k.column].dataType, T.StringType):
            x = num_of(df, k.column)
            parts = [x.isNull(), x, F.when(x.isNull(), text_of(df, k.column))]
        else:
            parts = [col(k.column)]
        out += [p.desc() if k.descending else p.asc() for p in parts]
    return out + [F.col(c) if isinstance(c, str) else c for c in order_by]


def sort_rows(df: DataFrame, keys: list[SortKey], order_by: list[Column | str] = ()) -> DataFrame:
    return df.orderBy(*sort_columns(df, keys, order_by))


def top_rows(df: DataFrame, keys: list[SortKey], n: int, order_by: list[Column | str] = ()) -> DataFrame:
    return sort_rows(df, keys, order_by).limit(n)
