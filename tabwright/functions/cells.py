"""Cell coercion: what a text cell means as a number, boolean or date.

A cell is text; null and white space are blank. Typed columns (numbers, dates, booleans) are taken as they are, so
operators work on Parquet as well as on delimited text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted formats in order of preference, month first before day first, each with the shape it needs (years from 1000).
DATE_FORMATS = [
    ("yyyy-M-d", r"[1-9]\d{3}-\d{1,2}-\d{1,2}"),
    ("yyyy/M/d", r"[1-9]\d{3}/\d{1,2}/\d{1,2}"),
    ("M/d/yyyy", r"\d{1,2}/\d{1,2}/[1-9]\d{3}"),
    ("d/M/yyyy", r"\d{1,2}/\d{1,2}/[1-9]\d{3}"),
    ("M-d-yyyy", r"\d{1,2}-\d{1,2}-[1-9]\d{3}"),
    ("d-M-yyyy", r"\d{1,2}-\d{1,2}-[1-9]\d{3}"),
    ("d.M.yyyy", r"\d{1,2}\.\d{1,2}\.[1-9]\d{3}"),
    ("yyyy.M.d", r"[1-9]\d{3}\.\d{1,2}\.\d{1,2}"),
    ("yyyy-M-d H:m:s", r"[1-9]\d{3}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}"),
    ("yyyy-M-d H:m", r"[1-9]\d{3}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}"),
    ("yyyy/M/d H:m:s", r"[1-9]\d{3}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}"),
    ("M/d/yyyy H:m:s", r"\d{1,2}/\d{1,2}/[1-9]\d{3} \d{1,2}:\d{1,2}:\d{1,2}"),
    ("yyyy-M-d'T'H:m:s", r"[1-9]\d{3}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}"),
]
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"
#: How dates are first told from other text, so that most cells try no format.
DATE_LIKE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "t", "f")
TRUE = ("true", "yes", "y", "t", "1")
FALSE = ("false", "no", "n", "f", "0")
CLASSES = ("blank", "number", "bool", "date", "text")


def strip(c: Column) -> Column:
    """Without white space of any kind (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def num(c: Column) -> Column:
    """A finite number, or null. The shape is checked first: casts alone also take 1d, NaN and infinity."""
    value = F.when(strip(c).rlike(NUMBER), strip(c).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def is_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*BOOLEANS), F.lit(False))


def date(c: Column) -> Column:
    """A timestamp of a year from 1000 to 9999, or null."""
    value = strip(c)
    tries = [F.when(value.rlike(f"^{shape}\\z"), F.try_to_timestamp(value, F.lit(pattern))) for pattern, shape in DATE_FORMATS]
    zoned = F.when(value.rlike(RFC3339), F.upper(value).try_cast("timestamp"))
    return F.when(value.rlike(DATE_LIKE), F.coalesce(*tries, zoned))


def class_of(c: Column) -> Column:
    """One of CLASSES."""
    return F.when(blank(c), "blank").when(num(c).isNotNull(), "number").when(is_bool(c), "bool").when(date(c).isNotNull(), "date").otherwise("text")


def rendered(x: Column) -> Column:
    """A number as text: whole numbers below 1e15 without a point."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def col(name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(df: DataFrame, name: str) -> Column:
    """The cell as text, null being the empty cell."""
    kind, c = _kind(df, name), col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = rendered(c.cast("double"))
    elif not isinstance(kind, T.StringType):
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def blank_of(df: DataFrame, name: str) -> Column:
    return blank(col(name)) if isinstance(_kind(df, name), T.StringType) else col(name).isNull()


def num_of(df: DataFrame, name: str) -> Column:
    kind = _kind(df, name)
    if isinstance(kind, T.NumericType):
        x = col(name).cast("double")
        return F.when(F.abs(x) < float("inf"), x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x
    return num(col(name)) if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def date_of(df: DataFrame, name: str) -> Column:
    kind = _kind(df, name)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(name).cast("timestamp")
    return date(col(name)) if isinstance(kind, T.StringType) else F.lit(None).cast("timestamp")


def class_of_column(df: DataFrame, name: str) -> Column:
    kind, c = _kind(df, name), col(name)
    if isinstance(kind, T.StringType):
        return class_of(c)
    own = "number" if isinstance(kind, T.NumericType) else "bool" if isinstance(kind, T.BooleanType) else "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"
    return F.when(c.isNull(), "blank").otherwise(own)


def require(df: DataFrame, names: list[str] | tuple[str, ...]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")


def unique(name: str, taken: list[str] | set[str]) -> str:
    """``name``, or ``name (2)``, ``name (3)``... as is free."""
    if name not in taken:
        return name
    i = 2
    while f"{name} ({i})" in taken:
        i += 1
    return f"{name} ({i})"


def uniquified(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out.append(unique(n, out))
    return out


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def java_regex(pattern: str, case_sensitive: bool = True) -> str:
    """A pattern for Spark: an unescaped ``$`` at its end means the very end of the text. Bad patterns raise here."""
    import re

    try:
        re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern.replace(r"\z", r"\Z")))
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    end = len(pattern) - len(pattern.rstrip("\\"))
    if pattern.endswith("$"):
        slashes = len(pattern[:-1]) - len(pattern[:-1].rstrip("\\"))
        if slashes % 2 == 0:
            pattern = pattern[:-1] + r"\z"
    elif end % 2:
        raise ValueError(f"invalid pattern {pattern!r}")
    return pattern if case_sensitive else f"(?i){pattern}"


def quoted(literal: str) -> str:
    """A literal as a pattern."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def inert(literal: str) -> str:
    """A literal as a replacement."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")
