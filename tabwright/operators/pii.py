"""Personal data: scan and redaction. Reports hold masked values only."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import text as fn
from tabwright.functions.cells import blank_of, col, require, strip, text_of


@dataclass(frozen=True)
class Detector:
    """kind: email, phoneNumber, ipAddress, ssn, paymentCard, or custom with a pattern for the whole cell."""

    kind: str
    pattern: str | None = None
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.kind


DETECTORS = tuple(Detector(k) for k in ("email", "phoneNumber", "ipAddress", "ssn", "paymentCard"))


def pii_scan(df: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, columns: list[str] | None = None, samples: int = 3) -> DataFrame:
    """detector, column, matches, samples (masked, the smallest): one row per pair with matches, most first. One pass; only single smallest values are kept per sample."""
    columns = list(columns or df.columns)
    require(df, columns)
    made, labels = [], []
    for c in columns:
        text, filled = text_of(df, c), ~blank_of(df, c)
        for d in detectors:
            hit = filled & fn.matches_pii(text, d.kind, d.pattern)
            i = len(labels)
            made += [F.count(F.when(hit, 1)).alias(f"n{i}"), F.array_sort(F.array_distinct(F.array(*[F.min(F.when(hit & (F.pmod(F.xxhash64(text), F.lit(samples)) == k), fn.mask(text, d.kind))) for k in range(samples)]))).alias(f"s{i}")]
            labels.append((d.label, c))
    flat = df.agg(*made)
    rows = F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(c).alias("column"), F.col(f"n{i}").alias("matches"), F.filter(F.col(f"s{i}"), lambda x: x.isNotNull()).alias("samples")) for i, (d, c) in enumerate(labels)])
    return flat.select(F.inline(rows)).filter("matches > 0").orderBy(F.desc("matches"), "detector", "column")


@dataclass(frozen=True)
class Redaction:
    """action: fixed (text), keepLast (keep), fullMask, pseudonymize (secret, salt), removeColumn or removeRows."""

    action: str
    text: str = "[REDACTED]"
    keep: int = 4
    secret: str = ""
    salt: str = ""


def new_salt() -> str:
    return secrets.token_hex(16)


def redact(df: DataFrame, detector: Detector, column: str, how: Redaction, scope: Column | None = None) -> DataFrame:
    """Acts on the cells of one column that one detector matches."""
    require(df, [column])
    text = text_of(df, column)
    hit = ~blank_of(df, column) & fn.matches_pii(text, detector.kind, detector.pattern)
    if scope is not None:
        hit = hit & F.coalesce(scope, F.lit(False))
    if how.action == "removeColumn":
        if len(df.columns) == 1:
            raise ValueError("at least one column must stay")
        return df.drop(col(column))
    if how.action == "removeRows":
        return df.filter(~hit)
    value = strip(text)
    n = F.char_length(value)
    if how.action == "fixed":
        new = F.lit(how.text)
    elif how.action == "keepLast":
        if not 1 <= how.keep <= 32:
            raise ValueError("keep must be 1 to 32")
        shown = F.least(n, F.lit(how.keep))
        new = F.concat(F.repeat(F.lit("•"), n - shown), F.substring(value, (n - shown + 1).cast("int"), shown.cast("int")))
    elif how.action == "fullMask":
        new = F.repeat(F.lit("•"), n)
    elif how.action == "pseudonymize":
        if not how.secret or not how.salt:
            raise ValueError("a pseudonym needs a secret and a salt")
        new = fn.pseudonym(value, how.secret, how.salt)
    else:
        raise ValueError(f"unknown action {how.action!r}")
    return df.select(*[F.when(hit, new).otherwise(text).alias(c) if c == column else col(c) for c in df.columns])


def redaction_audit(df: DataFrame, detector: Detector, column: str, how: Redaction) -> DataFrame:
    """One row for an audit log: detector, column, action, cells. Never values."""
    hit = ~blank_of(df, column) & fn.matches_pii(text_of(df, column), detector.kind, detector.pattern)
    return df.agg(F.count(F.when(hit, 1)).alias("cells")).select(F.lit(detector.label).alias("detector"), F.lit(column).alias("column"), F.lit(how.action).alias("action"), "cells")
