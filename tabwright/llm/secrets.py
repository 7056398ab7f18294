"""Secret scans; DataFrame functions only.

Base spans come from three patterns (an assignment to a secret-like name, an access key, a long hex run), leftmost
and without overlaps per kind. Spark returns matches but not their places, so places are running sums of the gaps
(split by the same pattern) and the matches. The entropy spans are added to them: in every candidate string, a run of
one character class, a window slides over the characters. Its state is a count per character, one byte each, and the
sum of c * log2(c) in integers; the character that enters and the one that leaves change two counts and the sum, which
gives the Shannon entropy of each window. The stretch from the first to the last window that reaches the class's
threshold is a span, unless the allow-list knows the candidate's shape or the stretch holds placeholder words, one in
48 characters at least. Base spans always stay.

Places are code points, ends exclusive. Null texts count as empty and have no spans. Texts and candidates of any
length take time in proportion to it: no pattern recurses or goes back over what it matched. One output row per input
row, repeated rows and ids included; an empty table gives an empty result. Of spans with equal places the kind listed
first comes first. Outputs take the place of columns of their names, and other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import packed, read, sha, unpacked

#: The base patterns, the group whose length counts, and the least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
}
#: Characters of a window; a candidate has at least as many.
WINDOW = 24
#: Per character class: candidates and least bits a character in a window. A value may follow a name or path and one of
#: "=/_-", which don't belong to it. 24 characters have at most 4 bits if they are hex digits, else log2(24) = 4.58.
ENTROPY = {
    "entropy_hex": (r"(?<![A-Za-z0-9+])([0-9A-Fa-f]{24,})(?![A-Za-z0-9+/_=-])", 3.0),
    "entropy_upper": (r"(?<![A-Za-z0-9])((?=[A-F0-9]*[G-Z])(?=[A-Z]*[0-9])[A-Z0-9]{24,})(?![A-Za-z0-9])", 3.6),
    "entropy_letters": (r"(?<![A-Za-z0-9])([A-Za-z]{24,})(?![A-Za-z0-9])", 4.0),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_-])((?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,})", 3.9),
}
#: Candidates that are no secrets: digits only, UUIDs, paths of plain words, one short unit again and again. Possessive
#: quantifiers make each of them one pass.
ALLOWED = r"^(?:[0-9]++|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|/?(?:[A-Za-z]{2,}+[/_-])++[A-Za-z]++[0-9]{0,4}|(.{1,8}?)\1{2,}+.{0,7})$"
#: Words of values that are made up, and the most characters of a stretch for each of them.
PLACEHOLDER, PER_WORD = r"(?i)example|placeholder|changeme|xxxx", 48
#: c * log2(c) is counted in these units, so that sums over any number of windows stay exact.
UNIT = 1 << 40


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of all matches; ``value`` is the group."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    values = F.regexp_extract_all(text, F.lit(pattern), group)
    gaps = F.split(text, pattern, -1)
    sized = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), whole, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size")))
    # places gather in blocks, so that a step copies a block and not all places before it
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("block"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("blocks"))

    def place(s: Column, x: Column) -> Column:
        start, full = s["at"] + x["gap"], F.size(s["block"]) >= 256
        own = F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end")))
        return F.struct((start + x["size"]).alias("at"), F.when(full, own).otherwise(F.concat(s["block"], own)).alias("block"), F.when(full, F.concat(s["blocks"], F.array(s["block"]))).otherwise(s["blocks"]).alias("blocks"))

    placed = F.aggregate(sized, zero, place, lambda s: F.flatten(F.concat(s["blocks"], F.array(s["block"]))))
    return F.zip_with(placed, values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))


def _some(text: Column, pattern: str, value: Column) -> Column:
    """The searches for places run on texts with a match alone."""
    return F.when(text.rlike(pattern), value).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _byte(value: Column, i: Column) -> Column:
    """The code of character i (from 0) of an ASCII string given as bytes."""
    return F.ascii(F.substring(value, i + 1, F.lit(1)).cast("string"))


def hot_part(value: Column, most: Column) -> Column:
    """struct<first, last>: the first and last place at which a window's sum of c * log2(c) (in units) is at most ``most``; nulls if none is.

    The entropy of a window is log2(w) - sum / w. State of the fold: the counts (a string whose character k is the
    count of character code k), the sum, and the places.
    """
    table = F.array(*[F.lit(0 if c < 2 else round(c * math.log2(c) * UNIT)) for c in range(WINDOW + 1)])
    zero = F.struct(F.lit("\0" * 128).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def count(counts: Column, code: Column) -> Column:
        return F.ascii(F.substring(counts, code + 1, F.lit(1)))

    def put(counts: Column, code: Column, n: Column) -> Column:
        return F.overlay(counts, F.chr(n), code + 1, F.lit(1))

    def enter(state: Column, x: Column) -> Column:
        """The character at x["i"] enters."""
        n = count(state["n"], x["into"])
        return F.struct(put(state["n"], x["into"], n + 1).alias("n"), (state["s"] + F.get(table, n + 1) - F.get(table, n)).alias("s"), state["first"].alias("first"), state["last"].alias("last"))

    def move(state: Column, x: Column) -> Column:
        """One character leaves (from a full window on), one enters; none of the counts changes if they are the same."""
        m = count(state["n"], x["out"])
        left = F.struct(put(state["n"], x["out"], m - 1).alias("n"), (state["s"] + F.get(table, m - 1) - F.get(table, m)).alias("s"), state["first"].alias("first"), state["last"].alias("last"))
        changed = F.get(F.transform(F.array(F.when(x["out"] >= 0, left).otherwise(state)), lambda y: enter(y, x)), F.lit(0))
        return F.when(x["out"] == x["into"], state).otherwise(changed)

    def step(state: Column, i: Column, own: Column) -> Column:
        pair = F.struct(_byte(own, i).alias("into"), F.when(i >= WINDOW, _byte(own, i - WINDOW)).otherwise(F.lit(-1)).alias("out"))
        start = i - (WINDOW - 1)

        def note(s: Column) -> Column:
            hot = (start >= 0) & (s["s"] <= most)
            return F.struct(s["n"].alias("n"), s["s"].alias("s"), F.coalesce(s["first"], F.when(hot, start)).alias("first"), F.when(hot, start).otherwise(s["last"]).alias("last"))

        return F.get(F.transform(F.transform(F.array(pair), lambda x: move(state, x)), note), F.lit(0))

    def fold(own: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.octet_length(own) - 1), zero, lambda s, i: step(s, i, own), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    # a variable holds the bytes, whereas a column would copy them at every step
    return F.get(F.transform(F.array(value), fold), F.lit(0))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, plus base and spans: array<struct<start, rank, end, kind>> by start, then kind as listed.

    ``base`` holds the pattern spans alone, ``spans`` also the entropy spans.
    """
    whole = df.select(packed(df, [text]).alias("_keep"), F.coalesce(F.col(text), F.lit("")).alias(text))
    kinds = [*BASE, *ENTROPY]

    def span(start: Column, end: Column, rank: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), rank + 1)
        return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), kind.alias("kind"))

    def base_of(kind: str) -> Column:
        pattern, group, least = BASE[kind]
        found = F.filter(_some(F.col(text), pattern, _matches(F.col(text), pattern, group)), lambda x: F.char_length(x["value"]) >= least)
        return F.transform(found, lambda x: span(x["start"], x["end"], F.lit(kinds.index(kind))))

    def candidates(kind: str) -> Column:
        pattern, least = ENTROPY[kind]
        most = math.floor(((math.log2(WINDOW) - least) * WINDOW + 1e-9 * WINDOW) * UNIT)
        found = F.filter(_some(F.col(text), pattern, _matches(F.col(text), pattern, 1)), lambda x: ~x["value"].rlike(ALLOWED))
        return F.transform(found, lambda x: F.struct(F.lit(kinds.index(kind)).alias("rank"), x["start"].alias("start"), x["value"].cast("binary").alias("value"), F.lit(most).cast("long").alias("most")))

    def cut(x: Column) -> Column:
        """The hot stretch of a candidate with its text."""
        return F.transform(F.array(hot_part(x["value"], x["most"])), lambda h: F.struct(x["rank"].alias("rank"), (x["start"] + h["first"]).alias("start"), (x["start"] + h["last"] + WINDOW).alias("end"), F.substring(x["value"], h["first"] + 1, h["last"] - h["first"] + WINDOW).cast("string").alias("value")))

    found = whole.select("_keep", F.sort_array(F.concat(*map(base_of, BASE))).alias("base"), F.concat(*map(candidates, ENTROPY)).alias("_candidates"))
    made_up = lambda value: F.size(F.regexp_extract_all(value, F.lit(PLACEHOLDER), 0)) * PER_WORD >= F.char_length(value)
    hot = F.filter(F.flatten(F.transform("_candidates", cut)), lambda x: x["start"].isNotNull() & ~made_up(x["value"]))
    extra = F.transform(hot, lambda x: span(x["start"], x["end"], x["rank"]))
    return unpacked(found, df, [text], {"base": F.col("base"), "spans": F.sort_array(F.concat("base", extra))})


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Each span replaced by ``mark``, overlapping spans as one. Other columns stay; null texts become empty."""
    found = scan(df.withColumn("__own", F.col(text)), text)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(
        "spans",
        zero,
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.when(x["start"] < s["at"], s["parts"]).otherwise(F.concat(s["parts"], F.array(F.substring(F.coalesce(F.col("__own"), F.lit("")), s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))).alias("parts"),
            )
        ),
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.coalesce(F.col("__own"), F.lit("")), s["at"] + 1, F.lit(2**31 - 1))),
    )
    return found.withColumn("__cut", cut).select(*[F.col("__cut").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c == text or c in found.columns])


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, BASE), sha(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
