"""Clusters of spellings of one column, and their merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import pairs as pair_functions
from tabwright.functions import text as fn
from tabwright.functions.cells import blank_of, col, require, text_of
from tabwright.operators.graph import components
from tabwright.operators.order import persisted

#: Values of a key that one block compares with the others, and pairs that are compared at a time.
BLOCK, PAIRS = 512, 1 << 16
METHODS = ("fingerprint", "ngram", "levenshtein", "jaroWinkler")


@dataclass(frozen=True)
class Cluster:
    """threshold: most edits, or least similarity. max_pairs: a job whose blocks hold more pairs is refused before it runs (None: none is)."""

    column: str
    method: str = "fingerprint"
    n: int = 2
    threshold: float = 2
    normalise: dict = field(default_factory=dict)
    max_pairs: int | None = None


def _values(df: DataFrame, spec: Cluster) -> DataFrame:
    """value, count of the distinct raw values that aren't blank: clusters are of values, however many rows have them."""
    require(df, [spec.column])
    return df.filter(~blank_of(df, spec.column)).groupBy(text_of(df, spec.column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def _suggest(keyed: DataFrame) -> DataFrame:
    """cluster, suggestion (most frequent value, of ties the smallest), rows, values; clusters of two or more values, most rows first."""
    best = F.min_by("value", F.struct((-F.col("count")).alias("c"), "value"))
    out = keyed.groupBy("cluster").agg(best.alias("suggestion"), F.sum("count").alias("rows"), F.count(F.lit(1)).alias("values")).filter("values > 1")
    return out.orderBy(F.desc("rows"), "suggestion")


def cluster_members(df: DataFrame, spec: Cluster) -> DataFrame:
    """cluster, value, count of each distinct value."""
    values = _values(df, spec)
    if spec.method == "fingerprint":
        return values.withColumn("cluster", fn.fingerprint(F.col("value"), **spec.normalise))
    if spec.method == "ngram":
        return values.withColumn("cluster", fn.ngram_fingerprint(F.col("value"), spec.n, **spec.normalise))
    if spec.method not in METHODS:
        raise ValueError(f"unknown method {spec.method!r}")
    values = persisted(values.withColumn("norm", fn.normalise(F.col("value"), **spec.normalise)))
    links = persisted(_links(values, spec))
    labels = components(links)
    return values.join(labels, F.col("value") == F.col("id"), "left").select(F.coalesce("label", "value").alias("cluster"), "value", "count")


def _links(values: DataFrame, spec: Cluster) -> DataFrame:
    """Pairs within the threshold, from blocks instead of a cross join.

    Edits: of ``threshold`` + 1 pieces of a value, one is untouched by the edits and found in the other value near its
    place, so values meet on (piece, place) keys. Jaro-Winkler: the similarity bounds from below how many characters two
    values share, so the first few of their characters, in one order for all, must meet (``_first_characters``).
    Length bands of a quarter of the longer value plus 3 bound both.
    """
    if spec.method == "levenshtein":
        k = int(spec.threshold)
        keys = _pieces(k)
    else:
        keys = _first_characters(spec.threshold)
    blocked = persisted(values.select("value", "norm", F.explode(keys).alias("key")).distinct())
    if spec.max_pairs is not None:
        pairs = blocked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0))).first()[0]
        if pairs > spec.max_pairs:
            raise ValueError(f"the blocks hold {int(pairs)} pairs; the limit is {spec.max_pairs}")
    if spec.method == "levenshtein":
        return _compared(blocked, lambda x, y: pair_functions.within_edits(x, y, int(spec.threshold)))
    return _compared(blocked, lambda x, y: pair_functions.jaro_winkler(x, y) >= spec.threshold)


def _compared(blocked: DataFrame, linked: Callable[[list[str], list[str]], np.ndarray]) -> DataFrame:
    """a, b of the pairs that share a key, are close in length and pass the test, each once.

    The values of a key are dealt into blocks: each is at home in one and goes to the others as a guest, so a key that
    many values share is many tasks, each of which compares those at home with each other and with the guests that come
    after them. Only linked pairs leave a task.
    """
    sizes = blocked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    home = F.pmod(F.xxhash64("value"), F.col("blocks"))
    dealt = blocked.join(sizes, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "block", (F.col("block") == home).alias("own"), "value", "norm").repartition("key", "block").sortWithinPartitions("key", "block", F.desc("own"))

    def met(rows: pa.Table, done: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A row at home and a later row of its key and block; rows before ``done`` have met already."""
        key, block, own = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["block"].to_numpy(), rows["own"].to_numpy()
        n = np.arange(rows.num_rows)
        fresh = np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]))
        start = np.maximum.accumulate(np.where(fresh, n, 0))
        at_home = np.append(0, np.cumsum(own))
        count = np.where(n >= done, at_home[n] - at_home[start], 0)
        ends = np.cumsum(count)
        low = 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
            some = count[low:high]
            yield np.repeat(start[low:high], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some), np.repeat(n[low:high], some)
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if kept is None else [kept, batch])
            own, size = rows["own"].to_numpy(), pc.utf8_length(rows["norm"]).to_numpy().astype(np.int64)
            order = pc.rank(rows["value"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
            norm = rows["norm"].to_pylist()
            for i, j in met(rows, 0 if kept is None else kept.num_rows):
                close = np.abs(size[i] - size[j]) <= np.maximum(size[i], size[j]) // 4 + 3
                some = np.flatnonzero(close & (own[j] | (order[i] < order[j])))
                i, j = i[some], j[some]
                found = np.flatnonzero(linked([norm[k] for k in i.tolist()], [norm[k] for k in j.tolist()]))
                i, j = i[found], j[found]
                swap = order[i] > order[j]
                columns = [rows["value"].take(pa.array(np.where(swap, x, y))).combine_chunks() for x, y in ((j, i), (i, j))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])
            last = np.flatnonzero(own & (rows["block"].to_numpy() == batch["block"][-1].as_py()) & pc.equal(rows["key"], batch["key"][-1]).to_numpy())
            kept = rows.take(pa.array(last)).combine_chunks().to_batches()
            kept = kept[0] if kept else None

    return dealt.mapInArrow(run, "a string, b string").distinct()


def _first_characters(threshold: float) -> Column:
    """Keys of which any two values that are similar enough, and close enough in length, share one.

    At most 0.4 of what the Jaro similarity lacks comes from a common prefix, so it is at least (t - 0.4) / 0.6; with m
    matches in values of lengths p and q it is at most (m / p + m / q + 1) / 3. That asks for m of at least
    s * p * q / (p + q), where s is three times that similarity less one. Characters are numbered by their occurrence; if
    two sets share m of them, their first p - m + 1 and q - m + 1 in any fixed order meet. Here that order is from the
    highest character down, since frequent ones mostly have low codes.
    """
    least = 3 * (threshold - 0.4) / 0.6 - 1
    norm, n = F.col("norm"), F.char_length("norm")
    if least <= 0:
        return F.array(F.lit(""))  # nothing need be shared
    shorter = F.greatest(n - F.floor(n / 4) - 3, F.lit(1))
    m = F.greatest(F.ceil(least * n * shorter / (n + shorter) - 1e-9), F.lit(1))
    chars = F.split(norm, "")
    numbered = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).alias("k")))
    first = F.slice(F.sort_array(numbered, asc=False), F.lit(1), F.greatest(n - m + 1, F.lit(0)).cast("int"))
    # two empty values are equal, and so are one value each
    return F.when(n > 0, F.transform(first, lambda x: F.concat(x["c"], x["k"].cast("string")))).otherwise(F.array(F.lit("empty")))


def _pieces(k: int) -> Column:
    """Keys that values within k edits share: each piece of a value with its number, and each substring that may be a piece of a value up to k longer or shorter. Values of at most k characters meet each other by a common key."""
    norm, n = F.col("norm"), F.char_length("norm")

    def piece(size: Column, i: int) -> tuple[Column, Column]:
        start = F.floor(size * i / (k + 1))
        return start, F.floor(size * (i + 1) / (k + 1)) - start

    keys = []
    for i in range(k + 1):
        for d in range(-k, k + 1):
            size = n + d
            start, length = piece(size, i)
            for shift in range(-k, k + 1):
                at = start + shift
                key = F.concat_ws("\x1f", size.cast("string"), F.lit(i), F.substring(norm, (at + 1).cast("int"), length.cast("int")))
                keys.append(F.when((size > k) & (at >= 0) & (at + length <= n), key))
    short = F.when(n <= 2 * k, F.lit("short"))
    return F.filter(F.array_distinct(F.array(*keys, short)), lambda x: x.isNotNull())


def cluster_values(df: DataFrame, spec: Cluster) -> DataFrame:
    return _suggest(cluster_members(df, spec))


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame | dict[str, str], scope: Column | None = None) -> DataFrame:
    """Replaces exact raw values of one column. mapping: {from: to}, or a table of value and to."""
    require(df, [column])
    table = mapping if isinstance(mapping, DataFrame) else df.sparkSession.createDataFrame(list(mapping.items()), "value string, to string")
    table = table.select(F.col("value").alias("_from"), F.col("to").alias("_to"))
    here = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    joined = df.withColumn("_here", here).join(table, text_of(df, column) == F.col("_from"), "left")
    return joined.select(*[F.when(F.col("_here") & F.col("_from").isNotNull(), F.col("_to")).otherwise(col(c)).alias(c) if c == column else col(c) for c in df.columns])


def mapping_of(df: DataFrame, spec: Cluster) -> DataFrame:
    """value, to: every value of a cluster of several, and its cluster's suggestion."""
    members = cluster_members(df, spec)
    return members.join(_suggest(members).select("cluster", F.col("suggestion").alias("to")), "cluster").filter(F.col("value") != F.col("to")).select("value", "to")
