"""Counts that merge: distinct values by stored sketches, and heavy hitters by bounded counters with an exact second pass.

A sketch of a part (a file, a day) takes a fixed number of bytes whatever the part holds, and the sketch of several
parts is the union of theirs, so a part that is added is the only one that is read. Estimates of n distinct values are
within ``ERROR`` of n in 997 of 1,000 cases (three standard errors of 1.04 / 2 ** (LG_K / 2)).

Blank cells don't count; cells are texts with white space cut off, as in profiles. Parts may be null, columns that are
not asked for don't matter, an empty table has no parts. A part that is sketched again takes the old one's place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.cells import blank_of, require, strip, text_of
from tabwright.operators.order import persisted

#: Logarithm of a sketch's slots, and the error of an estimate.
LG_K = 12
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
#: Candidates go to all tasks if they are at most so many bytes.
BROADCAST_BYTES = 16 << 20


def distinct_sketches(df: DataFrame, columns: list[str], part: Column) -> DataFrame:
    """part, column, rows, blanks, sketch: one row for each part and column, by one pass of partial sketches."""
    require(df, columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~blank_of(df, c), strip(text_of(df, c))).alias("v")) for c in columns])
    flat = df.select(part.alias("part"), F.inline(cells))
    return flat.groupBy("part", "column").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("v").isNull(), 1)).alias("blanks"), F.hll_sketch_agg("v", LG_K).alias("sketch"))


def distinct_estimates(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """column (and ``by``), parts, rows, blanks, distinct, low, high: what all parts hold together; low and high are ``ERROR`` away."""
    keys = [*(by or []), "column"]
    both = sketches.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("blanks").alias("blanks"), F.hll_union_agg("sketch").alias("_s"))
    n = F.coalesce(F.hll_sketch_estimate("_s"), F.lit(0))
    return both.select(*keys, "parts", "rows", "blanks", n.alias("distinct"), F.floor(n / (1 + ERROR)).alias("low"), F.ceil(n / (1 - ERROR)).alias("high"))


def update_store(spark: SparkSession, store: str, listing: DataFrame, columns: list[str], read) -> DataFrame:
    """Brings the sketches stored under ``store`` up to date with a listing of files (path, length, modificationTime) and returns them.

    Only files that the store lacks, or that have changed, are read: ``read(paths)`` gives their rows with a column
    ``_file``. Sketches of files that are gone are left out. The store is a folder of generations; a new one is written
    whole (sketches are small) before the last is forgotten, so a failed update loses nothing.
    """
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    now = persisted(listing.select(plain(F.col("path")).alias("part"), F.col("path").alias("_path"), F.struct("length", "modificationTime").alias("stamp")))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(store)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = files.globStatus(hadoop.Path(f"{store}/generation=*/_SUCCESS")) or []
    done = sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in whole)
    old = spark.read.parquet(f"{store}/generation={done[-1]}") if done else None
    asked = now if old is None else now.join(old.select("part", "stamp").distinct(), ["part", "stamp"], "left_anti")
    paths = [r["_path"] for r in asked.select("_path").collect()]
    kept = None if old is None else old.join(now.select("part", "stamp"), ["part", "stamp"], "left_semi")
    if paths:
        fresh = distinct_sketches(read(paths), columns, plain(F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))))).join(now.select("part", "stamp"), "part")
        fresh = fresh.select("part", "stamp", "column", "rows", "blanks", "sketch")
        kept = fresh if kept is None else kept.select(*fresh.columns).unionByName(fresh)
    if kept is None:
        return now.select("part", "stamp", F.lit("").alias("column"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("blanks"), F.lit(b"").alias("sketch")).limit(0)
    number = done[-1] + 1 if done else 0
    kept.write.parquet(f"{store}/generation={number}")
    for n in done:
        files.delete(hadoop.Path(f"{store}/generation={n}"), True)
    return spark.read.parquet(f"{store}/generation={number}")


def heavy_hitters(df: DataFrame, column: str, k: int = 50, counters: int = 1_024) -> DataFrame:
    """value, count, proven: the k most frequent values, counted exactly; count descending, then value.

    A task keeps at most ``counters`` values; when it meets more, all counts go down by the one that is too many, and what
    was taken away is added up. So no value is counted short by more than the sum of these over all tasks. A second
    pass counts the values that can still be among the first k. ``proven``: the k-th count is larger than anything that
    was left out can have, so value and count are those of a full count (always, if no task met more values than
    counters); else a full count may hold others, with at most ``bound`` rows each, which is told beside.
    """
    require(df, [column])
    if k < 1 or counters < k:
        raise ValueError("k must be at least 1 and at most the number of counters")
    values = df.filter(~blank_of(df, column)).select(strip(text_of(df, column)).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        lost = 0
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            held.update(dict(zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist())))
            if len(held) > counters:
                least = sorted(held.values(), reverse=True)[counters]
                lost += least
                held = Counter({v: n - least for v, n in held.items() if n > least})
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), lost], pa.int64())], names=["value", "n"])

    told = persisted(values.mapInArrow(run, "value string, n long").groupBy("value").agg(F.sum("n").alias("n")))
    missing = told.filter("value IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = told.filter("value IS NOT NULL")
    floor = first.orderBy(F.desc("n")).limit(k).agg(F.min("n"), F.count(F.lit(1))).first()
    if floor[1] == k:  # what may have more rows than the k-th surely has
        first = first.filter(F.col("n") + missing >= floor[0])
    size = first.agg(F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0))).first()[0]
    asked = F.broadcast(first.select("value")) if size <= BROADCAST_BYTES else first.select("value")
    exact = values.join(asked, "value").groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)
    exact = persisted(exact)
    ends = exact.agg(F.min("count"), F.count(F.lit(1))).first()
    proven = missing == 0 or (ends[1] == k and ends[0] > missing)
    return exact.select("value", "count", F.lit(proven).alias("proven"), F.lit(missing).cast("long").alias("bound")).orderBy(F.desc("count"), "value")
