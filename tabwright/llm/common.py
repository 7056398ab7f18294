"""Small helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.order import shared_folder

#: A side table is broadcast if its values come to at most so many bytes, which is measured; else the join is shuffled.
BROADCAST_BYTES = 48 << 20
#: UTF-8 bytes that a Python task works on at a time; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already saved), marked for broadcast if it is within the bound; an aggregate over it measures that."""
    total = F.count(F.lit(1)) * (16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            total = total + F.coalesce(F.sum(F.greatest(F.size(field.name), F.lit(0))), F.lit(0)) * (24 if isinstance(field.dataType.elementType, T.StructType) else 8)
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.sum(F.octet_length(field.name)), F.lit(0))
    return F.broadcast(df) if df.agg(total).first()[0] <= most else df


def replacing(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns whose place an operator's own output columns take."""
    taken = {n.lower() for n in names}
    return df.drop(*[F.col(f"`{c}`") for c in df.columns if c.lower() in taken])


def packed(df: DataFrame, without: list[str]):
    """All columns but some as one struct, so that their names can't meet an operator's own; ``unpacked`` gives them back."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.struct(*keep) if keep else F.struct(F.lit(0).alias("_none"))


def unpacked(df: DataFrame, of: DataFrame, without: list[str], made: dict) -> DataFrame:
    """The columns of ``of`` from the struct ``_keep``, then the made ones, which take the place of columns of their names."""
    taken = {n.lower() for n in made}
    kept = [F.col("_keep").getField(c).alias(c) for c in of.columns if c not in without and c.lower() not in taken]
    return df.select(*kept, *[x.alias(n) for n, x in made.items()])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def stripped(column):
    """A native copy without ``[\\x20\\x09-\\x0D]``; chained byte replacements are several times faster than translate()."""
    for space in SPACES:
        column = F.replace(column, F.lit(space), F.lit(""))
    return column


def sha(column):
    return F.sha2(F.encode(column, "UTF-8"), 256)


def tidy(run):
    """Wraps a function for mapInArrow: when its partition is done, freed memory goes back to the system. Python workers live on from stage to stage, and would otherwise keep the most that any of them took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # a libc without malloc_trim
                    ctypes.CDLL(None).malloc_trim(0)

    return whole


def chunks(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with at most ``most`` bytes each (or one row)."""
    ends = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    at = 0
    while at < len(array):
        to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        yield at, (at := min(max(to, at + 1), len(array)))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls, null being the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("").cast(pa.string())


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets of its texts in them."""
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words (runs of other bytes than 0x20) of texts that lie side by side, as one binary array, and the texts' offsets in it."""
    solid = data != 32
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    at = np.append(0, np.cumsum(solid))
    ends = np.append(at[starts], at[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[solid]))])
    return words, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
