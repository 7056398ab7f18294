"""Exact dedup of a new batch against an immutable snapshot.

Texts are equal when their copies without ``[\\x20\\x09-\\x0D]`` are. Per snapshot a static binary-fuse filter (8-bit
fingerprints, about 9 bits a key) is built for every bucket of the digest space, once: a snapshot's groups and filters
can be written and read again for every later batch. Incoming digests that their bucket's filter rules out are new, the
rest join the snapshot's groups exactly and are confirmed byte by byte. Copies inside the incoming batch are grouped by
digest on their own first, so neither side meets a key twice and a group of any size shrinks to one row before the
shuffle.

Of equal texts the row with the most code points in the original text stays, then the smallest id (null ids last); of
rows that also share the id, one, which is marked kept alone. Rows are told apart by numbers of their own, never by
their ids, so null ids and ids that repeat, with equal or other texts and of any type, count row by row. Null texts
count as empty, so they equal texts of white space. Texts may be of any length; columns besides the key and the text
are left out. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import mix, read, saved, sha, sized, stripped, text_or_empty

#: Digests that one filter holds on average; the number of buckets follows the snapshot's size.
KEYS_PER_FILTER = 65_536


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """_id, _row (a number of the row), digest (SHA-256, binary), n_chars (code points of the original text) and columns of ``df``, from one scan."""
    whole = text_or_empty(text)
    return df.select(F.col(key).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.unhex(sha(stripped(whole))).alias("digest"), F.char_length(whole).cast("long").alias("n_chars"), *more)


def _keys(digests: pd.Series) -> np.ndarray:
    """64 bits of each digest that the bucket doesn't depend on."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), np.uint64)


def _layout(n: int) -> tuple[int, int]:
    """Length (a power of two) and number of the overlapping segments."""
    length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    length = min(length, 1 << 18)
    capacity = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) + 32
    return length, max(1, int(np.ceil(capacity / length)) - 2)


def _slots(keys: np.ndarray, seed: int, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in neighbouring segments, and its 8-bit fingerprint."""
    h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    g = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    mask = np.uint64(length - 1)
    within = np.stack([g & mask, (g >> np.uint64(20)) & mask, (g >> np.uint64(40)) & mask])
    segments = first[None, :] + np.arange(3, dtype=np.uint64)[:, None]
    return (segments * np.uint64(length) + within).astype(np.int64), (h & np.uint64(255)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a binary-fuse filter over distinct 64-bit keys.

    Peels all slots that hold one key at once, round after round, then fills the slots in reverse order.
    """
    keys = np.unique(keys)
    length, count = _layout(len(keys))
    for seed in range(200):
        slots, prints = _slots(keys, seed, length, count)
        size = (count + 2) * length
        degree = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # xor of the keys' numbers, so a slot of degree 1 names its key
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(len(keys)))
        order: list[tuple[np.ndarray, np.ndarray]] = []
        frontier, left = np.flatnonzero(degree == 1), len(keys)
        while len(frontier):
            which, at = np.unique(held[frontier], return_index=True)
            own = frontier[at]
            order.append((which, own))
            left -= len(which)
            touched = slots[:, which]
            for row in touched:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(held, row, which)
            frontier = np.unique(touched)
            frontier = frontier[degree[frontier] == 1]
        if not left:
            table = np.zeros(size, np.uint8)
            for which, own in reversed(order):
                three = slots[:, which]
                table[own] = prints[which] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]] ^ table[own]
            return seed, length, count, table.tobytes()
    raise RuntimeError("no seed gave a filter")


def may_contain(keys: np.ndarray, seed: int, length: int, count: int, fingerprints: bytes) -> np.ndarray:
    if not len(keys):
        return np.zeros(0, bool)
    table = np.frombuffer(fingerprints, np.uint8)
    slots, prints = _slots(keys, seed, length, count)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(F.substring("digest", 1, 8)), F.lit(buckets)).cast("int"))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """bucket, seed, length, count, fingerprints: one row per bucket of the snapshot's (distinct) digests."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        seed, length, count, table = build_fuse(_keys(frame["digest"]))
        return pd.DataFrame({"bucket": [frame["bucket"].iloc[0]], "seed": [seed], "length": [length], "count": [count], "fingerprints": [table]})

    return with_bucket(snapshot.select("digest"), buckets).groupBy("bucket").applyInPandas(build, "bucket int, seed int, length int, count int, fingerprints binary")


def parts_of_bucket(incoming: int, buckets: int) -> int:
    """Parts in which each bucket's incoming digests are dealt, so that a part has about as many as a filter holds."""
    return max(1, -(-incoming // (buckets * KEYS_PER_FILTER)))


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming (distinct) digests that the snapshot's filters don't rule out.

    Where they are more than the snapshot's buckets hold, a bucket is dealt in as many parts as its share of them asks
    for, and each part gets a copy of the bucket's filter, so no task reads many times what a filter holds.
    """
    salts = parts_of_bucket(incoming.count(), buckets)

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return left.iloc[:0]
        row = right.iloc[0]
        return left[may_contain(_keys(left["digest"]), int(row["seed"]), int(row["length"]), int(row["count"]), row["fingerprints"])]

    own = with_bucket(incoming, buckets).withColumn("salt", F.pmod(F.xxhash64(F.substring("digest", 9, 8)), F.lit(salts)).cast("int"))
    copies = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return own.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInPandas(probe, own.schema).drop("salt")


def _best() -> Column:
    """Of rows the one that stays has the least of these."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Snapshot:
    """groups: digest, best, n. filters: see ``build_filters``. source: the rows (key, text) whose bytes confirm a match."""

    groups: DataFrame
    filters: DataFrame
    buckets: int
    source: DataFrame

    def write(self, path: str) -> None:
        """Writes groups and filters; the source is the caller's own table."""
        self.groups.write.parquet(f"{path}/groups")
        self.filters.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/filters")


def read_snapshot(spark: SparkSession, path: str, source: DataFrame) -> Snapshot:
    """A written snapshot; its filters are not built again. ``source`` is the table it was built of."""
    filters = spark.read.parquet(f"{path}/filters")
    buckets = filters.agg(F.max("buckets")).first()[0]
    return Snapshot(spark.read.parquet(f"{path}/groups"), filters.drop("buckets"), buckets or 1, source)


def build_snapshot(df: DataFrame, key: str = "doc_id", text: str = "text", keys_per_filter: int = KEYS_PER_FILTER) -> Snapshot:
    return _snapshot(saved(digests(df, key, text)), df, keys_per_filter)


def _snapshot(rows: DataFrame, source: DataFrame, keys_per_filter: int) -> Snapshot:
    groups = saved(_groups(rows))
    buckets = max(1, -(-groups.count() // keys_per_filter))
    return Snapshot(groups, saved(build_filters(groups, buckets)), buckets, source)


def _sample_texts(df: DataFrame, wanted: DataFrame, text: str, name: str) -> DataFrame:
    """digest and a normalised text that has it, for the wanted digests."""
    own = df.select(stripped(text_or_empty(text)).alias(name)).withColumn("digest", F.unhex(sha(F.col(name))))
    return own.join(sized(wanted), "digest", "left_semi").groupBy("digest").agg(F.min(name).alias(name))


def match(new: DataFrame, batch: DataFrame, snapshot: Snapshot, text: str = "text") -> DataFrame:
    """digest, was, n_was: of the batch's groups those whose text is in the snapshot, byte for byte, with the snapshot's best row and number of rows."""
    met = saved(screen(new.select("digest"), snapshot.filters, snapshot.buckets).select("digest"))
    exact = saved(met.join(snapshot.groups.select("digest", F.col("best").alias("was"), F.col("n").alias("n_was")), "digest"))
    wanted = exact.select("digest")
    texts = _sample_texts(snapshot.source, wanted, text, "_old").join(_sample_texts(batch, wanted, text, "_new"), "digest")
    return exact.join(texts.filter(F.col("_old") == F.col("_new")).select("digest"), "digest")


def ingest_batch(batch: DataFrame, snapshot: Snapshot, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the batch: key, kept (the first of its text, which the snapshot doesn't have), met (whether the snapshot has it), keep_id (of the batch or the snapshot), group_size (in both)."""
    rows = saved(digests(batch, key, text))
    new = saved(_groups(rows))
    found = new.join(match(new, batch, snapshot, text), "digest", "left").withColumn("met", F.col("was").isNotNull())
    stays = F.when(F.col("met"), F.col("was.id")).otherwise(F.col("best.id"))
    found = found.select("digest", F.col("best.row").alias("_first"), "met", stays.alias("keep_id"), (F.col("n") + F.coalesce("n_was", F.lit(0))).alias("group_size"))
    return rows.join(found, "digest").select(F.col("_id").alias(key), (~F.col("met") & (F.col("_row") == F.col("_first"))).alias("kept"), "met", "keep_id", "group_size")


def ingest(df: DataFrame, in_snapshot: Column, key: str = "doc_id", text: str = "text", keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """Dedups the rows of ``df`` outside ``in_snapshot`` (a boolean Column over its columns) against those inside and each other, and those inside against all.

    Returns one row per row: key, keep_id, group_size, kept, digest, met (whether an incoming row's text was in the snapshot).
    """
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    marked = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(in_snapshot, F.lit(False)).alias("_old"))
    rows = saved(digests(marked, "_key", "_text", "_old"))
    snapshot = _snapshot(rows.filter("_old"), marked.filter("_old"), keys_per_filter)
    new = saved(_groups(rows.filter("NOT _old")))
    shared = saved(match(new, marked.filter("NOT _old"), snapshot, "_text"))
    # a digest that both sides have without the same bytes stays two groups: groups go by digest and side
    both = new.join(shared, "digest").select("digest", F.least("best", "was").alias("best"), (F.col("n") + F.col("n_was")).alias("n"))
    sides = lambda groups, old: groups.withColumn("_old", F.lit(old))
    alone = sides(snapshot.groups, True).unionByName(sides(new, False)).join(shared.select("digest"), "digest", "left_anti").withColumn("met", F.lit(False))
    groups = alone.unionByName(both.select("digest", "best", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("_old"), F.lit(True).alias("met")).select(*alone.columns))
    found = rows.join(groups, ["digest", "_old"])
    return found.select(F.col("_id").alias(key), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("best.row")).alias("kept"), "digest", (F.col("met") & ~F.col("_old")).alias("met"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents with an even hash of the id are the snapshot, the others the incoming batch."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = ingest(docs, F.xxhash64("doc_id").bitwiseAND(1) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h FROM documents
), g AS (
  SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS c FROM t GROUP BY h
)
SELECT t.doc_id, g.keep_id, CAST(g.c AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256 FROM t JOIN g USING (h)
"""
