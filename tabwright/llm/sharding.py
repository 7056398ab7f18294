"""Sharding by a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Law ``rows``: every shard's bound is its exact share (floor(n / shards), and one more for the first n mod shards), so
counts are at most one apart. The ring has ``1 << ring_bits`` slots; each shard owns ``virtual`` of them, and a key
belongs to the first virtual node at or after its hash. Keys past a shard's bound go on clockwise.

The keys of an arc are dealt to cells by the CRC of their texts. Only the number of keys of each cell (shards * virtual
* CELLS rows, whatever the input) reaches the driver, where arcs are cut into ranges of ranks; ranks are counted cell by
cell, and each row then finds its own range through a broadcast join of that bounded table. So rows that share an id,
or have none, spread over the cells of one arc; a cell with many times its share, which rows that repeat id and text
make, is cut further by the number of the row.

Null texts have no bytes (size is the overhead alone, CRC 0). Rows with a null id share the hash of null; repeated rows
each get their own slot. Texts may be of any length; columns besides the key and the text are left out. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import read, saved

SHARDS, VIRTUAL, RING_BITS, OVERHEAD = 40, 64, 16, 16
#: Cells of an arc, the parts that a crowded cell is cut into, and how many times the mean makes one crowded (and at
#: least so many rows). At most one cell in CROWD can be.
CELLS, PARTS, CROWD, CROWD_ROWS = 16, 64, 16, 50_000


def ring(shards: int, virtual: int, ring_bits: int) -> list[tuple[int, int]]:
    """(slot, shard) of the virtual nodes, clockwise; a slot that is taken sends a node to the next free one."""
    size, taken = 1 << ring_bits, {}
    for node in range(virtual):
        for shard in range(shards):
            slot = (shard * 0x9E3779B97F4A7C15 + node * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % (1 << 64)
            slot = ((slot ^ slot >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)) >> (64 - ring_bits)
            while slot in taken:
                slot = (slot + 1) % size
            taken[slot] = shard
    return sorted(taken.items())


def ranges(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot in the shard): who takes which keys of each arc.

    First every arc fills its own shard, in ring order, as far as the bound allows; then what overflows goes on
    clockwise from its arc. A shard's bound is reached or all keys are placed, so nothing is left over.
    """
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out = []

    def take(arc: int, rank: int, n: int, shard: int) -> None:
        out.append((arc, rank, rank + n, shard, filled[shard]))
        free[shard] -= n
        filled[shard] += n

    over: deque[tuple[int, int, int]] = deque()
    for arc, owner in enumerate(owners):
        n = counts.get(arc, 0)
        own = min(n, free[owner])
        if own:
            take(arc, 0, own, owner)
        if n > own:
            over.append((arc, own, n - own))
    while over:
        arc, rank, n = over.popleft()
        for step in range(1, len(owners)):
            shard = owners[(arc + step) % len(owners)]
            if n and free[shard]:
                some = min(n, free[shard])
                take(arc, rank, some, shard)
                rank, n = rank + some, n - some
    return out


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, virtual: int = VIRTUAL, ring_bits: int = RING_BITS, crowd_rows: int = CROWD_ROWS) -> DataFrame:
    """One row per row: the key, size (UTF-8 bytes + overhead), text_crc32, law, shard, slot (0.. in the shard), grown_shard (null)."""
    spark = df.sparkSession
    nodes = ring(shards, virtual, ring_bits)
    slots, owners = [slot for slot, _ in nodes], [shard for _, shard in nodes]
    arcs = [bisect.bisect_left(slots, i) % len(nodes) for i in range(1 << ring_bits)]
    binary = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    arc_of = F.broadcast(spark.createDataFrame(list(enumerate(arcs)), "_place int, _arc int"))
    keyed = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(binary) + OVERHEAD).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        F.xxhash64(key).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_place", F.shiftrightunsigned("_hash", 64 - ring_bits).cast("int"))
    cell = (F.pmod("text_crc32", F.lit(CELLS)) * PARTS).cast("int").alias("_cell")
    keyed = saved(keyed.join(arc_of, "_place").select("_key", "size", "text_crc32", "_hash", "_row", "_arc", cell))
    cells = {(r["_arc"], r["_cell"]): r["n"] for r in keyed.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    crowded = [c for c, n in cells.items() if n > max(crowd_rows, CROWD * sum(cells.values()) / (len(nodes) * CELLS))]
    if crowded:
        marked = F.broadcast(spark.createDataFrame(crowded, "_arc int, _cell int").withColumn("_crowded", F.lit(True)))
        keyed = keyed.join(marked, ["_arc", "_cell"], "left").withColumn("_cell", F.when(F.col("_crowded"), F.col("_cell") + F.pmod("_row", F.lit(PARTS)).cast("int")).otherwise(F.col("_cell"))).drop("_crowded")
        more = keyed.filter(F.col("_cell") % PARTS != 0).groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("n")).collect()
        for r in more:
            cells[r["_arc"], r["_cell"]] = r["n"]
            cells[r["_arc"], r["_cell"] // PARTS * PARTS] -= r["n"]
    counts: dict[int, int] = {}
    before = []
    for (arc, c), n in sorted(cells.items()):
        before.append((arc, c, counts.get(arc, 0)))
        counts[arc] = counts.get(arc, 0) + n
    cut = spark.createDataFrame(ranges(counts, owners, shards), "_of int, _from long, _to long, shard int, _slot long")
    starts = F.broadcast(spark.createDataFrame(before, "_arc int, _cell int, _before long"))
    rank = F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy("_hash", "_key", "text_crc32", "size", "_row")).cast("long")
    ranked = keyed.withColumn("_own", rank).join(starts, ["_arc", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    found = ranked.join(F.broadcast(cut), (F.col("_arc") == F.col("_of")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return found.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"))
