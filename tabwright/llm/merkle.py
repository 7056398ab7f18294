"""Merkle manifest of a dataset: postorder append logs, made by aligned builders.

A row's leaf is the digest of its fields, each written with its length. Leaves of a part (a source, say) are ordered by
key; every FAN consecutive nodes become a node of the next level, the last run being shorter, until one is left: the
part's root. The roots of the parts, in order, become the dataset's root likewise.

A builder takes an aligned block of FAN ** LEVELS leaves and appends nodes to its log as they are completed: children
before their parent. What such a log holds before a node follows from the sizes of the subtrees to its left, in closed
form, so a proof needs no tree: the siblings of a node are read from the log by position. The last nodes of the blocks
are the leaves of the next round of builders, and a round has FAN ** LEVELS times fewer rows; paths go down the rounds
again, and a block adds its own siblings to those above it, which all its leaves share. So a part of any size is many
blocks, each of them one row, and no task holds more than a block of a part. Parts are themselves the leaves of one
more tree that is built in the same way, however many there are.

Null fields are written as "-" and differ from empty ones. Rows are ordered by part and key, null first, and rows that
share them by their leaf; rows that repeat are leaves of their own. A table without rows has no root and gives an empty
result; a lone row's leaf is its root and its proof is empty. Texts may be of any length (only digests are moved), and
other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import read, saved, sized, tidy
from tabwright.operators.order import with_position

#: Children of a node, and the levels that a builder adds above its leaves.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
_PATH = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("others", T.StringType())]))


def field(c: Column) -> Column:
    """A value with its length in bytes, "-" if null."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, fields)), "UTF-8"), 256)


# --- positions ------------------------------------------------------------------------------------------------------


def levels_over(leaves: int) -> int:
    """Levels above so many leaves, up to where one node is left."""
    top = 0
    while FAN**top < leaves:
        top += 1
    return top


def subtree_size(leaves: int, level: int) -> int:
    """Nodes of a subtree whose root, on that level, has so many leaves under it."""
    return sum(-(-leaves // FAN**i) for i in range(level + 1))


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Where the log of a tree has a node: after the subtrees that are completed to its left, and the rest of its own."""
    start = index * FAN**level
    return sum(start // FAN**i for i in range(top + 1)) + subtree_size(min(FAN**level, leaves - start), level) - 1


def _hash(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def append_log(leaves: list[bytes], top: int) -> bytes:
    """The digests (32 bytes each) of a block's nodes, in the order in which they are completed; the last one is the root."""
    log, open_ = [], [[] for _ in range(top + 1)]

    def complete(level: int, digest: bytes) -> None:
        log.append(digest)
        open_[level].append(digest)
        if len(open_[level]) == FAN and level < top:
            close(level)

    def close(level: int) -> None:
        run = b"".join(open_[level])
        open_[level] = []
        complete(level + 1, _hash(run.hex()))

    for digest in leaves:
        complete(0, digest)
    for level in range(top):
        if open_[level]:
            close(level)
    return b"".join(log)


def siblings(log: bytes, leaves: int, top: int) -> Iterator[list[tuple[int, str]]]:
    """Of each leaf of a block: by level, its place in the run and the other nodes' digests, read from the log by their positions."""
    runs: dict[tuple[int, int], list[str]] = {}

    def run_of(level: int, run: int) -> list[str]:
        if (level, run) not in runs:
            last = min((run + 1) * FAN, -(-leaves // FAN**level))
            runs[level, run] = [log[32 * p : 32 * p + 32].hex() for p in (position(level, i, leaves, top) for i in range(run * FAN, last))]
        return runs[level, run]

    for i in range(leaves):
        path = []
        for level in range(top):
            at = i // FAN**level
            run = run_of(level, at // FAN)
            place = at % FAN
            path.append((place, "".join(run[:place] + run[place + 1 :])))
        yield path


def fold(digest: str, path: list[tuple[int, str]]) -> str:
    """The root that follows from a leaf and the siblings on its way up."""
    for place, others in path:
        digest = hashlib.sha256((others[: 64 * place] + digest + others[64 * place :]).encode()).hexdigest()
    return digest


# --- trees ----------------------------------------------------------------------------------------------------------


def _top(n: int) -> int:
    """Levels that a block of a tree of n leaves adds."""
    return LEVELS if n > BLOCK else levels_over(n)


def _built(blocks: DataFrame) -> DataFrame:
    """Adds log; blocks: tree, block, n (leaves of the tree), members (array of structs with digest first), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = []
            for i in range(batch.num_rows):
                members = batch.column("members")[i].values
                logs.append(append_log(members.field("digest").to_pylist(), _top(batch.column("n")[i].as_py())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.binary())], names=[*batch.schema.names, "log"])

    return blocks.mapInArrow(tidy(run), T.StructType([*blocks.schema.fields, T.StructField("log", T.BinaryType())]))


def build(nodes: DataFrame, more: list[str]) -> list[DataFrame]:
    """The rounds of builders over trees; nodes: tree, at (0, 1.. in each tree), n (leaves of the tree), digest, and other columns that members keep.

    A round has one row per block: tree, block, n, members, log.
    """
    rounds: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        members = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest", *more))), lambda x: F.struct(x["digest"].alias("digest"), *[x[c].alias(c) for c in more]))
        blocks = nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.any_value("n").alias("n"), members.alias("members"))
        rounds.append(saved(_built(blocks)))
        if most <= BLOCK:
            return rounds
        most = -(-most // BLOCK)
        last = F.substring("log", -32, 32).alias("digest")
        nodes, more = rounds[-1].filter(F.col("n") > BLOCK).select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), last), []


def roots(rounds: list[DataFrame]) -> DataFrame:
    """tree, root."""
    found = [r.filter(F.col("n") <= BLOCK).select("tree", F.substring("log", -32, 32).alias("root")) for r in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _steps(path) -> list[tuple[int, str]]:
    return [(x["place"], x["others"]) for x in path]


def below(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first round's blocks, each with above: the path from its last node up to the end; tops: tree, path (from each tree's root on)."""

    def paths(rows: DataFrame) -> DataFrame:
        """tree, at, path of the members of blocks with their above."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    above = row["above"]
                    own = [[{"place": p, "others": o} for p, o in path] + above for path in siblings(row["log"], row["leaves"], _top(row["n"]))]
                    at = range(row["block"] * BLOCK, row["block"] * BLOCK + len(own))
                    yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(own), pa.int64()), pa.array(at, pa.int64()), pa.array(own, kind)], names=["tree", "at", "path"])

        kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
        schema = T.StructType([T.StructField("tree", T.LongType()), T.StructField("at", T.LongType()), T.StructField("path", _PATH)])
        return rows.select("tree", "block", "n", F.size("members").alias("leaves"), "log", "above").mapInArrow(tidy(run), schema)

    known: DataFrame | None = None
    for each in reversed(rounds):
        rows = each.filter(F.col("n") <= BLOCK).join(tops.withColumnRenamed("path", "above"), "tree")
        if known is not None:
            inner = each.filter(F.col("n") > BLOCK).join(known.select("tree", F.col("at").alias("block"), F.col("path").alias("above")), ["tree", "block"])
            rows = rows.unionByName(inner.select(*rows.columns))
        if each is rounds[0]:
            return rows
        known = saved(paths(rows))
    raise AssertionError


@dataclass(frozen=True)
class Manifest:
    """The trees of the parts and of their roots. parts: part, tree, n, subroot, path (from the part's root up); root: the dataset's, None without rows."""

    rounds: list[DataFrame]
    parts: DataFrame
    root: str | None

    def log(self) -> DataFrame:
        """tree, level, index, position (in the append log of its tree), digest of every node of the parts' trees."""
        out = None
        for number, each in enumerate(self.rounds):

            def run(batches: Iterator[pa.RecordBatch], base: int = number * LEVELS) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        top, first = _top(row["n"]), row["block"] * BLOCK
                        nodes = sorted((position(level, i, row["leaves"], top), level, i) for level in range(base > 0, top + 1) for i in range(-(-row["leaves"] // FAN**level)))
                        whole = levels_over(row["all"])
                        level = [base + x for _, x, _ in nodes]
                        index = [first // FAN**x + i for _, x, i in nodes]
                        where = [position(x, i, row["all"], whole) for x, i in zip(level, index)]
                        digests = [row["log"][32 * p : 32 * p + 32].hex() for p, _, _ in nodes]
                        yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(nodes), pa.int64()), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(where, pa.int64()), pa.array(digests, pa.string())], names=["tree", "level", "index", "position", "digest"])

            rows = each.join(self.parts.select("tree", F.col("n").alias("all")), "tree").select("tree", "block", "n", F.size("members").alias("leaves"), "log", "all")
            made = rows.mapInArrow(tidy(run), "tree long, level int, index long, position long, digest string")
            out = made if out is None else out.unionByName(made)
        return out

    def blocks(self) -> DataFrame:
        """Blocks of leaves with the path above them and the root of their part."""
        return below(self.rounds, self.parts.select("tree", "path")).join(sized(self.parts.select("tree", "subroot")), "tree")


def manifest(leaves: DataFrame, key: str, part: str, more: list[str]) -> Manifest:
    """leaves: the part, the key, _leaf (hex), and other columns that the blocks keep with each leaf."""
    # rows that repeat are dealt out by a number of their own
    rows = saved(leaves.select(F.col(part).alias("_of"), F.col(key).alias("_key"), "_leaf", F.monotonically_increasing_id().alias("_n"), *[F.col(c).alias(f"_m_{c}") for c in more]))
    rows = saved(with_position(rows, ["_of", "_key", "_leaf", "_n"], "_pos"))
    parts = rows.groupBy("_of").agg(F.min("_pos").alias("start"), F.count(F.lit(1)).alias("n"))
    parts = saved(with_position(parts, ["start"], "tree"))
    at = sized(parts.select(F.col("_of").alias("_of2"), "start", "n", "tree"))
    nodes = rows.join(at, F.col("_of").eqNullSafe(F.col("_of2"))).select("tree", (F.col("_pos") - F.col("start")).alias("at"), "n", F.unhex("_leaf").alias("digest"), *[F.col(f"_m_{c}").alias(c) for c in more])
    rounds = build(nodes, more)
    subroots = saved(roots(rounds))
    n = parts.count()
    up = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n).cast("long").alias("n"), F.col("root").alias("digest"), F.col("tree").alias("of")), ["of"])
    top = roots(up).first()
    whole = subroots.sparkSession.createDataFrame([(0, [])], T.StructType([T.StructField("tree", T.LongType()), T.StructField("path", _PATH)]))
    paths = _leaf_paths(below(up, whole))
    named = parts.select(F.col("_of").alias("part"), "tree", "n").join(subroots.select("tree", F.lower(F.hex("root")).alias("subroot")), "tree").join(paths, "tree")
    return Manifest(rounds, saved(named), bytes(top["root"]).hex() if top else None)


def _leaf_paths(rows: DataFrame) -> DataFrame:
    """tree, path of the members (of) of the topmost tree's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
        for batch in batches:
            for row in batch.to_pylist():
                own = [[{"place": p, "others": o} for p, o in path] + row["above"] for path in siblings(row["log"], len(row["of"]), _top(row["n"]))]
                yield pa.RecordBatch.from_arrays([pa.array(row["of"], pa.int64()), pa.array(own, kind)], names=["tree", "path"])

    schema = T.StructType([T.StructField("tree", T.LongType()), T.StructField("path", _PATH)])
    return rows.select("n", "log", "above", F.col("members").getField("of").alias("of")).mapInArrow(tidy(run), schema)


def proofs(made: Manifest, key: str, kind: T.DataType, other: str) -> DataFrame:
    """Of each leaf: key, leaf, subroot, proof (the siblings, level by level, as array of (place, others)), proof_sha256, folded_root (from ``other`` where it isn't null, else from the leaf). ``key`` and ``other`` are columns that the blocks keep."""
    names = ["key", "leaf", "subroot", "proof", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("n", "log", "above", "subroot")}
                members = batch.column("members")[i].values
                above = _steps(row["above"])
                end = "".join(o for _, o in above)
                leaves = [d.hex() for d in members.field("digest").to_pylist()]
                paths, digests, folded = [], [], []
                for own, instead, path in zip(leaves, members.field(other).to_pylist(), siblings(row["log"], len(leaves), _top(row["n"]))):
                    digests.append(_hash("".join(o for _, o in path) + end).hex())
                    folded.append(fold(instead or own, path + above))
                    paths.append(path + above)
                for a in range(0, len(leaves), 256):
                    own = slice(a, a + 256)
                    lists = pa.array([[{"place": p, "others": o} for p, o in path] for path in paths[own]], steps)
                    yield pa.RecordBatch.from_arrays([members.field(key)[own], pa.array(leaves[own]), pa.array([row["subroot"]] * len(leaves[own])), lists, pa.array(digests[own]), pa.array(folded[own])], names=names)

    schema = T.StructType([T.StructField("key", kind), T.StructField("leaf", T.StringType()), T.StructField("subroot", T.StringType()), T.StructField("proof", _PATH), T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())])
    return made.blocks().select("n", "log", "above", "subroot", "members").mapInArrow(tidy(run), schema)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those whose id's checksum 5 divides are folded from a tampered leaf."""
    docs = read(spark, sf_dir, "documents")
    own = ["doc_id", "source", "lang", "n_chars"]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in own]
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, leaf([*fields, low]))
    rows = docs.select("doc_id", "source", leaf([*fields, F.col("text")]).alias("_leaf"), tampered.alias("tampered"))
    made = manifest(rows, "doc_id", "source", ["doc_id", "tampered"])
    found = proofs(made, "doc_id", docs.schema["doc_id"].dataType, "tampered")
    root = F.lit(made.root).cast("string")
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS c FROM documents
), h AS (
  SELECT doc_id, source, sha256(array_to_string([CASE WHEN x IS NULL THEN '-' ELSE CAST(strlen(x) AS VARCHAR) || ':' || x END FOR x IN c], '')) AS leaf,
    sha256(array_to_string([CASE WHEN x IS NULL THEN '-' ELSE CAST(strlen(x) AS VARCHAR) || ':' || x END FOR x IN c[:4] || [translate(c[5], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')]], '')) AS low,
    list_reduce([4294967295::UBIGINT] || [ascii(z)::UBIGINT FOR z IN string_split(CAST(doc_id AS VARCHAR), '')], lambda crc, b: list_reduce([xor(crc, b)] || [0::UBIGINT FOR i IN range(8)], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)) AS crc
  FROM f
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN low ELSE leaf END AS held FROM h
), t0 AS (SELECT source, pos, leaf AS d FROM leaves
), t1 AS (SELECT source, pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM t0 GROUP BY source, pos // 16
), t2 AS (SELECT source, pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM t1 GROUP BY source, pos // 16
), t3 AS (SELECT source, pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM t2 GROUP BY source, pos // 16
), t4 AS (SELECT source, pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM t3 GROUP BY source, pos // 16
), t5 AS (SELECT source, pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM t4 GROUP BY source, pos // 16
), nodes AS (
  SELECT 0 AS level, * FROM t0 UNION ALL SELECT 1, * FROM t1 UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 3, * FROM t3 UNION ALL SELECT 4, * FROM t4 UNION ALL SELECT 5, * FROM t5
), tops AS (
  SELECT source, min(level) AS top FROM (SELECT source, level FROM nodes GROUP BY source, level HAVING count(*) = 1) GROUP BY source
), s0 AS (
  SELECT nodes.source, row_number() OVER (ORDER BY nodes.source NULLS FIRST) - 1 AS pos, d FROM nodes JOIN tops ON nodes.source IS NOT DISTINCT FROM tops.source AND level = top
), s1 AS (SELECT pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM s0 GROUP BY pos // 16
), s2 AS (SELECT pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM s1 GROUP BY pos // 16
), s3 AS (SELECT pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM s2 GROUP BY pos // 16
), up AS (
  SELECT 0 AS level, pos, d FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3
), ends AS (
  SELECT min(level) AS top FROM (SELECT level FROM up GROUP BY level HAVING count(*) = 1)
), steps AS (
  SELECT x.source, x.level AS step, x.pos, (SELECT list(y.d ORDER BY y.pos) FROM nodes y WHERE y.source IS NOT DISTINCT FROM x.source AND y.level = x.level AND y.pos // 16 = x.pos // 16) AS run
  FROM nodes x JOIN tops ON x.source IS NOT DISTINCT FROM tops.source AND x.level < tops.top
), higher AS (
  SELECT x.level AS step, x.pos, (SELECT list(y.d ORDER BY y.pos) FROM up y WHERE y.level = x.level AND y.pos // 16 = x.pos // 16) AS run FROM up x, ends WHERE x.level < ends.top
), ways AS (
  SELECT l.doc_id, l.leaf, l.source, l.pos AS own, s.step, s.pos % 16 AS place, s.run FROM leaves l JOIN steps s ON l.source IS NOT DISTINCT FROM s.source AND s.pos = l.pos // CAST(pow(16, s.step) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.source, l.pos, 100 + s.step, s.pos % 16, s.run FROM leaves l JOIN s0 ON l.source IS NOT DISTINCT FROM s0.source JOIN higher s ON s.pos = s0.pos // CAST(pow(16, s.step) AS BIGINT)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, own ORDER BY step) AS k, run[:place] || run[place + 2:] AS others FROM ways
), fold(source, own, k, d) AS (
  SELECT source, pos, 0::BIGINT, held FROM leaves
  UNION ALL
  SELECT f.source, f.own, n.k, sha256(array_to_string(n.run[:n.place] || [f.d] || n.run[n.place + 2:], '')) FROM fold f JOIN numbered n ON n.source IS NOT DISTINCT FROM f.source AND n.own = f.own AND n.k = f.k + 1
), folded AS (
  SELECT source, own, arg_max(d, k) AS d FROM fold GROUP BY ALL
), proof AS (
  SELECT source, own, sha256(string_agg(array_to_string(others, ''), '' ORDER BY k)) AS p FROM numbered GROUP BY ALL
), root AS (
  SELECT d FROM up, ends WHERE level = top
)
SELECT l.doc_id, l.leaf, s0.d AS subroot, root.d AS root, coalesce(p.p, sha256('')) AS proof_sha256, folded.d AS folded_root, folded.d = root.d AS verified
FROM leaves l JOIN s0 ON l.source IS NOT DISTINCT FROM s0.source JOIN folded ON folded.source IS NOT DISTINCT FROM l.source AND folded.own = l.pos LEFT JOIN proof p ON p.source IS NOT DISTINCT FROM l.source AND p.own = l.pos, root
"""
