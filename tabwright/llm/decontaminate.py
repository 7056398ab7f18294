"""Benchmark decontamination by word windows; DataFrame functions only.

Words are the runs of ``[a-z0-9]`` and non-ASCII characters after lower-casing A-Z. A window is 10 consecutive words
of a benchmark item (an item of fewer words, but not none, is one window). The set of windows is a broadcast hash
table behind a check of its bytes; beyond the bound the same windows are shuffled, without the other columns. So that
not every text window has to be built, a byte map over a hash of a window's first two words (first word for one-word
windows) screens positions, whatever the number of windows; windows at positions that pass are compared as whole
strings, so hits are exact.

Null and empty texts have no words and no hits; null item ids never count as items, their windows still hit. Texts and
words may be of any length. Each input row gives one output row, repeated rows, ids and null ids included; outputs take
the place of columns of their names, other columns stay. Benchmark items without words are ignored; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm import common
from tabwright.llm.common import packed, read, saved, sized, unpacked

WINDOW = 10
#: The byte map has 16 places a window, between these sizes.
LEAST_BITS, MOST_BITS = 18, 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is no part of a word. Case doesn't matter for where words end, so splitting needs no lower-casing.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """Lower-cases A-Z alone; lower() does just that on pure ASCII, and is faster."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def _place(array: Column, at: Column) -> Column:
    """A hash of the first two words from ``at`` (1-based). A lone last word pairs with null, which hashes as if absent."""
    return F.xxhash64(F.get(array, at - 1), F.get(array, at))


def _lone(array: Column, at: Column) -> Column:
    return F.xxhash64(F.get(array, at - 1))


def _in_map(hash_: Column, bits: int) -> Column:
    return hash_.bitwiseAND((1 << bits) - 1).cast("int")


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """gram (words joined by one space), length, items (distinct item ids), place and lone (hashes of its first words)."""
    of = benchmark.select(F.col(item).cast("string").alias("_item"), words(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    n = F.size("_words")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    each = of.select("_item", "_words", F.explode(starts).alias("_at"))
    gram = F.slice("_words", F.col("_at"), window)
    return (
        each.select("_item", F.array_join(gram, " ").alias("gram"), F.size(gram).alias("length"), _place(gram, F.lit(1)).alias("place"), _lone(gram, F.lit(1)).alias("lone"))
        .groupBy("gram", "length", "place", "lone")
        .agg(F.collect_set("_item").alias("items"))
    )


def _marked(grams: DataFrame, n: int) -> tuple[list[int], list[tuple[bytes, object, int]]]:
    """The windows' lengths, and for windows of several words and of one the byte map with its hash and bits. At most 2 * 2 ** MOST_BITS places come to the driver."""
    bits = min(max(LEAST_BITS, (16 * n - 1).bit_length()), MOST_BITS)
    lengths = sorted(int(r[0]) for r in grams.select("length").distinct().collect())
    maps = []
    for name, own, hash_ in (("place", F.col("length") > 1, _place), ("lone", F.col("length") == 1, _lone)):
        marks = bytearray(1 << bits)
        for place in grams.filter(own).agg(F.collect_set(_in_map(F.col(name), bits))).first()[0]:
            marks[place] = 1
        if any(marks):
            maps.append((bytes(marks), hash_, bits))
    return lengths, maps


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, most_bytes: int | None = None) -> DataFrame:
    """``docs`` without the text, plus n_words, n_hit, items (sorted), spans (array of the first and last hit word of each occurrence, 1-based). The windows are broadcast up to ``most_bytes``."""
    grams = saved(windows(benchmark, window=window))
    size = F.octet_length("gram") + 64 + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16)
    n, n_bytes = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    small = n_bytes <= (common.BROADCAST_BYTES if most_bytes is None else most_bytes)
    base = docs.select(packed(docs, [text]).alias("_keep"), words(F.col(text)).alias("_words")).withColumn("_row", F.monotonically_increasing_id())
    made = lambda got: unpacked(got, docs, [text], {"n_words": F.col("n_words"), "n_hit": F.col("n_hit"), "items": F.col("items"), "spans": F.col("spans")})
    if not n:
        none = {"items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<first:int,last:int>>")}
        return made(base.withColumns({"n_words": F.size("_words").cast("long"), "n_hit": F.lit(0).cast("long"), **none}))
    lengths, maps = _marked(grams, n)

    def passes(i: Column) -> Column:
        tests = [F.substring(F.lit(marks), _in_map(hash_(F.col("_words"), i), bits) + 1, 1) == F.lit(b"\x01") for marks, hash_, bits in maps]
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]

    full = F.when(F.size("_words") >= lengths[0], F.sequence(F.lit(1), F.size("_words") - (lengths[0] - 1))).otherwise(F.array().cast("array<int>"))
    sizes = F.array(*[F.lit(x) for x in lengths])
    at = lambda i: F.filter(F.transform(sizes, lambda k: F.struct(i.alias("at"), k.alias("length"), F.array_join(F.slice("_words", i, k), " ").alias("gram"))), lambda x: x["at"] + x["length"] - 1 <= F.size("_words"))
    found = base.withColumn("_spots", F.filter(full, passes)).withColumn("_found", F.flatten(F.transform("_spots", at)))
    found = found.select("_keep", "_row", F.size("_words").cast("long").alias("n_words"), "_found")
    table = grams.select(F.col("gram").alias("_gram"), F.col("length").alias("_length"), "items")
    spot = [F.col("_at.at").alias("_at"), F.col("_at.length").alias("_length"), F.col("_at.gram").alias("_gram")]
    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("_at").alias("first"), (F.col("_at") + F.col("_length") - 1).alias("last")))
    hits = [F.sort_array(F.collect_list(hit)).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")]
    if small:
        rows = found.select("_keep", "_row", "n_words", F.explode_outer("_found").alias("_at")).select("_keep", "_row", "n_words", *spot)
        rows = rows.join(F.broadcast(table), ["_gram", "_length"], "left")
        grouped = rows.groupBy("_row").agg(F.first("_keep").alias("_keep"), F.first("n_words").alias("n_words"), *hits)
    else:
        # saved, so that row numbers stay; only places and windows that pass the screen are shuffled
        found = saved(found)
        rows = found.select("_row", F.explode("_found").alias("_at")).select("_row", *spot).join(table, ["_gram", "_length"])
        grouped = found.drop("_found").join(rows.groupBy("_row").agg(*hits), "_row", "left")
        grouped = grouped.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))))
    return made(grouped.withColumn("n_hit", n_hit.cast("long")))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))


def _same(docs: DataFrame, key: str, text: str, other: DataFrame) -> Column:
    return docs[key].eqNullSafe(other["__key"]) & (F.xxhash64(docs[text]) == other["__hash"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", most_share: float = 0.0) -> DataFrame:
    """``docs`` without the documents of which more than ``most_share`` of the words is hit; columns as they were. A document is a key (null ones, too) with a text."""
    marked = contamination(_named(docs, key, text), benchmark, "__text")
    bad = saved(marked.filter(F.col("n_hit") > most_share * F.col("n_words")).select("__key", "__hash").distinct())
    return docs.join(sized(bad), _same(docs, key, text, bad), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the hit words cut out: of a document with hits, the words left (lower-cased) are joined by one space; the others stay as they are."""
    marked = contamination(_named(docs, key, text), benchmark, "__text")
    hits = saved(marked.filter("n_hit > 0").select("__key", "__hash", F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))).alias("__hits")).dropDuplicates(["__key", "__hash"]))
    found = docs.join(sized(hits), _same(docs, key, text, hits), "left")
    # a variable holds the words, which are split once
    rest = lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(own)), "__hits"), lambda i: F.get(own, i - 1)), " ")
    left = F.get(F.transform(F.array(words(F.col(text))), rest), F.lit(0))
    return found.withColumn(text, F.when(F.col("__hits").isNull(), F.col(text)).otherwise(left)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i+9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT rid, k, i, array_to_string(w[i:i+k-1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
), h AS (
  SELECT p.rid, p.k, p.i, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.k = g.k
), n AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS j FROM h) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
