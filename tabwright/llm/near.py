"""MinHash near-dedup with min-max hashing.

A document's set is its distinct shingles of ``words`` consecutive words (``[^\\x20\\x09-\\x0D]+`` after lower-casing
A-Z); a shorter document is one shingle. Each permutation gives two signature values, its minimum and its maximum,
so 80 permutations (hash evaluations a shingle) fill 32 bands of 5 values; a pair of similarity 0.8 shares no band
with a chance of 3e-6. Links are then confirmed on the full sets, and documents linked through others form one group.

Work per group of copies stays linear: equal sets shrink to one class before banding, every band bucket compares its
members with one leader, and only members that are then still outside the bucket's largest component meet the
members of other components: all of them but those that a bound on shared shingles rules out, so no link between
different sets is lost. Sets are built for classes in shared buckets alone.

Words are known by 128-bit digests of their bytes and shingles by both halves of those: sets are told apart by all 128
bits of their shingles, and a link is confirmed on 112 of them. Bands take the first 64, since what they bring together
is confirmed.

Null and empty texts have an empty set and are linked with nothing. Repeated rows are copies of each other. Classes
have numbers of their own, so rows take part whatever their ids: an id that repeats, with equal or other texts, takes
part once per row, and a null id is larger than all others (a group of null ids alone has none). Texts may be of any
length; columns besides the key and the text stay with ``keep_one`` and are left out otherwise. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import chunks, flat, mix, read, saved, sized, strings, tidy, words_of
from tabwright.operators.graph import components

PERMUTATIONS, ROWS = 80, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a bucket beyond which its pairs are bounded first, and how many classes may share a rare shingle there.
CROWD, RARE = 64, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20_240_601)
_MULTIPLY = _random.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
#: Lower case of A-Z, and one space for all.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91], _PLAIN[9:14] = _PLAIN[97:123], 32
#: Of the two halves of a shingle.
_FACTORS = np.array([_ODD, 0xD6E8FEB86659FD93], np.uint64)


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, 2) halves of the digests of the words of texts that lie side by side, and the texts' offsets in them."""
    words, at = words_of(_PLAIN[data], offsets)
    coded = words.dictionary_encode()
    table = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist()]), np.uint64).reshape(-1, 2)
    return table[coded.indices.to_numpy()], at


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 64 bits of the words' digests, and the texts' offsets in them."""
    digests, at = word_digests(data, offsets)
    return digests[:, 0], at


def _distinct(shingles: np.ndarray) -> np.ndarray:
    """The distinct rows of (shingles, 2), in the order of the first half."""
    rows = shingles[np.argsort(shingles[:, 0])]
    same = rows[1:, 0] == rows[:-1, 0]
    if (same & (rows[1:, 1] != rows[:-1, 1])).any():
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        same = (rows[1:] == rows[:-1]).all(1)
    return rows[np.append(True, ~same)[: len(rows)]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as (n, 2) halves in the order of the first."""
    hashes, at = word_digests(data, offsets)
    n_rolled = max(len(hashes) - words + 1, 0)
    rolled = np.zeros((n_rolled, 2), np.uint64)
    for i in range(words):
        rolled = rolled * _FACTORS + hashes[i : i + n_rolled]
    rolled = mix(rolled + np.uint64(words))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        n = b - a
        if n >= words:
            out.append(_distinct(rolled[a : b - words + 1]))
        else:
            whole = np.zeros((min(n, 1), 2), np.uint64)
            for h in hashes[a:b]:
                whole = whole * _FACTORS + h
            out.append(mix(whole + np.uint64(n)))
    return out


def as_text(shingles: np.ndarray) -> pa.Array:
    """Shingles as strings of 16 ASCII characters, seven bits of each byte, which Spark compares in full."""
    return pa.Array.from_buffers(pa.string(), len(shingles), [None, pa.py_buffer(np.arange(0, 16 * len(shingles) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(shingles).view(np.uint8).ravel() & np.uint8(0x7F))])


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys; rows of empty sets hold zeros."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    keys = np.zeros((len(sets), BANDS), np.uint64)
    full = sizes > 0
    if not full.any():
        return keys
    x = np.concatenate(sets)[:, 0]
    starts = np.append(0, sizes[full].cumsum()[:-1])
    values = np.empty((2 * PERMUTATIONS, int(full.sum())), np.uint64)
    for j in range(PERMUTATIONS):
        v = x * _MULTIPLY[j] + _ADD[j]
        values[j] = np.minimum.reduceat(v, starts)
        values[PERMUTATIONS + j] = np.maximum.reduceat(v, starts)
    for band in range(BANDS):
        h = np.full(values.shape[1], band + 1, np.uint64)
        for row in values[band * ROWS : (band + 1) * ROWS]:
            h = mix(h * _ODD + row)
        keys[full, band] = h
    return keys


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """_k (the key), _t (a hash of the text), n_shingles, set_key (digest of the set; null if empty), bands."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column("_text"))
            for a, b in chunks(column):
                sets = shingle_sets(*flat(column.slice(a, b - a)), words)
                bands = band_keys(sets).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                columns = [batch.column(c).slice(a, b - a) for c in ("_k", "_t")] + [pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["_k", "_t", "n_shingles", "set_key", "bands"])

    named = df.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    return named.mapInArrow(tidy(run), f"_k {kind}, _t long, n_shingles long, set_key binary, bands array<long>")


def _full_sets(texts: DataFrame, words: int) -> DataFrame:
    """set_key, shingles of the texts in the column _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column("_text"))
            for a, b in chunks(column):
                sets = shingle_sets(*flat(column.slice(a, b - a)), words)
                ends = np.append(0, np.fromiter(map(len, sets), np.int64, len(sets)).cumsum()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), as_text(np.concatenate(sets)))], names=["set_key", "shingles"])

    return texts.select("_text").mapInArrow(tidy(run), "set_key binary, shingles array<string>")


def link_classes(classes: DataFrame, sets_of, similarity: float) -> DataFrame:
    """rep, label: the components of the classes (rep, n_shingles, bands) that have links."""
    percent = round(similarity * 100)
    spread = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("rep").alias("lead"), F.min_by("n", "rep").alias("lead_n"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = saved(spread.join(buckets, "band").select("band", "rep", "n", "lead", "lead_n"))
    sets = saved(sets_of(saved(members.select("rep").distinct())))

    def near(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    def confirmed(pairs: DataFrame) -> DataFrame:
        first = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        both = first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")

    star = members.filter((F.col("rep") != F.col("lead")) & near(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = saved(confirmed(star))
    labels = components(links)
    named = members.select("band", "rep", "n").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    pairs = saved(_open_pairs(named, classes, sets, percent, near).join(star, ["a", "b"], "left_anti"))
    more = saved(confirmed(pairs))
    if not more.limit(1).count():
        return labels.select(F.col("id").alias("rep"), "label")
    return components(links.unionByName(more)).select(F.col("id").alias("rep"), "label")


def _open_pairs(named: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, near) -> DataFrame:
    """(a, b): in buckets of several components, members outside the largest against members of other components, each pair once.

    Crowded buckets (over CROWD members) hold families of near copies, most of which may be just too far from each
    other. There a pair is left out if it can't be similar: shingles that at most RARE classes of such buckets have
    are few and are matched exactly (shared); of the others a pair has at most what the poorer one has.
    """
    sizes = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    several = sizes.groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.sum("c").alias("crowd"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    bands = classes.select("rep", "bands")
    open_ = saved(named.join(several.select("band", "top", "crowd"), "band").join(bands, "rep"))

    def sides(rows: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame]:
        own = ["rep", "n", "label", "bands", *more]
        return rows.filter("label <> top").select("band", *[F.col(c).alias(f"{c}_a") for c in own]), rows.select("band", *[F.col(c).alias(f"{c}_b") for c in own])

    # a pair counts in the first band that it shares
    fresh = (F.col("label_a") != F.col("label_b")) & near(F.col("n_a"), F.col("n_b"))
    first = F.get(F.array_intersect("bands_a", "bands_b"), 0)
    ends = [F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")]
    x, y = sides(open_.filter(F.col("crowd") <= CROWD), [])
    calm = x.join(y.withColumnRenamed("band", "band_b"), (F.col("band") == F.col("band_b")) & fresh & (first == F.col("band"))).select(*ends)
    crowded = open_.filter(F.col("crowd") > CROWD)
    reps = crowded.groupBy("rep").agg(F.max(F.col("label") != F.col("top")).alias("outside"), F.first("label").alias("label"), F.first("n").alias("n"))
    shingles = saved(sets.join(reps, F.col("id") == F.col("rep")).select("rep", "outside", "label", "n", F.explode("shingles").alias("shingle")))
    rare = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= RARE)
    rarely = saved(shingles.join(rare, "shingle"))
    common = saved(rarely.groupBy("rep").agg(F.count(F.lit(1)).alias("few")))

    def similar(shared):
        return 100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)

    met = rarely.filter("df > 1")
    left = met.filter("outside").select("shingle", F.col("rep").alias("rep_a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"))
    right = met.select("shingle", F.col("rep").alias("rep_b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"))
    few = lambda side: common.select(F.col("rep").alias(f"rep_{side}"), F.col("few").alias(f"few_{side}"))
    rest = lambda side: F.col(f"n_{side}") - F.coalesce(f"few_{side}", F.lit(0))
    together = left.join(right, "shingle").filter(fresh).groupBy("rep_a", "rep_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    together = together.join(few("a"), "rep_a", "left").join(few("b"), "rep_b", "left").filter(similar(F.col("shared") + F.least(rest("a"), rest("b")))).select(*ends)
    x, y = sides(crowded.join(common, "rep", "left").filter(100 * (F.col("n") - F.coalesce("few", F.lit(0))) >= percent * F.col("n")), ["few"])
    apart = x.join(y.withColumnRenamed("band", "band_b"), (F.col("band") == F.col("band_b")) & fresh & similar(F.least(rest("a"), rest("b"))) & (first == F.col("band"))).select(*ends)
    return calm.unionByName(together).unionByName(apart).distinct()


def _row_order():
    """Rows of a group in order: by id (nulls last), then by a hash of the text."""
    return F.struct(F.col("_k").isNull().alias("none"), F.col("_k").alias("k"), F.col("_t").alias("t"))


def _grouped(df: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """_k, _t, n_shingles and first (the row order of the group's first row) of every row."""
    if words < 1 or not 0 < similarity <= 1:
        raise ValueError("words must be at least 1 and similarity in (0, 1]")
    signed = saved(signatures(df, key, text, words))
    classes = signed.filter("n_shingles > 0").groupBy("set_key").agg(F.min(_row_order()).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    # numbered in the order of their first rows, so that the first text of a family, of which the others mostly are copies,
    # leads its buckets; and saved before it is used, so that the numbers stay
    classes = saved(classes.repartitionByRange("first").sortWithinPartitions("first").withColumn("rep", F.monotonically_increasing_id()))

    def sets_of(reps: DataFrame) -> DataFrame:
        wanted = saved(reps.join(classes.select("rep", "set_key", F.col("first.k").alias("_k"), F.col("first.t").alias("_t")), "rep"))
        rows = saved(wanted.select(F.col("_k").alias("_k2"), F.col("_t").alias("_t2")).distinct())
        texts = df.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
        chosen = texts.join(sized(rows), texts["_k"].eqNullSafe(rows["_k2"]) & (texts["_t"] == rows["_t2"]), "left_semi")
        return _full_sets(chosen, words).join(sized(wanted.select("set_key", F.col("rep").alias("id"))), "set_key").drop("set_key").dropDuplicates(["id"])

    labels = link_classes(classes.select("rep", "n_shingles", "bands"), sets_of, similarity)
    named = saved(classes.select("set_key", "rep", "first").join(labels, "rep", "left").select("set_key", "first", F.coalesce("label", "rep").alias("label")))
    groups = named.groupBy("label").agg(F.min("first").alias("_first"))
    firsts = named.select("set_key", "label").join(groups, "label").select("set_key", "_first")
    own = signed.select("_k", "_t", "n_shingles", "set_key").join(firsts, "set_key", "left")
    return own.select("_k", "_t", "n_shingles", F.coalesce("_first", _row_order()).alias("first"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row: key, n_shingles, component_id (smallest key reachable, itself included), kept (whether the row is its group's first; rows that repeat both its key and its text are, too)."""
    found = _grouped(df, key, text, words, similarity)
    return found.select(F.col("_k").alias(key), "n_shingles", F.col("first.k").alias("component_id"), (_row_order() == F.col("first")).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with one row of each group, and every row without words; columns as they were."""
    found = saved(_grouped(df, key, text, words, similarity).withColumn("kept", _row_order() == F.col("first")))
    lost = saved(found.filter("NOT kept").select(F.col("_k").alias("__k"), F.col("_t").alias("__t")).distinct())
    same = df[key].eqNullSafe(lost["__k"]) & (F.xxhash64(df[text]) == lost["__t"])
    left = df.join(sized(lost), same, "left_anti")
    # rows that repeat both key and text: of those with words one stays
    again = found.filter("kept AND n_shingles > 0").groupBy(F.col("_k").alias("__k"), F.col("_t").alias("__t")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = saved(again)
    if not again.limit(1).count():
        return left
    same = left[key].eqNullSafe(again["__k"]) & (F.xxhash64(left[text]) == again["__t"])
    once = left.join(sized(again), same, "left_semi").groupBy(F.col(key), F.xxhash64(text)).agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in left.columns])).alias("_row"))
    return left.join(sized(again), same, "left_anti").unionByName(once.select(*[F.col("_row").getField(c).alias(c) for c in left.columns]))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=4)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, low.component_id, d.doc_id = low.component_id AS kept FROM documents d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)
"""
