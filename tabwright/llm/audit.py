"""Filter interaction audit by truth-table survival words.

Up to five filters give 32 subsets. Each document becomes one 32-bit word: bit s is set if the document survives the
subset s of filters (bit i of s: filter i is applied). How many documents of a part survive each subset is the
positional popcount of its words, which tasks count with carry-save adders: three words of weight w become one of
weight w (their parity) and one of weight 2w (their majority), so 32 counts at once take a few word operations a
document. A task gives one row per part and label, never one per document; sums of those rows are the subset
survivors, from which every order's kept, removed, redundant, unique and lost documents and the Shapley shares follow
by differences alone.

Null texts count as empty; empty texts have no words. A text is a copy if a row with a smaller id has an equal text
(null and empty are equal); rows that share the smallest id are none of them copies, a row with a null id is never one.
A null part is the part "". A document has a label if any row of ``labels`` with its id says so; null ids have none.
Repeated rows count as often as they come. Texts may be of any length; other columns, whatever their names, don't
matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import SPACES, read, saved, sized, text_or_empty, tidy

#: Filters of which a 32-bit word holds all subsets.
MOST_FILTERS = 5
#: Parts and labels whose counters a task holds; beyond them it gives out what it has and begins anew.
MOST_GROUPS = 20_000


def survival_word(fails: int, filters: int) -> int:
    """The word of a document that fails the filters whose bits are set."""
    return sum(1 << s for s in range(1 << filters) if not s & fails)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    counts = np.zeros(32, np.int64)
    weight, planes = 1, words.astype(np.uint32)
    while len(planes):
        carries = []
        while len(planes) > 2:
            n = len(planes) // 3
            a, b, c = planes[:n], planes[n : 2 * n], planes[2 * n : 3 * n]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            planes = np.concatenate([odd ^ c, planes[3 * n :]])
        if len(planes) == 2:
            carries.append(planes[:1] & planes[1:])
            planes = planes[:1] ^ planes[1:]
        counts += weight * ((planes[0] >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64)
        weight, planes = 2 * weight, np.concatenate(carries) if carries else planes[:0]
    return counts


def subset_survivors(df: DataFrame, part: Column, fails: list[Column], labels: dict[str, Column] | None = None) -> DataFrame:
    """part, subset (bits of the filters that are applied), survivors, and by label the survivors that have it.

    ``fails``: a condition per filter (null: not failing), five at most; ``labels``: conditions (null: not so).
    """
    if not 1 <= len(fails) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters are needed")
    labels = labels or {}
    if len(labels) > 8:
        raise ValueError("eight labels at most")
    subsets = 1 << len(fails)
    words = np.array([survival_word(f, len(fails)) for f in range(subsets)], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            flat = [x for counts in held.values() for x in counts[:subsets].tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, subsets, dtype=np.int32)), pa.array(flat, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), lists], names=["_part", "_said", "_counts"])

        for batch in batches:
            parts = batch.column("_part").dictionary_encode()
            codes, said = parts.indices.to_numpy(), batch.column("_said").to_numpy()
            group = codes.astype(np.int64) * 256 + said
            order = np.argsort(group, kind="stable")
            own = words[batch.column("_fails").to_numpy()[order]]
            starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else []
            names = parts.dictionary.to_pylist()
            for a, b in zip(starts, np.append(starts[1:], len(order))):
                at = order[a]
                key = (names[codes[at]], int(said[at]))
                held[key] = held.get(key, 0) + positional_popcount(own[a:b])
            if len(held) > MOST_GROUPS:
                yield out()
                held = {}
        if held:
            yield out()

    bits = lambda conditions: sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0)).cast("int")
    rows = df.select(F.coalesce(part.cast("string"), F.lit("")).alias("_part"), bits(labels.values()).alias("_said"), bits(fails).alias("_fails"))
    counted = rows.mapInArrow(tidy(run), "_part string, _said int, _counts array<long>").select("_part", "_said", F.posexplode("_counts").alias("subset", "_n"))
    having = [F.coalesce(F.sum(F.when(F.col("_said").bitwiseAND(1 << i) != 0, F.col("_n"))), F.lit(0)).alias(name) for i, name in enumerate(labels)]
    return counted.groupBy(F.col("_part").alias("part"), "subset").agg(F.sum("_n").alias("survivors"), *having)


def order_report(survivors: DataFrame, letters: str, lost: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters (named by ``letters``, in the order of the subsets' bits) and step: kept, removed, redundant, unique_fails, the labelled ones that are lost (``lost``: output name by label), shapley."""
    n = len(letters)
    everything = (1 << n) - 1
    columns = ["survivors", *lost]
    parts = survivors.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *columns))).alias("_by"))
    parts = parts.select("part", *[F.col("_by").getField(c).alias(f"_{c}") for c in columns])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    mask = lambda text: sum((F.when(F.contains(text, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    chosen = lambda length: F.substring(F.col("filter_order"), F.lit(1), length)
    steps = steps.withColumn("_before", mask(chosen(F.col("step") - 1))).withColumn("_after", mask(chosen(F.col("step"))))
    steps = steps.withColumn("_own", F.col("_after") - F.col("_before"))
    of = lambda subset, column="survivors": F.get(F.col(f"_{column}"), subset)
    removed = of(F.col("_before")) - of(F.col("_after"))
    # over all orders, a filter comes right after each subset of k others k! (n - k - 1)! times
    times = F.array(*[F.lit(factorial(k) * factorial(n - k - 1)) for k in range(n)])
    share = lambda s: F.when(s.bitwiseAND(F.col("_own")) == 0, F.get(times, F.bit_count(s)) * (of(s) - of(s + F.col("_own")))).otherwise(0)
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(everything)), F.lit(0).cast("long"), lambda sum_, s: sum_ + share(s))
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        of(F.col("_after")).alias("kept"),
        removed.alias("removed"),
        (of(F.lit(0)) - of(F.col("_own")) - removed).alias("redundant"),
        (of(F.lit(everything) - F.col("_own")) - of(F.lit(everything))).alias("unique_fails"),
        *[(of(F.col("_before"), c) - of(F.col("_after"), c)).alias(name) for c, name in lost.items()],
        shapley.alias("shapley"),
    )


def with_copy_flag(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``df`` with a column that says whether a row with a smaller key has an equal text. Texts meet as 256-bit digests; only those that come more than once go back to the rows."""
    digest = F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)
    marked = df.withColumn("_digest", digest)
    firsts = saved(marked.groupBy("_digest").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c"))
    return marked.join(sized(firsts), "_digest", "left").withColumn(name, F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_digest", "_first")


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Filters: few words, repeated words, many capitals, symbols, copies of earlier texts; by lang and label."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", text_or_empty().alias("text"))
    words = docs.select("doc_id", "lang", "text", _words(F.col("text")).alias("_w"))
    capitals = F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marks = {
        "a": F.size("_w") < 100,
        "b": 100 * F.size(F.array_distinct("_w")) < 80 * F.size("_w"),
        "c": 100 * capitals.cast("long") > 10 * F.char_length("text"),
        "d": F.rlike("text", F.lit("[#$%&*|]")),
    }
    measured = words.select("doc_id", "lang", F.sha2(F.encode("text", "UTF-8"), 256).alias("text"), *[c.alias(n) for n, c in marks.items()])
    # the texts are read once; what goes on is their digests and marks
    flagged = with_copy_flag(saved(measured), "doc_id", "text", "e")
    named = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("_id IS NOT NULL AND (good OR toxic)")
    rows = flagged.join(sized(saved(named)), F.col("doc_id") == F.col("_id"), "left")
    survivors = subset_survivors(rows, F.col("lang"), [F.col(c) for c in "abcde"], {"good": F.col("good"), "toxic": F.col("toxic")})
    return order_report(survivors, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 100,
    100 * len(list_distinct(w)) < 80 * len(w),
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(t.doc_id > (SELECT min(u.doc_id) FROM t u WHERE u.text = t.text), false)] AS fails
  FROM t LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS letter, ascii(filter_order[step]) - 64 AS i FROM o, (SELECT unnest(range(1, 6)) AS step)
), m AS (
  SELECT part, good, toxic, fails, n, filter_order, step, letter, fails[i] AS own, len(list_filter(fails, lambda b: b)) = 1 AS alone,
    list_bool_or(list_transform(range(1, step), lambda k: fails[ascii(filter_order[k]) - 64])) AS earlier
  FROM g, s
), r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT own AND NOT coalesce(earlier, false) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN own AND NOT coalesce(earlier, false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND coalesce(earlier, false) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN own AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND NOT coalesce(earlier, false) AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN own AND NOT coalesce(earlier, false) AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
