"""Queries over the driver's tables, one or more per operator, each with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions import text as fn
from tabwright.functions.cells import class_of, date, num, rendered, strip
from tabwright.operators import append, cluster, compare, dedup, diagnose, filters, find, grouping, joins, outlier, pii, profile, project, repair, reshape, rules, semantic, sketches, sort, transform
from tabwright.operators.filters import Condition, Group
from tabwright.operators.grouping import Aggregate, GroupBy
from tabwright.operators.order import persisted, shared_folder, with_position, with_running_sum
from tabwright.plans import recipe, views
from tabwright.sources import delimited, export
from tabwright.streaming import follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


# --- C: projection, filters, find -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND (o_orderstatus = 'F' OR lower(o_orderpriority) LIKE '%urgent%') AND o_orderpriority <> '5-LOW'")
def filter_nested(spark, d):
    spec = Group((Condition("o_totalprice", "gt", "150000"), Group((Condition("o_orderstatus", "equals", "F", True), Condition("o_orderpriority", "contains", "URGENT")), "or"), Condition("o_orderpriority", "notEquals", "5-low")))
    return filters.filter_rows(read(spark, d, "orders"), spec).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-E]') AND p_size >= 10 AND p_size <= 30 AND NOT lower(p_name) LIKE '%red%' AND p_brand LIKE 'Brand#%' AND trim(p_name) <> '' AND p_name NOT LIKE '%zzz'")
def filter_text_operators(spark, d):
    spec = Group((Condition("p_type", "regex", "^[A-E]", True), Condition("p_size", "gte", "10"), Condition("p_size", "lte", "30"), Condition("p_name", "notContains", "RED"), Condition("p_brand", "startsWith", "brand#"), Condition("p_name", "notEmpty"), Group(), Condition("p_brand", "notEquals", "zzz")))
    return filters.filter_rows(read(spark, d, "part"), spec).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value >= 10.0 AND value <= 60.0")
def filter_from_explorer(spark, d):
    spec = filters.with_range(filters.with_value(Group(), "event_type", "click"), "value", 10.0, 60.0)
    return filters.filter_rows(read(spark, d, "events"), spec).select("event_id")


@query("SELECT c_custkey, 'c_name' AS \"column\", c_name AS value FROM customer WHERE c_name LIKE '%00001%' UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%00001%'")
def find_cells(spark, d):
    return find.find(read(spark, d, "customer"), find.Find("00001", columns=("c_name", "c_mktsegment")), "c_custkey")


@query("SELECT p_partkey, regexp_replace(p_brand, 'Brand#(\\d)(\\d)', '\\2/\\1', 'g') AS p_brand, CAST(CASE WHEN regexp_matches(p_brand, 'Brand#(\\d)(\\d)') THEN 1 ELSE 0 END AS INTEGER) AS _changed FROM part")
def replace_cells(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    return find.replace_all(part, find.Find(r"Brand#(\d)(\d)", regex=True, case_sensitive=True), "$2/$1")


@query("SELECT c_name, c_mktsegment, c_custkey FROM customer")
def lay_out_columns(spark, d):
    layout = project.Layout(hidden=("c_acctbal", "c_nationkey"), pinned=("c_name",), order=("c_mktsegment", "gone"))
    return project.lay_out(read(spark, d, "customer"), layout).df


@query("SELECT s_suppkey AS supplier, '' AS note, s_name FROM supplier")
def edit_columns(spark, d):
    kept = project.keep_columns(read(spark, d, "supplier"), ["s_name", "s_suppkey", "s_acctbal"])
    named = project.rename_column(project.delete_columns(kept, ["s_acctbal"]), "s_suppkey", "supplier")
    return project.move_column(project.insert_column(named, 0, "note"), "supplier", 0)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def patch_cells(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    patches = orders.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("o_orderstatus").alias("column"), F.lit("X").alias("value"))
    return project.patch_cells(orders, patches, "o_orderkey")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def delete_rows(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "event_type")
    return project.delete_rows(events, events.filter("event_type = 'purchase'").select("user_id"), "user_id").drop("event_type")


# --- H: sort and limit ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_topk(spark, d):
    return sort.top_rows(read(spark, d, "orders"), [sort.SortKey("o_totalprice", True)], 100, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 200")
def window_of_rows(spark, d):
    return project.window_of_rows(read(spark, d, "events"), ["ts", "event_id"], 200, 50).select("event_id", "ts")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def dense_position(spark, d):
    return with_position(read(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], "pos").select("event_id", "pos")


@query("SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM orders")
def running_sum(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return with_running_sum(orders, F.col("o_custkey"), ["o_orderdate", "o_orderkey"], "run").select("o_orderkey", "run")


# --- E: aggregation -------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(avg(l_quantity), 4) AS quantity, min(l_discount) AS low, max(l_tax) AS high FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2")
def groupby_stats(spark, d):
    shipped = filters.filter_rows(read(spark, d, "lineitem"), Condition("l_quantity", "gt", "5"))
    spec = GroupBy(("l_returnflag", "l_linestatus"), (Aggregate("count", name="n"), Aggregate("sum", "l_extendedprice", "price"), Aggregate("mean", "l_quantity", "quantity"), Aggregate("min", "l_discount", "low"), Aggregate("max", "l_tax", "high")))
    return rounded(rounded(grouping.group_by(shipped, spec), "price", digits=2), "quantity")


@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS middle, count(DISTINCT l_suppkey) AS suppliers, count(l_shipdate) AS shipped FROM lineitem GROUP BY 1")
def groupby_median(spark, d):
    spec = GroupBy(("l_returnflag",), (Aggregate("median", "l_extendedprice", "middle"), Aggregate("countDistinct", "l_suppkey", "suppliers"), Aggregate("countNonblank", "l_shipdate", "shipped")))
    return rounded(grouping.group_by(read(spark, d, "lineitem"), spec), "middle")


@query("""SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type,
  (SELECT CASE WHEN strlen(s) <= 60 THEN s ELSE s[1:60] || '…' END FROM (SELECT string_agg(e2.event_type, ', ' ORDER BY e2.event_id) AS s FROM events e2 WHERE e2.user_id = events.user_id)) AS path,
  (SELECT string_agg(t, '|' ORDER BY m) FROM (SELECT event_type AS t, min(event_id) AS m FROM events e3 WHERE e3.user_id = events.user_id GROUP BY 1)) AS kinds
FROM events GROUP BY user_id""")
def groupby_first_last_concat(spark, d):
    spec = GroupBy(("user_id",), (Aggregate("first", "event_type", "first_type"), Aggregate("last", "event_type", "last_type"), Aggregate("concat", "event_type", "path", max_bytes=60), Aggregate("concatDistinct", "event_type", "kinds", separator="|")), order_by=("event_id",))
    return grouping.group_by(read(spark, d, "events"), spec)


@query("SELECT t, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS t, value AS v FROM events) WHERE t IS NOT NULL GROUP BY t")
def groupby_blank_policy(spark, d):
    events = read(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("t"), F.col("value").alias("v"))
    return rounded(grouping.group_by(events, GroupBy(("t",), (Aggregate("count", name="n"), Aggregate("sum", "v", "total")), blank_keys="exclude", order="countDesc")), "total")


@query("SELECT arg_min(seg, c_custkey) AS seg, count(*) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' ' || upper(c_mktsegment) ELSE lower(c_mktsegment) END AS seg FROM customer) GROUP BY lower(trim(seg))")
def groupby_normalized(spark, d):
    odd = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.upper("c_mktsegment"))).otherwise(F.lower("c_mktsegment"))
    customers = read(spark, d, "customer").select("c_custkey", odd.alias("seg"))
    return grouping.group_by(customers, GroupBy(("seg",), (Aggregate("count", name="n"),), normalise=True, order="firstSeen", order_by=("c_custkey",)))


@query("""SELECT count(DISTINCT t) AS group_count, count(t) AS scanned_rows, count(*) FILTER (t IS NULL) AS blank_key_rows, count(*) FILTER (t IS NOT NULL AND v = 'none') AS invalid_numeric
FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN event_type END AS t, CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN CAST(value AS VARCHAR) END AS v FROM events)""")
def groupby_report(spark, d):
    k = F.col("event_id")
    events = read(spark, d, "events").select(F.when(k % 7 != 0, F.col("event_type")).alias("t"), F.when(k % 3 == 0, "none").when(k % 3 == 1, F.col("value").cast("string")).alias("v"))
    return grouping.group_report(events, GroupBy(("t",), (Aggregate("sum", "v"), Aggregate("count")), blank_keys="exclude"))


@query("SELECT count(*) * 2 AS cells, count(*) * 2 AS nonblank, count(*) * 2 AS numbers, round(sum(l_quantity) + sum(l_discount), 2) AS total, round((sum(l_quantity) + sum(l_discount)) / (2 * count(*)), 4) AS mean, least(min(l_quantity), min(l_discount)) AS low, greatest(max(l_quantity), max(l_discount)) AS high FROM lineitem")
def selection_statistics(spark, d):
    return rounded(rounded(grouping.selection_stats(read(spark, d, "lineitem"), ["l_quantity", "l_discount"]), "total", digits=2), "mean")


# --- D: joins -------------------------------------------------------------------------------------------------------

_ODD_KEYS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_custkey % 2 = 1 THEN '-' || CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 0 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' ' ELSE CAST(o_custkey AS VARCHAR) || '.0' END AS k FROM orders)"
_ON = "CASE WHEN trim(o.k) = '' THEN NULL ELSE CAST(trim(o.k) AS DOUBLE) END = CAST(c.c_custkey AS DOUBLE)"
_RIGHT = "(SELECT c_custkey, c_name FROM customer)"


def _odd_orders(spark, d):
    """Orders with keys written in several ways; the odd ones match no customer."""
    key = F.when(F.col("o_orderkey") % 11 == 0, "").when(F.col("o_custkey") % 2 == 1, F.concat(F.lit("-"), F.col("o_custkey"))).when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.col("o_custkey"), F.lit(" "))).otherwise(F.concat("o_custkey", F.lit(".0")))
    return read(spark, d, "orders").select("o_orderkey", key.alias("k"))


def _join(spark, d, kind):
    customers = read(spark, d, "customer").select("c_custkey", "c_name")
    return joins.join_tables(_odd_orders(spark, d), customers, joins.JoinSpec((("k", "c_custkey"),), kind, numeric_equal=True))


@query(f"SELECT o.o_orderkey, o.k, c.c_custkey, c.c_name FROM {_ODD_KEYS} o JOIN {_RIGHT} c ON {_ON}")
def join_inner(spark, d):
    return _join(spark, d, "inner")


@query(f"SELECT o.o_orderkey, o.k, c.c_custkey, c.c_name FROM {_ODD_KEYS} o LEFT JOIN {_RIGHT} c ON {_ON}")
def join_left(spark, d):
    return _join(spark, d, "left")


@query(f"SELECT o.o_orderkey, o.k, c.c_custkey, c.c_name FROM {_ODD_KEYS} o RIGHT JOIN {_RIGHT} c ON {_ON}")
def join_right(spark, d):
    return _join(spark, d, "right")


@query(f"SELECT o.o_orderkey, o.k, c.c_custkey, c.c_name FROM {_ODD_KEYS} o FULL JOIN {_RIGHT} c ON {_ON}")
def join_full(spark, d):
    return _join(spark, d, "full")


@query(f"SELECT o.o_orderkey, o.k, CAST(NULL AS BIGINT) AS c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM {_ODD_KEYS} o LEFT JOIN {_RIGHT} c ON {_ON} WHERE c.c_custkey IS NULL")
def join_left_anti(spark, d):
    return _join(spark, d, "leftAnti")


@query(f"SELECT CAST(NULL AS BIGINT) AS o_orderkey, CAST(NULL AS VARCHAR) AS k, c.c_custkey, c.c_name FROM {_ODD_KEYS} o RIGHT JOIN {_RIGHT} c ON {_ON} WHERE o.o_orderkey IS NULL")
def join_right_anti(spark, d):
    return _join(spark, d, "rightAnti")


@query(f"""SELECT count(*) FILTER (o_orderkey IS NOT NULL AND c_custkey IS NOT NULL) AS matched_pairs, count(*) FILTER (c_custkey IS NULL) AS left_unmatched, count(*) FILTER (o_orderkey IS NULL) AS right_unmatched,
  (SELECT count(*) FROM (SELECT CAST(trim(k) AS DOUBLE) AS x FROM {_ODD_KEYS} WHERE trim(k) <> '' GROUP BY 1 HAVING count(*) > 1)) AS left_duplicate_keys, CAST(0 AS BIGINT) AS right_duplicate_keys,
  count(*) AS output_rows, count(*) FILTER (o_orderkey IS NOT NULL AND c_custkey IS NOT NULL) > greatest((SELECT count(*) FROM orders), (SELECT count(*) FROM {_RIGHT})) AS expands
FROM (SELECT o.o_orderkey, c.c_custkey FROM {_ODD_KEYS} o FULL JOIN {_RIGHT} c ON {_ON})""")
def join_preview(spark, d):
    customers = read(spark, d, "customer").select("c_custkey", "c_name")
    return joins.join_preview(_odd_orders(spark, d), customers, joins.JoinSpec((("k", "c_custkey"),), "full", numeric_equal=True))


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_lookup(spark, d):
    suppliers = joins.join_tables(read(spark, d, "supplier"), read(spark, d, "nation"), joins.JoinSpec((("s_nationkey", "n_nationkey"),), "left", lookup=True, right_columns=("n_name", "n_regionkey")))
    return joins.join_tables(suppliers, read(spark, d, "region"), joins.JoinSpec((("n_regionkey", "r_regionkey"),), "left", lookup=True, right_columns=("r_name",))).select("s_suppkey", "s_name", "n_name", "r_name")


# --- I: append ------------------------------------------------------------------------------------------------------


def _parties(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, d, "supplier").select(F.col("s_name").alias("name "), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return {"customers": c, "suppliers": s}


@query("SELECT c_custkey AS key, c_name AS \"Name\", c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance, 'customers' AS source_file, row_number() OVER (ORDER BY c_custkey) AS source_row FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, 'suppliers', row_number() OVER (ORDER BY s_suppkey) FROM supplier")
def append_union(spark, d):
    return append.append_tables(_parties(spark, d), append.Append("nameInsensitive", sources=True, order_by=("key",)))


@query("SELECT c_custkey AS key FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def append_intersection(spark, d):
    return append.append_tables(_parties(spark, d), append.Append("name", "intersection"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS \"Name\", c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS \"Column 4\" FROM customer UNION ALL SELECT s_name, CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR), s_name FROM supplier")
def append_position(spark, d):
    s = read(spark, d, "supplier").select("s_name", "s_suppkey", F.col("s_nationkey").cast("string"), F.col("s_name").alias("again"))
    return append.append_tables({"customers": _parties(spark, d)["customers"], "suppliers": s}, append.Append("position"))


@query("SELECT c_name AS who, c_mktsegment AS kind FROM customer UNION ALL SELECT s_name, NULL FROM supplier")
def append_manual(spark, d):
    mapping = {"who": {"customers": "Name", "suppliers": "name "}, "kind": {"customers": "segment"}}
    return append.append_tables(_parties(spark, d), append.Append("manual", mapping=mapping))


# --- J: dedup -------------------------------------------------------------------------------------------------------


@query("WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT CAST(sum(n) AS BIGINT) AS considered, count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS excess, count(*) AS remaining FROM g")
def dedup_report(spark, d):
    return dedup.duplicate_report(read(spark, d, "documents"), dedup.Dedup(("text",)), ["doc_id"])


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_first(spark, d):
    return dedup.deduplicate(read(spark, d, "documents").select("doc_id", "text"), dedup.Dedup(("text",)), ["doc_id"])


@query("SELECT max(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def dedup_last(spark, d):
    return dedup.deduplicate(read(spark, d, "events").select("event_id", "user_id"), dedup.Dedup(("user_id",)), ["event_id"], "last")


_HOLES = "(SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS b FROM events)"


@query(f"SELECT event_id, user_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (CASE WHEN a IS NULL THEN 0 ELSE 1 END) + (CASE WHEN b IS NULL THEN 0 ELSE 1 END) DESC, event_id) AS k FROM {_HOLES}) WHERE k = 1")
def dedup_most_complete(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("b"))
    return dedup.deduplicate(events, dedup.Dedup(("user_id",)), ["event_id"], "mostComplete")


@query("SELECT doc_id FROM documents WHERE lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) IN (SELECT lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def duplicate_rows(spark, d):
    return dedup.duplicate_rows(read(spark, d, "documents"), dedup.Dedup(("text",), collapse_whitespace=True, case_insensitive=True), ["doc_id"]).select("doc_id")


# --- K: reshape -----------------------------------------------------------------------------------------------------


_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY p_partkey) AS source_row FROM part)"


@query(f"SELECT p_partkey, source_row, 'p_name' AS attribute, p_name AS value FROM {_NUMBERED} UNION ALL SELECT p_partkey, source_row, 'p_brand', p_brand FROM {_NUMBERED} UNION ALL SELECT p_partkey, source_row, 'p_type', p_type FROM {_NUMBERED}")
def unpivot(spark, d):
    return reshape.unpivot(read(spark, d, "part"), ["p_partkey"], ["p_name", "p_brand", "p_type"], source_row=["p_partkey"])


_PIVOT = "SELECT user_id, {0} FROM events GROUP BY user_id"


@query(_PIVOT.format(", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view"))))
def pivot_sum(spark, d):
    out = reshape.pivot(read(spark, d, "events"), reshape.Pivot(("user_id",), "event_type", "value", "sum"))
    return rounded(out, *[c for c in out.columns if c != "user_id"])


@query(_PIVOT.format(", ".join(f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view"))))
def pivot_count(spark, d):
    return reshape.pivot(read(spark, d, "events"), reshape.Pivot(("user_id",), "event_type", "value", "count"))


@query("SELECT count(DISTINCT user_id) AS rows, count(DISTINCT event_type) + 1 AS columns, (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) > 1)) AS duplicate_coordinates FROM events")
def pivot_preview(spark, d):
    return reshape.pivot_preview(read(spark, d, "events"), reshape.Pivot(("user_id",), "event_type", "value"))


@query("SELECT 'r_regionkey' AS \"Column\", " + ", ".join(f"(SELECT CAST(r_regionkey AS VARCHAR) FROM region ORDER BY r_regionkey LIMIT 1 OFFSET {i}) AS \"Row {i + 1}\"" for i in range(5)) + " UNION ALL SELECT 'r_name', " + ", ".join(f"(SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1 OFFSET {i})" for i in range(5)))
def transpose_small(spark, d):
    return reshape.transpose(read(spark, d, "region"), ["r_regionkey"])


# --- L: cells and scalar functions ----------------------------------------------------------------------------------


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS p_name, lower(p_brand) AS p_brand, '<' || p_type AS p_type FROM part")
def transform_text(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    named = transform.transform(part, transform.Transform("titleCase"), ["p_name"])
    lower = transform.transform(named, transform.Transform("lowercase"), ["p_brand"])
    return transform.transform(lower, transform.Transform("addPrefix", {"value": "<"}), ["p_type"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def transform_types(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, " Yes").otherwise("n").alias("even"), F.format_number("o_custkey", 0).alias("customer"))
    out = transform.transform(orders, transform.Transform("normalizeDates", {"format": "%d.%m.%Y"}), ["day"])
    out = transform.transform(out, transform.Transform("normalizeBooleans"), ["even"])
    return transform.transform(out, transform.Transform("normalizeNumbers"), ["customer"])


@query("SELECT 'p_name' AS \"column\", count(*) FILTER (replace(p_name, 'e', '3') <> p_name) AS affected, CAST(0 AS BIGINT) AS failed FROM part")
def transform_report(spark, d):
    return transform.transform_report(read(spark, d, "part"), transform.Transform("replaceText", {"find": "e", "replace": "3"}), ["p_name"])


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS \"p_name 1\", coalesce(string_split(p_name, ' ')[2], '') AS \"p_name 2\", p_brand || '/' || p_type AS \"p_brand+p_type\" FROM part")
def split_and_merge(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return transform.merge_columns(transform.split_column(part, "p_name", " ", parts=2), ["p_brand", "p_type"], "/")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def url_host(spark, d):
    return read(spark, d, "pages").select("page_id", fn.url_host(F.col("url")).alias("host"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '.')) || '.example.com' AS domain FROM customer")
def email_domain(spark, d):
    mail = F.concat(F.lit(" someone@"), F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit(".example.com "))
    return read(spark, d, "customer").select("c_custkey", fn.email_domain(mail).alias("domain"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'blank' WHEN 1 THEN 'number' WHEN 2 THEN 'bool' WHEN 3 THEN 'date' WHEN 4 THEN 'text' ELSE 'number' END AS class, CASE o_orderkey % 6 WHEN 1 THEN round(o_totalprice, 2) WHEN 5 THEN -1500.0 END AS x, CASE WHEN o_orderkey % 6 = 3 THEN date_trunc('day', o_orderdate) END AS day FROM orders")
def cell_classes(spark, d):
    k = F.col("o_orderkey") % 6
    cell = F.when(k == 0, "  ").when(k == 1, F.format_string("%.2f", "o_totalprice")).when(k == 2, " Yes").when(k == 3, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 4, "1d").otherwise("-1.5e3")
    cells = read(spark, d, "orders").select("o_orderkey", cell.alias("cell"))
    return cells.select("o_orderkey", class_of(F.col("cell")).alias("class"), num(F.col("cell")).alias("x"), date(F.col("cell")).alias("day"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') AS fingerprint, array_to_string(list_sort(list_distinct(list_transform(range(1, length(replace(lower(p_name), ' ', ''))), lambda i: replace(lower(p_name), ' ', '')[i:i+1]))), '') AS bigrams FROM part")
def similarity_keys(spark, d):
    return read(spark, d, "part").select("p_partkey", fn.fingerprint(F.col("p_name")).alias("fingerprint"), fn.ngram_fingerprint(F.col("p_name"), 2).alias("bigrams"))


@query("SELECT c_custkey, repeat('•', length(c_name) - 4) || right(c_name, 4) AS masked FROM customer")
def mask_values(spark, d):
    return read(spark, d, "customer").select("c_custkey", fn.mask(F.col("c_name"), "custom").alias("masked"))


# --- F, M: profiles and data quality --------------------------------------------------------------------------------


@query("""SELECT 'value' AS "column", count(*) AS rows, count(*) FILTER (event_id % 7 = 0) AS blanks, count(DISTINCT v) AS "distinct", round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(v), 4) AS mean,
  round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3 FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)""")
def profile_column(spark, d):
    events = read(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return rounded(profile.profile_columns(events).select("column", "rows", "blanks", "distinct", "low", "high", "mean", "q1", "median", "q3"), "low", "high", "mean", "q1", "median", "q3")


@query("SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def top_values(spark, d):
    return profile.top_values(read(spark, d, "part"), "p_name", 10)


@query("""SELECT 'p_brand' AS "column", 'text' AS kind, CAST(0 AS BIGINT) AS blanks, count(DISTINCT p_brand) AS "distinct", CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM part
UNION ALL SELECT 'p_size', 'number', 0, count(DISTINCT p_size), min(p_size), max(p_size) FROM part""")
def column_summary(spark, d):
    return profile.column_summaries(read(spark, d, "part").select("p_brand", "p_size")).drop("mean")


@query("""SELECT 'url' AS "column", 'url' AS detected, count(*) FILTER (regexp_matches(url, '^(https?|ftp)://[^\\s/$.?#].[^\\s]*$')) AS matching, count(*) AS nonblank FROM pages
UNION ALL SELECT 'site', 'categorical', count(*), count(*) FROM pages""")
def semantic_scan(spark, d):
    pages = read(spark, d, "pages").select("url", F.when(F.col("page_id") % 2 == 0, "left").otherwise("right").alias("site"))
    return semantic.semantic_scan(pages).select("column", "detected", "matching", "nonblank")


@query("SELECT event_id FROM events WHERE json_valid(props)")
def semantic_filter(spark, d):
    return semantic.semantic_filter(read(spark, d, "events"), "props", "json").select("event_id")


@query("""SELECT 'mixedTypes' AS issue, 'x' AS "column", count(*) FILTER (o_orderkey % 9 = 0 AND o_orderkey % 4 <> 0) AS count, 'number' AS detail FROM orders
UNION ALL SELECT 'whitespace', 'y', count(*) FILTER (o_orderkey % 3 = 0), '' FROM orders UNION ALL SELECT 'emptyColumn', 'z', count(*), '' FROM orders UNION ALL SELECT 'blankHeavy', 'w', count(*) FILTER (o_orderkey % 4 <> 0), '' FROM orders""")
def diagnostics(spark, d):
    k = F.col("o_orderkey")
    odd = read(spark, d, "orders").select(
        F.when(k % 4 == 0, "").when(k % 9 == 0, "n/a").otherwise(k.cast("string")).alias("x"), F.when(k % 3 == 0, " a").otherwise("a").alias("y"), F.lit("").alias("z"), F.when(k % 4 == 0, "t").otherwise("").alias("w")
    )
    return diagnose.diagnose(odd)


@query("""SELECT 'missingColumn' AS issue, 'gone' AS "column", CAST(1 AS BIGINT) AS count UNION ALL SELECT 'outOfRange', 'o_totalprice', count(*) FILTER (o_totalprice > 200000) FROM orders
UNION ALL SELECT 'regexMismatch', 'o_orderpriority', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-.*$')) FROM orders UNION ALL SELECT 'nonUnique', 'o_custkey', count(*) - count(DISTINCT o_custkey) FROM orders""")
def profile_validate(spark, d):
    rule = diagnose.ColumnRule
    checks = (rule("o_orderkey", required=True, unique=True, kind="number"), rule("o_totalprice", high=200000), rule("o_orderpriority", pattern="^[1-3]-.*$"), rule("o_custkey", unique=True), rule("gone"))
    return diagnose.validate_profile(read(spark, d, "orders"), diagnose.FileProfile(checks))


@query("""SELECT 'price' AS rule, count(*) FILTER (NOT l_discount < l_tax) AS violations FROM lineitem UNION ALL SELECT 'flags', count(*) FILTER (NOT ((l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O'))) FROM lineitem
UNION ALL SELECT 'sum', count(*) FILTER (abs(l_discount + l_tax - l_quantity) > 20) FROM lineitem UNION ALL SELECT 'same', count(*) FILTER (l_returnflag <> l_linestatus) FROM lineitem UNION ALL SELECT 'one', CAST(0 AS BIGINT) FROM lineitem LIMIT 5""")
def crossval_report(spark, d):
    rule = rules.Rule
    return rules.check_rules(
        read(spark, d, "lineitem"),
        [
            rule("price", "numericCompare", ("l_discount", "l_tax"), (("op", "<"),)),
            rule("flags", "allowedCombinations", ("l_returnflag", "l_linestatus"), (("allowed", (("A", "F"), ("N", "O"))),)),
            rule("sum", "sumEquals", ("l_discount", "l_tax", "l_quantity"), (("tolerance", 20),)),
            rule("same", "columnsEqual", ("l_returnflag", "l_linestatus")),
            rule("one", "atLeastOne", ("l_shipdate", "l_suppkey")),
        ],
    )


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 190000 AND o_orderstatus <> 'P' OR o_orderdate >= TIMESTAMP '1998-01-01'")
def rule_violations(spark, d):
    orders = read(spark, d, "orders").withColumns({"limit": F.when(F.col("o_orderstatus") == "P", 1e9).otherwise(190000.0), "end": F.lit("1998-01-01")})
    found = rules.violating_rows(orders, [rules.Rule("price", "numericCompare", ("o_totalprice", "limit"), (("op", "<="),)), rules.Rule("date", "dateOrder", ("o_orderdate", "end"))])
    return found.select("o_orderkey")


def _outliers(spark, d, kind, **options):
    lines = read(spark, d, "events").select("event_id", "event_type", "value")
    return outlier.flag_outliers(lines, outlier.Outlier("value", kind, ("event_type",), **options)).filter("outlier").select("event_id")


@query("SELECT event_id FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def outlier_iqr(spark, d):
    return _outliers(spark, d, "iqr")


@query("WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), a AS (SELECT event_type, median(abs(value - m)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1) SELECT event_id FROM events JOIN m USING (event_type) JOIN a USING (event_type) WHERE abs(0.6745 * (value - m) / mad) > 3.5")
def outlier_mad(spark, d):
    return _outliers(spark, d, "mad")


@query("SELECT event_id FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type) WHERE s > 0 AND abs((value - m) / s) > 2.5")
def outlier_zscore(spark, d):
    return _outliers(spark, d, "zscore", threshold=2.5)


@query("SELECT event_id FROM events JOIN (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY 1) USING (event_type) WHERE value < a OR value > b")
def outlier_percentile(spark, d):
    return _outliers(spark, d, "percentile")


@query("SELECT p_partkey FROM part JOIN (SELECT p_name, count(*) AS c FROM part GROUP BY 1) USING (p_name) WHERE c < 0.016 * (SELECT count(*) FROM part)")
def outlier_rare(spark, d):
    return outlier.flag_outliers(read(spark, d, "part").select("p_partkey", "p_name"), outlier.Outlier("p_name", "rareCategory", share=0.016)).filter("outlier").select("p_partkey")


@query("""SELECT event_type AS g, count(*) AS considered, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS flagged, round(any_value(m), 4) AS median FROM events
JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, median(value) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY 1""")
def outlier_report(spark, d):
    found = outlier.outlier_report(read(spark, d, "events"), outlier.Outlier("value", "iqr", ("event_type",)))
    return found.select(F.get("group", F.lit(0)).alias("g"), "considered", "flagged", F.round("median", 4).alias("median"))


@query("SELECT event_id, round(CASE WHEN value < q1 - 0.5 * (q3 - q1) THEN q1 - 0.5 * (q3 - q1) WHEN value > q3 + 0.5 * (q3 - q1) THEN q3 + 0.5 * (q3 - q1) ELSE value END, 4) AS value FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (event_type)")
def outlier_cap(spark, d):
    events = read(spark, d, "events").select("event_id", "event_type", "value")
    return rounded(outlier.correct_outliers(events, outlier.Outlier("value", "iqr", ("event_type",), k=0.5), "capToBounds").select("event_id", "value"), "value")


def _holes(spark, d):
    return read(spark, d, "events").select("event_id", "event_type", (F.floor(F.col("event_id") / 50)).alias("g"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))


_GAPS = "(SELECT event_id, event_type, CAST(floor(event_id / 50) AS BIGINT) AS g, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)"


@query(f"SELECT event_id, event_type, g, last_value(v IGNORE NULLS) OVER (PARTITION BY g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM {_GAPS}")
def fill_forward(spark, d):
    return repair.repair(_holes(spark, d), repair.Repair("fillForward", ("v",), groups=("g",)), ["event_id"])


@query(f"SELECT event_id, event_type, g, first_value(v IGNORE NULLS) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {_GAPS}")
def fill_backward(spark, d):
    return repair.repair(_holes(spark, d), repair.Repair("fillBackward", ("v",), groups=("g",)), ["event_id"])


@query(f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {_GAPS})), 4) AS v FROM {_GAPS}")
def fill_mean(spark, d):
    return rounded(repair.repair(_holes(spark, d), repair.Repair("fillMean", ("v",))).select("event_id", "v"), "v")


@query(f"SELECT event_id, round(coalesce(v, (SELECT median(v) FROM {_GAPS})), 4) AS v FROM {_GAPS}")
def fill_median(spark, d):
    return rounded(repair.repair(_holes(spark, d), repair.Repair("fillMedian", ("v",))).select("event_id", "v"), "v")


@query("WITH t AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS t FROM events) SELECT event_id, coalesce(t, (SELECT t FROM t WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)) AS t FROM t")
def fill_mode(spark, d):
    events = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("t"))
    return repair.repair(events, repair.Repair("fillMode", ("t",)))


@query(f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM {_GAPS}), q AS (SELECT event_id, v, r, max(CASE WHEN v IS NOT NULL THEN r END) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN v IS NOT NULL THEN r END) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p)
SELECT q.event_id, round(CASE WHEN q.v IS NOT NULL THEN q.v WHEN x.v IS NOT NULL AND y.v IS NOT NULL THEN x.v + (y.v - x.v) * (q.r - q.a) / (q.b - q.a) ELSE coalesce(x.v, y.v) END, 4) AS v FROM q LEFT JOIN p x ON x.r = q.a LEFT JOIN p y ON y.r = q.b""")
def interpolate(spark, d):
    return rounded(repair.repair(_holes(spark, d), repair.Repair("interpolate", ("v",), extrapolate=True), ["event_id"]).select("event_id", "v"), "v")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, 'none') AS p FROM orders")
def repair_constants(spark, d):
    k = F.col("o_orderkey")
    orders = read(spark, d, "orders").select("o_orderkey", F.when(k % 5 == 0, " N/A ").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("p"))
    cleaned = repair.repair(orders, repair.Repair("normalizeNullTokens", ("s",)))
    return repair.repair(cleaned, repair.Repair("fillConstant", ("p",), value="none"))


@query("WITH t AS (SELECT value AS v, p_name AS n FROM (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE p_name || ' ' END AS value FROM part)), k AS (SELECT array_to_string(list_sort(list_distinct(string_split(lower(trim(v)), ' '))), ' ') AS c, v, count(*) AS n FROM t GROUP BY 1, 2) SELECT first(v ORDER BY n DESC, v) AS suggestion, CAST(sum(n) AS BIGINT) AS rows, count(*) AS values FROM k GROUP BY c HAVING count(*) > 1")
def cluster_fingerprint(spark, d):
    odd = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    return cluster.cluster_values(read(spark, d, "part").select(odd.alias("name")), cluster.Cluster("name")).select("suggestion", "rows", "values")


_NAMES = "(SELECT p_name || CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '' END AS v, count(*) AS n FROM part GROUP BY 1)"


@query(f"""WITH RECURSIVE v AS (SELECT * FROM {_NAMES}), l AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON a.v <> b.v AND levenshtein(a.v, b.v) <= 1), r(a, b) AS (SELECT v, v FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS v, min(b) AS c FROM r GROUP BY a)
SELECT first(v ORDER BY n DESC, v) AS suggestion, CAST(sum(n) AS BIGINT) AS rows, count(*) AS values FROM c JOIN v USING (v) GROUP BY c HAVING count(*) > 1""")
def cluster_levenshtein(spark, d):
    odd = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(""))
    return cluster.cluster_values(read(spark, d, "part").select(odd.alias("name")), cluster.Cluster("name", "levenshtein", threshold=1)).select("suggestion", "rows", "values")


@query()
def cluster_jaro_winkler(spark, d):
    odd = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(""))
    return cluster.cluster_values(read(spark, d, "part").select(odd.alias("name")), cluster.Cluster("name", "jaroWinkler", threshold=0.97)).select("suggestion", "rows", "values")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name END AS name FROM part")
def apply_mapping(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("name"))
    mapping = part.filter("name LIKE '%!'").select(F.col("name").alias("value"), F.rtrim("name", F.lit("!")).alias("to")).distinct()
    return cluster.apply_mapping(part, "name", mapping)


def _people(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 2 == 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))).otherwise("none").alias("mail"),
        F.when(k % 3 == 0, F.concat(F.lpad((k % 899 + 1).cast("string"), 3, "0"), F.lit("-12-3456"))).otherwise("-").alias("ssn"),
        F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit("."), (k % 300).cast("string")).alias("host"),
    )


@query("""SELECT 'email' AS detector, 'mail' AS "column", count(*) FILTER (c_custkey % 2 = 0) AS matches FROM customer UNION ALL SELECT 'ssn', 'ssn', count(*) FILTER (c_custkey % 3 = 0 AND c_custkey % 899 + 1 <> 666) FROM customer
UNION ALL SELECT 'ipAddress', 'host', count(*) FILTER (c_custkey % 300 < 256) FROM customer UNION ALL SELECT 'phoneNumber', 'ssn', count(*) FILTER (c_custkey % 3 = 0) FROM customer""")
def pii_scan(spark, d):
    return pii.pii_scan(_people(spark, d), columns=["mail", "ssn", "host"]).select("detector", "column", "matches")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN repeat('•', length(c_name) + 12 - 4) || '.com' ELSE 'none' END AS mail, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 899 + 1 <> 666 THEN '[REDACTED]' WHEN c_custkey % 3 = 0 THEN '666-12-3456' ELSE '-' END AS ssn FROM customer")
def redact_mask(spark, d):
    people = _people(spark, d).drop("host")
    masked = pii.redact(people, pii.Detector("email"), "mail", pii.Redaction("keepLast", keep=4))
    return pii.redact(masked, pii.Detector("ssn"), "ssn", pii.Redaction("fixed"))


_PADS = fn.hmac_pads("a secret", "00ff")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'pii_' || left(sha256(from_hex('{_PADS[1].hex()}') || from_hex(sha256(from_hex('{_PADS[0].hex()}') || encode(lower(replace(c_name, '#', '.')) || '@example.com')))), 16) ELSE 'none' END AS mail FROM customer")
def pseudonymize(spark, d):
    return pii.redact(_people(spark, d), pii.Detector("email"), "mail", pii.Redaction("pseudonymize", secret="a secret", salt="00ff")).select("c_custkey", "mail")


def _versions(spark, d):
    k = F.col("o_orderkey")
    old = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = old.filter(k % 13 != 0).withColumns({"o_orderstatus": F.when(k % 17 == 0, "Z").otherwise(F.col("o_orderstatus")), "o_orderkey": F.when(k % 19 == 0, k + 10_000_000).otherwise(k)})
    return old, new


_NEW = "(SELECT CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k, o_custkey AS c, CASE WHEN o_orderkey % 17 = 0 THEN 'Z' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 13 <> 0)"


@query(f"SELECT CASE WHEN k IS NULL THEN 'removed' WHEN o_orderkey IS NULL THEN 'added' WHEN o_orderstatus = s THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS records FROM orders FULL JOIN {_NEW} ON o_orderkey = k GROUP BY 1")
def compare_keyed(spark, d):
    old, new = _versions(spark, d)
    pairs = tuple((c, c) for c in old.columns)
    return compare.compare_tables(old, new, compare.Compare(("o_orderkey",), ("o_orderkey",), pairs)).summary


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, 'o_orderstatus' AS \"column\", o_orderstatus AS before, s AS after FROM orders JOIN {_NEW} ON o_orderkey = k WHERE o_orderstatus <> s")
def compare_cells(spark, d):
    old, new = _versions(spark, d)
    pairs = tuple((c, c) for c in old.columns)
    cells = compare.compare_tables(old, new, compare.Compare(("o_orderkey",), ("o_orderkey",), pairs)).cells
    return cells.select(F.replace(F.get("key", F.lit(0)), F.lit("t:"), F.lit("")).alias("key"), "column", "before", "after")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY event_id) AS r, event_type FROM events), b AS (SELECT row_number() OVER (ORDER BY event_id) AS r, event_type FROM events WHERE event_id % 1000 <> 7) SELECT CASE WHEN b.r IS NULL THEN 'removed' WHEN a.event_type = b.event_type THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS records FROM a LEFT JOIN b USING (r) GROUP BY 1")
def compare_positional(spark, d):
    events = read(spark, d, "events").select("event_id", "event_type")
    return compare.compare_tables(events, events.filter("event_id % 1000 <> 7"), compare.Compare(("event_id",), mapping=(("event_type", "event_type"),))).summary


@query("SELECT CASE WHEN n > 1 OR m > 1 THEN 'conflict' ELSE 'other' END AS status, CAST(sum(CASE WHEN n > 1 OR m > 1 THEN n + greatest(m - (CASE WHEN n > 0 THEN 1 ELSE 0 END), 0) ELSE 1 END) AS BIGINT) AS records FROM (SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS n, count(*) FILTER (event_id % 2 = 1) AS m FROM events GROUP BY 1) GROUP BY 1")
def compare_conflicts(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id")
    found = compare.compare_tables(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), compare.Compare(("event_id",), ("user_id",), (("user_id", "user_id"),)))
    return found.summary.groupBy(F.when(F.col("status") == "conflict", "conflict").otherwise("other").alias("status")).agg(F.sum("records").alias("records"))


# --- B: what sinks compute ------------------------------------------------------------------------------------------


@query("SELECT event_id, lpad(CAST(CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 3) AS INTEGER) + 1 AS VARCHAR), CAST(greatest(3, (SELECT length(CAST(CAST(ceil(count(*) / 3) AS INTEGER) AS VARCHAR)) FROM events)) AS INTEGER), '0') AS part FROM events")
def split_by_rows(spark, d):
    """Thousands of parts, whose labels are as wide as the last one needs."""
    return export.split_labels(read(spark, d, "events").select("event_id", "event_type"), export.Split("rows", 3), ["event_id"]).select("event_id", "part")


@query("SELECT c_custkey, replace(c_mktsegment, '/', '_') AS part FROM customer")
def split_by_value(spark, d):
    return export.split_labels(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), export.Split("column", column="c_mktsegment")).select("c_custkey", "part")


@query("SELECT '(' || '''' || CAST(r_regionkey AS VARCHAR) || ''', ''' || replace(r_name, '''', '''''') || ''')' AS value FROM region UNION ALL SELECT '(' || '''' || CAST(n_nationkey AS VARCHAR) || ''', ''' || replace(n_name, '''', '''''') || ''')' FROM nation")
def render_sql_values(spark, d):
    return export.render_rows(read(spark, d, "region").toDF("k", "n").unionByName(read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))), "sqlValues")


@query("SELECT 'text' AS \"column\", count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS cells FROM documents")
def encoding_check(spark, d):
    return export.unencodable(read(spark, d, "documents").select("doc_id", "text"), "ascii", "doc_id")[0]


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def strip_cells(spark, d):
    return read(spark, d, "documents").select("doc_id", strip(F.col("text")).alias("text"))


# --- A, N, O: files, streams, recipes over tables that Spark writes out first -----------------------------------------


def _as_files(spark, df: DataFrame, files: int, **options) -> str:
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    export.write_delimited(df.repartition(files), path, export.Export(**options))
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_round_trip(spark, d):
    path = _as_files(spark, read(spark, d, "documents").select("doc_id", "text", "lang"), 3)
    return delimited.read_delimited(spark, path, delimited.Dialect(multi_line=True), width=3)


def _as_lines(spark, lines, files: int, **options) -> str:
    """Writes ready-made records (a text column), as they are."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    lines.repartition(files).write.options(**options).text(path)
    return path


_RAGGED = "(SELECT CASE WHEN c_custkey % 10 = 0 THEN 2 WHEN c_custkey % 10 = 1 THEN 4 ELSE 3 END AS n, c_custkey FROM customer)"


def _ragged(spark, d):
    """Every tenth record is short, every tenth long; delimiters and line ends in quotes don't count."""
    k = F.col("c_custkey")
    tail = F.when(k % 10 == 0, "").when(k % 10 == 1, ";more;even more").otherwise(';"a;b"')
    return _as_lines(spark, read(spark, d, "customer").select(F.concat(k.cast("string"), F.lit(';"x'), F.when(k % 3 == 0, "\n").otherwise(";"), F.lit('y"'), tail)), 4)


@query(f"SELECT CAST(3 AS INTEGER) AS expected, count(*) AS records, count(*) FILTER (n <> 3) AS ragged FROM {_RAGGED}")
def ragged_report(spark, d):
    return delimited.ragged_report(spark, _ragged(spark, d), delimited.Dialect(delimiter=";", multi_line=True))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c0, CASE WHEN c_custkey % 3 = 0 THEN 'x' || chr(10) || 'y' ELSE 'x;y' END AS c1, CASE n WHEN 2 THEN '' WHEN 4 THEN 'more' ELSE 'a;b' END AS c2, CASE n WHEN 4 THEN 'even more' ELSE '' END AS c3 FROM {_RAGGED}")
def ragged_padding(spark, d):
    """The widest record sets the width; no line end in quotes makes a record."""
    return delimited.read_delimited(spark, _ragged(spark, d), delimited.Dialect(delimiter=";", multi_line=True, header_rows=0)).toDF("c0", "c1", "c2", "c3")


@query(f"SELECT CAST(n AS INTEGER) AS fields, count(*) AS records FROM {_RAGGED} WHERE n <> 3 GROUP BY 1")
def ragged_sample(spark, d):
    found = delimited.ragged_sample(spark, _ragged(spark, d), delimited.Dialect(delimiter=";", multi_line=True), n=read(spark, d, "customer").count())
    return found.groupBy("fields").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN ';' ELSE '|' END AS delimiter, count(*) AS parts FROM part GROUP BY 1")
def infer_delimiters(spark, d):
    """Two kinds of files in one folder; every record goes by its own file's delimiter."""
    part, top = read(spark, d, "part").select("p_partkey", "p_name", "p_brand"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for i, delimiter in enumerate(";|"):
        export.write_delimited(part.filter(F.col("p_partkey") % 2 == i).repartition(2), f"{top}/{i}", export.Export(delimiter=delimiter, header=False))
    found = delimited.infer_delimiters(spark, [f"{top}/0", f"{top}/1"])
    lines = spark.read.text([f"{top}/0", f"{top}/1"]).select(F.col("_metadata.file_path").alias("_file"))
    return lines.join(found, "_file").groupBy("delimiter").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events WHERE event_type <> 'view'")
def follow_files(spark, d):
    path = _as_files(spark, read(spark, d, "events").select("event_id", "event_type"), 5)
    where = [f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("out", "state", "aside", "alerts")]
    stream = follow.follow(spark, path, ["event_id", "event_type"], spec=Condition("event_type", "notEquals", "view"), max_files=2)
    follow.start(stream, *where, available_now=True).awaitTermination()
    return spark.read.parquet(where[0]).select("event_id", "event_type")


@query("SELECT DISTINCT upper(p_name) AS p_name FROM part WHERE p_size > 10")
def recipe_run(spark, d):
    path = _as_files(spark, read(spark, d, "part").select("p_partkey", "p_name", "p_size"), 3)
    steps = ({"kind": "filter", "filter": {"column": "p_size", "operator": "gt", "value": "10"}}, {"kind": "transform", "transform": "uppercase", "columns": ["p_name"]}, {"kind": "deduplicate", "columns": ["p_name"]}, {"kind": "selectColumns", "columns": ["p_name"]}, {"kind": "export"})
    out = f"{shared_folder(spark)}/recipe-{uuid.uuid4().hex}"
    report = recipe.run_recipe(spark, recipe.Recipe("names", steps), [path], out).first()
    if report["status"] != "ok":
        raise ValueError(report["message"])
    return delimited.read_delimited(spark, report["output"], width=1)


# --- more of the same operators' options ------------------------------------------------------------------------------

_TYPES = ("click", "error", "purchase", "signup", "view")


@query(_PIVOT.format(", ".join(f"arg_min(value, event_id) FILTER (event_type = '{t}') AS \"{t}\"" for t in _TYPES)))
def pivot_first(spark, d):
    return reshape.pivot(read(spark, d, "events"), reshape.Pivot(("user_id",), "event_type", "value", "first", order_by=("event_id",)))


@query(_PIVOT.format(", ".join(f"round(median(value) FILTER (event_type = '{t}'), 4) AS \"{t}\"" for t in _TYPES)))
def pivot_median(spark, d):
    out = reshape.pivot(read(spark, d, "events"), reshape.Pivot(("user_id",), "event_type", "value", "median"))
    return rounded(out, *[c for c in out.columns if c != "user_id"])


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_folded_keys(spark, d):
    """Keys that differ in case and in white space around them."""
    left = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" CUST-"), F.col("o_custkey")).alias("k"))
    right = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("cust-"), F.col("c_custkey"), F.lit("\t")).alias("k"))
    return joins.join_tables(left, right, joins.JoinSpec((("k", "k"),), case_insensitive=True, right_columns=("c_custkey",))).select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY date_trunc('day', o_orderdate)) AS first_of_day FROM orders")
def join_on_dates(spark, d):
    """Days that are written in two ways; the right table has one row for each day of all orders."""
    orders = read(spark, d, "orders")
    left = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    right = orders.groupBy(F.date_format("o_orderdate", "M/d/yyyy").alias("day")).agg(F.min("o_orderkey").alias("first_of_day"))
    return joins.join_tables(left, right, joins.JoinSpec((("day", "day"),), date_equal=True, right_columns=("first_of_day",))).select("o_orderkey", "first_of_day")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS records FROM orders GROUP BY 1")
def compare_equivalence(spark, d):
    """Numbers, dates, case and white space written in two ways are equal; every fifth number isn't."""
    k, orders = F.col("o_orderkey"), read(spark, d, "orders")
    old = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"), F.col("o_orderpriority").alias("p"))
    new = orders.select("o_orderkey", F.concat((F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0)).cast("string"), F.lit(".0")).alias("n"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("t"), F.concat(F.lit("  "), F.lower("o_orderpriority")).alias("p"))
    spec = compare.Compare(("o_orderkey",), ("o_orderkey",), tuple((c, c) for c in old.columns), trim=True, case_insensitive=True, numeric_equal=True, date_equal=True)
    return compare.compare_tables(old, new, spec).summary


@query("""WITH t AS (SELECT c_custkey, CAST(floor((sum(length(c_name) + length(CAST(c_custkey AS VARCHAR)) + 3) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) - 1) / 30) AS INTEGER) + 1 AS n FROM customer)
SELECT c_custkey, lpad(CAST(n AS VARCHAR), CAST(greatest(3, (SELECT length(CAST(max(n) AS VARCHAR)) FROM t)) AS INTEGER), '0') AS part FROM t""")
def split_by_bytes(spark, d):
    return export.split_labels(read(spark, d, "customer").select("c_custkey", "c_name"), export.Split("bytes", 30), ["c_custkey"]).select("c_custkey", "part")


@query("SELECT 'o_orderpriority' AS \"column\", count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) AS tokens FROM orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus = 'P') FROM orders")
def null_tokens(spark, d):
    return delimited.null_token_counts(read(spark, d, "orders").select("o_orderpriority", "o_orderstatus"), ["1-URGENT ", "5-LOW", "P"])


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def named_view(spark, d):
    text = '{"name": "finished", "filter": {"column": "o_orderstatus", "operator": "equals", "value": "f"}, "sort": [{"column": "o_totalprice", "descending": true}, {"column": "gone"}], "layout": {"hidden": ["o_custkey", "o_orderstatus", "o_orderdate"], "pinned": ["o_orderpriority"]}}'
    return views.apply_view(read(spark, d, "orders"), views.load_view(text), ["o_orderkey"]).df


@query("SELECT c_mktsegment AS segment, count(*) AS rows, CAST(sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + 2) AS BIGINT) + 17 AS bytes, sha256('c_custkey,c_name' || chr(10) || string_agg(CAST(c_custkey AS VARCHAR) || ',' || c_name || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY 1")
def export_manifest(spark, d):
    """One file for each segment; the SQL makes each file's text and digests it."""
    customers, top = read(spark, d, "customer"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for r in customers.select("c_mktsegment").distinct().collect():
        own = customers.filter(F.col("c_mktsegment") == r[0]).select("c_custkey", "c_name").coalesce(1).sortWithinPartitions("c_custkey")
        export.write_delimited(own, f"{top}/{r[0]}")
    listed = export.manifest(spark, f"{top}/*")
    return listed.select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("segment"), "rows", "bytes", "sha256")


@query("SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND event_id % 2 = 0)")
def remove_blank_rows(spark, d):
    events = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 2 != 0, F.col("value")).alias("b"))
    return repair.remove_blank_rows(events, ["a", "b"], 1.0).select("event_id")


@query("SELECT 'v' AS \"column\", count(*) FILTER (event_id % 3 <> 0) AS filled, CAST(0 AS BIGINT) AS still_blank, CAST(0 AS BIGINT) AS invalid_numeric FROM events")
def repair_report(spark, d):
    before = _holes(spark, d)
    return repair.repair_report(before, repair.repair(before, repair.Repair("fillMedian", ("v",))), ["v"], "event_id")


@query("SELECT page_id, lower(url) AS url FROM pages")
def semantic_action(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.concat(F.lit(" "), F.lower("url"), F.lit(" ")).alias("url"))
    return semantic.semantic_action(pages, "url", "url", "normalize")


@query("SELECT event_id FROM events WHERE event_id >= (SELECT event_id FROM events ORDER BY event_id LIMIT 1 OFFSET 7000)")
def rows_from(spark, d):
    return project.rows_from(read(spark, d, "events").select("event_id"), ["event_id"], 7000)


@query("SELECT p_partkey, p_type AS kind, upper(p_type) AS loud FROM part")
def replace_columns(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return project.replace_columns(part, 1, 2, {"kind": F.col("p_type"), "loud": F.upper("p_type")})


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END = CASE WHEN c_custkey = 1 THEN '' ELSE CAST(c_custkey AS VARCHAR) END")
def join_blank_keys(spark, d):
    """Blank keys match each other here; one customer has one."""
    left = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("k"))
    right = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("k"))
    return joins.join_tables(left, right, joins.JoinSpec((("k", "k"),), blank_equal=True, right_columns=("c_custkey",))).select("o_orderkey", "c_custkey")


@query("SELECT a.p_partkey, a.p_name, b.p_name AS \"p_name (right)\", b.p_brand FROM part a JOIN part b USING (p_partkey)")
def join_suffix(spark, d):
    part = read(spark, d, "part")
    spec = joins.JoinSpec((("p_partkey", "p_partkey"),), right_columns=("p_name", "p_brand"), max_output_rows=10**12)
    return joins.join_tables(part.select("p_partkey", "p_name"), part, spec)


@query("SELECT event_type, count(*) AS \"count(*)\", round(sum(value), 4) AS \"sum(value)\", max(value) AS \"max(value)\", count(DISTINCT user_id) AS \"countDistinct(user_id)\" FROM events GROUP BY 1")
def groupby_default_names(spark, d):
    spec = GroupBy(("event_type",), (Aggregate("count"), Aggregate("sum", "value"), Aggregate("max", "value"), Aggregate("countDistinct", "user_id")))
    return rounded(grouping.group_by(read(spark, d, "events"), spec), "sum(value)")


@query("SELECT 'day' AS \"column\", strftime(min(o_orderdate), '%-m/%-d/%Y') AS earliest, strftime(max(o_orderdate), '%-m/%-d/%Y') AS latest, count(*) AS rows, count(*) AS dates, CAST(min(length(strftime(o_orderdate, '%-m/%-d/%Y'))) AS INTEGER) AS shortest, CAST(max(length(strftime(o_orderdate, '%-m/%-d/%Y'))) AS INTEGER) AS longest, round(avg(length(strftime(o_orderdate, '%-m/%-d/%Y'))), 4) AS mean_length FROM orders WHERE o_orderstatus = 'F'")
def profile_dates(spark, d):
    """Dates as text, of the rows in scope alone."""
    orders = read(spark, d, "orders").select(F.date_format("o_orderdate", "M/d/yyyy").alias("day"), "o_orderstatus")
    found = profile.profile_columns(orders, ["day"], scope=F.col("o_orderstatus") == "F")
    return rounded(found.select("column", "earliest", "latest", "rows", "dates", "shortest", "longest", "mean_length"), "mean_length")


@query("SELECT p_partkey, regexp_replace(p_name, '\\s+', ' ', 'g') AS a, regexp_replace(p_brand, '^Brand#(\\d)(\\d)$', '\\2-\\1') AS b, CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE p_type END AS c, p_type || ';' AS e FROM part")
def transform_more(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("a"), F.col("p_brand").alias("b"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("c"), F.col("p_type").alias("e"))
    out = transform.transform(part, transform.Transform("collapseWhitespace"), ["a"])
    out = transform.transform(out, transform.Transform("replaceRegex", {"pattern": r"^Brand#(\d)(\d)$", "replace": "$2-$1"}), ["b"])
    out = transform.transform(out, transform.Transform("fillBlank", {"value": "none"}), ["c"])
    return transform.transform(out, transform.Transform("addSuffix", {"value": ";"}), ["e"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 250) / 200.0 END AS share, CAST(o_orderkey AS VARCHAR) AS whole, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 1000 + 0.5 AS VARCHAR) ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS shown FROM orders")
def numbers_as_text(spark, d):
    """Percentages as shares, whole numbers without a point."""
    k = F.col("o_orderkey")
    orders = read(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, F.concat(((k % 250) / 2).cast("string"), F.lit("%"))).otherwise((k % 250).cast("string")).alias("p"))
    return orders.select("o_orderkey", fn.percent_to_decimal(F.col("p")).alias("share"), rendered(k.cast("double")).alias("whole"), rendered(k % 1000 + F.when(k % 2 == 0, 0.5).otherwise(0.0)).alias("shown"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(lower(replace(p_name, 'e', 'e')), ' ')), ' ') AS sorted FROM part")
def similarity_normal_form(spark, d):
    odd = F.concat(F.lit(" "), F.upper(F.translate("p_name", "eo", "éö")), F.lit("!! "))
    return read(spark, d, "part").select("p_partkey", fn.normalise(odd, sort_words=True).alias("sorted"))


@query("SELECT c_custkey, length(c_name) > 0 AND ((c_custkey % 10) + CASE WHEN 2 * (c_custkey // 10 % 10) > 9 THEN 2 * (c_custkey // 10 % 10) - 9 ELSE 2 * (c_custkey // 10 % 10) END) % 10 = 0 AS card, c_custkey % 3 = 0 AS code FROM customer")
def card_numbers(spark, d):
    """Sixteen digits, of which two aren't 0, pass the check of payment cards or not; a custom pattern beside it."""
    k = F.col("c_custkey")
    card = F.concat(F.lit("0000 0000 0000 00"), F.lpad((k % 100).cast("string"), 2, "0"))
    code = F.concat(F.when(k % 3 == 0, "ACC-").otherwise("ACK-"), F.lpad((k % 100_000).cast("string"), 5, "0"))
    return read(spark, d, "customer").select("c_custkey", fn.matches_pii(card, "paymentCard").alias("card"), fn.matches_pii(code, "custom", r"ACC-\d{5}").alias("code"))


@query("SELECT 'email' AS detector, 'mail' AS \"column\", 'fullMask' AS action, count(*) FILTER (c_custkey % 2 = 0) AS cells FROM customer")
def redaction_audit(spark, d):
    return pii.redaction_audit(_people(spark, d), pii.Detector("email"), "mail", pii.Redaction("fullMask"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 899 + 1 <> 666 THEN repeat('•', 11) WHEN c_custkey % 3 = 0 THEN '666-12-3456' ELSE '-' END AS ssn FROM customer WHERE c_custkey % 2 <> 0")
def redact_rows(spark, d):
    """Rows with a mail go, numbers are masked in full."""
    people = pii.redact(_people(spark, d).drop("host"), pii.Detector("email"), "mail", pii.Redaction("removeRows"))
    return pii.redact(people, pii.Detector("ssn"), "ssn", pii.Redaction("fullMask")).select("c_custkey", "ssn")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey % 4 <> 0")
def mixed_type_rows(spark, d):
    k = F.col("o_orderkey")
    odd = read(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, "").when(k % 9 == 0, "n/a").otherwise(k.cast("string")).alias("x"))
    return diagnose.issue_rows(odd, "mixedTypes", "x").select("o_orderkey")


@query("""SELECT 'needs' AS rule, count(*) FILTER (event_type = 'purchase' AND event_id % 3 = 0) AS violations FROM events UNION ALL SELECT 'one', count(*) FILTER ((event_id % 3 <> 0) = (event_id % 2 <> 0)) FROM events
UNION ALL SELECT 'some', count(*) FILTER (event_id % 6 = 0) FROM events UNION ALL SELECT 'most', count(*) FILTER (event_id % 3 <> 0 AND event_id % 2 <> 0) FROM events""")
def rules_of_presence(spark, d):
    k, rule = F.col("event_id"), rules.Rule
    events = read(spark, d, "events").select("event_type", F.when(k % 3 != 0, "x").alias("a"), F.when(k % 2 != 0, "y").alias("b"))
    return rules.check_rules(events, [rule("needs", "conditionalRequired", ("event_type", "a"), (("when", "equals"), ("value", "purchase"))), rule("one", "exactlyOne", ("a", "b")), rule("some", "atLeastOne", ("a", "b")), rule("most", "atMostOne", ("a", "b"))])


@query("SELECT 'dear' AS rule, o_orderkey, CAST(o_custkey AS VARCHAR) AS cell FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey > 10) WHERE k <= 50 UNION ALL SELECT 'same', o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') WHERE k <= 50")
def rule_samples(spark, d):
    orders = read(spark, d, "orders").withColumns({"ten": F.lit(10), "f": F.lit("F")})
    found = rules.rule_samples(orders, [rules.Rule("dear", "numericCompare", ("o_custkey", "ten")), rules.Rule("same", "columnsEqual", ("o_orderstatus", "f"))], "o_orderkey", 50)
    return found.select("rule", "o_orderkey", F.coalesce(F.try_element_at("cells", F.lit("o_custkey")), F.try_element_at("cells", F.lit("o_orderstatus"))).alias("cell"))


@query("SELECT o_orderkey, o_orderstatus NOT IN ('F', 'O') AS other, NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$') AS shape FROM orders")
def outlier_categories(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    one = outlier.flag_outliers(orders, outlier.Outlier("o_orderstatus", "unexpectedCategory", allowed=("F", "O")), "other")
    return outlier.flag_outliers(one, outlier.Outlier("o_orderpriority", "patternMismatch", pattern="[1-3]-[A-Z]+"), "shape").select("o_orderkey", "other", "shape")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS before, 'Z' AS after FROM orders WHERE o_orderkey % 17 = 0 AND o_orderstatus <> 'Z'")
def change_report(spark, d):
    """Columns are compared by their place: the right table names them otherwise, and has one more."""
    old = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = old.select(F.col("o_orderkey").alias("o_orderkey"), F.when(F.col("o_orderkey") % 17 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("state"), F.col("o_custkey").alias("who"), F.lit("more").alias("more"))
    cells = compare.change_report(old, new, compare.Compare(("o_orderkey",), ("o_orderkey",)))
    return cells.filter("column = 'o_orderstatus'").select(F.replace(F.get("key", F.lit(0)), F.lit("t:"), F.lit("")).alias("key"), "before", "after")


@query("SELECT o_orderkey, 'changed' AS status FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 17 = 0 AND o_orderstatus <> 'Z' ORDER BY o_orderkey LIMIT 100 OFFSET 50)")
def compare_page(spark, d):
    """The second page of changed records."""
    old = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = old.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, "Z").otherwise(F.col("o_orderstatus")))
    found = compare.compare_tables(old, new, compare.Compare(("o_orderkey",), ("o_orderkey",)))
    return compare.results_page(found, 50, 100, ["changed"]).select(F.col("left_key.o_orderkey").alias("o_orderkey"), "status")


@query("SELECT CAST(count(*) AS BIGINT) AS considered, count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY user_id)")
def dedup_blank_keys(spark, d):
    """Blank keys are left out; the report counts groups of the others."""
    events = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("u"))
    found = dedup.duplicate_report(events, dedup.Dedup(("u",), exclude_blank_keys=True), ["event_id"])
    return found.select(F.col("remaining").alias("considered"), "groups")


@query("SELECT 'customers' AS input, 'ok' AS status, count(*) AS rows FROM customer UNION ALL SELECT 'suppliers', 'ok', count(*) FROM supplier")
def append_report(spark, d):
    return append.append_report(_parties(spark, d), append.Append("nameInsensitive")).select("input", "status", "rows")


@query("SELECT c_custkey AS key, c_name AS \"Name\", c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def append_primary(spark, d):
    return append.append_tables(_parties(spark, d), append.Append("nameInsensitive", "primary"))


@query(_PIVOT.format(", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 8) AS \"{t}\"" for t in _TYPES)))
def pivot_mean(spark, d):
    out = reshape.pivot(read(spark, d, "events"), reshape.Pivot(("user_id",), "event_type", "value", "mean"))
    # many means of values of two digits end right between two numbers of four digits, which the order of summation then decides
    return rounded(out, *[c for c in out.columns if c != "user_id"], digits=8)


@query(_PIVOT.format(", ".join(f"max(value) FILTER (event_type = '{t}') AS \"{t}\"" for t in _TYPES)))
def pivot_max(spark, d):
    return reshape.pivot(read(spark, d, "events"), reshape.Pivot(("user_id",), "event_type", "value", "max"))


@query("SELECT 'extraColumn' AS issue, 'o_comment' AS \"column\", CAST(1 AS BIGINT) AS count UNION ALL SELECT 'typeMismatch', 'o_custkey', count(*) FILTER (o_orderkey % 5 = 0) FROM orders")
def profile_extra_column(spark, d):
    k, rule = F.col("o_orderkey"), diagnose.ColumnRule
    orders = read(spark, d, "orders").select("o_orderkey", F.when(k % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"), F.lit("c").alias("o_comment"))
    return diagnose.validate_profile(orders, diagnose.FileProfile((rule("o_orderkey", unique=True), rule("o_custkey", kind="number")), allow_extra=False))


@query("SELECT event_id, event_type FROM events")
def json_lines_round_trip(spark, d):
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    export.write_json_lines(read(spark, d, "events").select("event_id", "event_type"), path)
    return spark.read.schema("event_id long, event_type string").json(path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || 'é€' AS p_name FROM part WHERE p_size > 20")
def encoded_round_trip(spark, d):
    """Scoped rows and chosen columns, in windows-1252, always quoted, with semicolons, compressed, and read again."""
    part, path = read(spark, d, "part").withColumn("p_name", F.concat("p_name", F.lit("é€"))), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    export.write_delimited(part, path, export.Export(delimiter=";", quote="always", encoding="windows-1252", gzip=True), scope=F.col("p_size") > 20, columns=["p_partkey", "p_name"])
    return delimited.read_delimited(spark, path, delimited.Dialect(delimiter=";", encoding="windows-1252"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS \"Key\", s_name AS \"Name First\", CAST(row_number() OVER (ORDER BY s_suppkey) + 4 AS BIGINT) AS number FROM supplier")
def skipped_and_stacked_headers(spark, d):
    """Two records before the header, which is two rows, and a total after the data; records keep their numbers."""
    text = read(spark, d, "supplier").select(F.col("s_suppkey").alias("at"), F.concat_ws(",", F.col("s_suppkey"), F.col("s_name")).alias("value"))
    edge = spark.createDataFrame([(-4, "made by hand,x"), (-3, "on a day,y"), (-2, "Key,Name"), (-1, ",First"), (10**15, "TOTAL,1")], "at long, value string")
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    text.unionByName(edge).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    found = delimited.read_delimited(spark, path, delimited.Dialect(skip_first=2, skip_last=1, header_rows=2), record_numbers=True)
    return found.withColumnRenamed("_record", "number")


@query("SELECT c_mktsegment AS segment, true AS header FROM customer GROUP BY 1")
def header_detection(spark, d):
    customers, top = read(spark, d, "customer"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    export.write_delimited(customers.select("c_custkey", "c_name", "c_mktsegment"), top, split=export.Split("column", column="c_mktsegment"))
    found = delimited.has_header(spark, top)
    return found.groupBy(F.regexp_extract("_file", "part=([^/]*)/", 1).alias("segment")).agg(F.every("header").alias("header"))


@query("SELECT 'delimiter' AS what, ',' AS a, ';' AS b UNION ALL SELECT 'header', 's_suppkey' || chr(31) || 's_name', 's_suppkey,s_name' UNION ALL SELECT 'columns', '2', '1' FROM (SELECT count(*) AS n FROM supplier) WHERE n > 0")
def reading_differences(spark, d):
    path = _as_files(spark, read(spark, d, "supplier").select("s_suppkey", "s_name"), 2)
    return delimited.reading_differences(spark, path, delimited.Dialect(), delimited.Dialect(delimiter=";"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'docs' WHEN page_id % 3 = 1 THEN 'tables' ELSE 'logs' END AS profile FROM pages")
def match_profiles(spark, d):
    """Of the profiles that match a path the most exact kind wins."""
    k = F.col("page_id")
    files = read(spark, d, "pages").select("page_id", F.concat(F.lit("/data/"), F.when(k % 3 == 0, "docs/").otherwise(""), F.lit("f-"), k, F.when(k % 3 == 1, ".csv").otherwise(".log")).alias("path"))
    profiles = spark.createDataFrame([("docs", "directory", "/data/docs"), ("tables", "extension", "csv"), ("logs", "glob", "f-*.log"), ("all", "extension", "log")], "profile string, kind string, pattern string")
    return files.join(delimited.match_profiles(files, profiles), "path").select("page_id", "profile")


@query("SELECT count(*) FILTER (event_id % 10 = 0) AS damaged, count(*) FILTER (event_id % 10 <> 0) AS sound FROM events")
def damaged_cells(spark, d):
    """Bytes that are no UTF-8 become replacement characters when they are read."""
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.col("event_type"), F.lit("é"))).otherwise(F.col("event_type"))
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    export.write_delimited(read(spark, d, "events").select(text.alias("t")), path, export.Export(encoding="iso-8859-1"))
    got = delimited.read_delimited(spark, path)
    return delimited.damaged_cells(got).select("damaged", (F.lit(got.count()) - F.col("damaged")).alias("sound"))


@query("SELECT 'widthChanged' AS alert, count(*) AS records FROM events WHERE event_id % 8 = 0 UNION ALL SELECT 'encodingChanged', count(*) FROM events WHERE event_id % 8 = 1")
def follow_alerts(spark, d):
    """Records of another width and damaged ones are set aside and told; the stream is started twice on one checkpoint."""
    k = F.col("event_id") % 8
    path = _as_lines(spark, read(spark, d, "events").select(F.concat_ws(",", F.col("event_id"), F.when(k == 1, "\ufffd").otherwise("a"), F.when(k == 0, "more"))), 4)
    where = [f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("out", "state", "aside", "alerts")]
    for _ in range(2):
        stream = follow.follow(spark, path, ["a", "b"], delimited.Dialect(header_rows=0), max_files=2)
        follow.start(stream, *where, available_now=True).awaitTermination()
    return spark.read.json(where[3]).groupBy("alert").agg(F.sum("records").alias("records"))


@query("SELECT p_brand, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")
def recipe_over_files(spark, d):
    """One recipe over a folder for each brand: every input gives its own output, sorted, and a row of the report."""
    part, top = read(spark, d, "part").select("p_partkey", "p_brand", "p_size"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    export.write_delimited(part.withColumn("brand", F.replace("p_brand", F.lit("#"), F.lit(""))), top, split=export.Split("column", column="brand"))
    inputs = [f"{top}/part={r[0]}" for r in part.select(F.replace("p_brand", F.lit("#"), F.lit(""))).distinct().collect()]
    steps = ({"kind": "sort", "keys": [{"column": "p_size", "descending": True}]}, {"kind": "validateProfile", "profile": "p"}, {"kind": "selectColumns", "columns": ["p_brand", "p_partkey"]}, {"kind": "export", "name": "{name}-done"})
    profiles = {"p": diagnose.FileProfile((diagnose.ColumnRule("p_partkey", required=True, kind="number"),))}
    out = f"{top}-out"
    report = recipe.run_recipe(spark, recipe.Recipe("brands", steps), inputs, out, profiles)
    if report.filter("status <> 'ok' OR issues <> 0 OR rows_in <> rows_out").count():
        raise ValueError("a recipe failed")
    return delimited.read_delimited(spark, [r["output"] for r in report.select("output").collect()], width=2)


@query(f"SELECT 'raggedRows' AS issue, '' AS \"column\", count(*) FILTER (n <> 3) AS count, '3' AS detail FROM {_RAGGED}")
def file_issues(spark, d):
    return delimited.file_issues(spark, _ragged(spark, d), delimited.Dialect(delimiter=";", multi_line=True, header_rows=0))


@query("SELECT 'p_name' AS \"column\", p_partkey, p_name AS value FROM part ORDER BY p_partkey LIMIT 30")
def transform_failures(spark, d):
    """Sizes are numbers, names are none: the first of them."""
    return transform.transform_failures(read(spark, d, "part"), transform.Transform("normalizeNumbers"), ["p_size", "p_name"], "p_partkey", 30)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 7")
def group_sample(spark, d):
    return grouping.group_sample(read(spark, d, "events"), GroupBy(("user_id",), (Aggregate("count", name="n"),), order="countDesc"), 7)


_PARTS_BY_SHAPE = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 1 ELSE 40 END AS fields FROM part"


def _inches(spark, d):
    """Records with inch marks in plain cells, quoted delimiters, doubled quotes and empty last fields, a single cell, and many cells."""
    k, name = F.col("p_partkey"), F.col("p_name")
    shapes = (
        F.concat(k, F.lit(',5" '), name, F.lit(',6" hose')),
        F.concat(k, F.lit(',"a, b ""c"", '), name, F.lit('"')),
        F.concat(k, F.lit(',"x ""y""",z,,')),
        k.cast("string"),
        F.concat(k, F.repeat(F.lit(",w"), 39)),
    )
    line = F.coalesce(*[F.when(k % 5 == i, x) for i, x in enumerate(shapes)])
    return _as_lines(spark, read(spark, d, "part").select(line), 4)


@query(f"SELECT CAST(fields AS INTEGER) AS fields, count(*) AS records FROM ({_PARTS_BY_SHAPE}) GROUP BY 1")
def fields_with_quotes_inside(spark, d):
    return delimited.field_counts(spark, _inches(spark, d), delimited.Dialect(header_rows=0))


@query("SELECT CAST(p_partkey AS VARCHAR) AS a, CASE p_partkey % 5 WHEN 0 THEN '5\" ' || p_name WHEN 1 THEN 'a, b \"c\", ' || p_name WHEN 2 THEN 'x \"y\"' WHEN 3 THEN '' ELSE 'w' END AS b, CASE p_partkey % 5 WHEN 0 THEN '6\" hose' WHEN 2 THEN 'z' WHEN 4 THEN 'w' ELSE '' END AS c, 40 AS columns FROM part")
def cells_with_quotes_inside(spark, d):
    """No column of the widest record is lost, and none is invented."""
    found = delimited.read_delimited(spark, _inches(spark, d), delimited.Dialect(header_rows=0))
    return found.select(*[F.col(f"Column {i + 1}").alias(n) for i, n in enumerate("abc")], F.lit(len(found.columns)).alias("columns"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"Column 1\", 'say \"' || p_name || ', please' AS \"Column 2\", 'end' AS \"Column 3\" FROM part")
def backslash_escapes(spark, d):
    line = F.concat("p_partkey", F.lit(',"say \\"'), "p_name", F.lit(', please",end'))
    return delimited.read_delimited(spark, _as_lines(spark, read(spark, d, "part").select(line), 3), delimited.Dialect(escape="\\", header_rows=0))


@query("SELECT 2 AS expected, count(*) AS records, count(*) FILTER (c_custkey % 4 = 0) AS ragged FROM customer")
def ragged_report_of_line_ends(spark, d):
    """Cells with line ends, commas and quotes in them make no ragged records; a third field does."""
    line = F.concat("c_custkey", F.lit(',"two\nlines, and ""quotes"" of '), "c_name", F.lit('"'), F.when(F.col("c_custkey") % 4 == 0, ",3").otherwise(""))
    return delimited.ragged_report(spark, _as_lines(spark, read(spark, d, "customer").select(line), 3), delimited.Dialect(multi_line=True, header_rows=0))


def _marked(spark, d):
    """Customers in folders of three encodings: UTF-16 and UTF-8 with byte order marks, UTF-8 without."""
    customers, top = read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("é€漢")).alias("c_name")), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for i, (encoding, mark) in enumerate((("UTF-16", ""), ("UTF-8", "﻿"), ("UTF-8", ""))):
        own = customers.filter(F.col("c_custkey") % 3 == i).withColumnRenamed("c_custkey", f"{mark}c_custkey").repartition(2)
        own.write.option("header", "true").option("encoding", encoding).csv(f"{top}/{i}")
    return [f"{top}/{i}" for i in range(3)]


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || 'é€漢' AS c_name FROM customer")
def files_of_mixed_encodings(spark, d):
    """Byte order marks tell file by file how to decode, without being asked."""
    return delimited.read_delimited(spark, _marked(spark, d))


@query("SELECT mark, count(*) > 0 AS found FROM (SELECT unnest(['utf-16be', 'utf-8', 'none']) AS mark) GROUP BY 1")
def marks_of_files(spark, d):
    """Which marks there are, by the first bytes of every file."""
    found = delimited.byte_order_marks(spark, _marked(spark, d))
    return found.groupBy(F.coalesce("mark", F.lit("none")).alias("mark")).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("SELECT 'lineEnd' AS what, 'lf' AS a, 'crlf' AS b UNION ALL SELECT 'bom', 'false', 'true' UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (s_suppkey % 2 = 0) AS VARCHAR) FROM supplier")
def reading_differences_of_copies(spark, d):
    """What a rewritten copy of the files differs in: line ends, byte order marks, rows."""
    suppliers, top = read(spark, d, "supplier").select("s_suppkey", "s_name"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    suppliers.repartition(2).select(F.concat_ws(",", "s_suppkey", "s_name")).write.option("lineSep", "\n").text(f"{top}/a")
    copy = suppliers.filter("s_suppkey % 2 = 0").withColumnRenamed("s_suppkey", "﻿s_suppkey").coalesce(1)
    export.write_delimited(copy, f"{top}/b", export.Export(line_end="\r\n"))
    return delimited.reading_differences(spark, f"{top}/a", delimited.Dialect(header_rows=0), delimited.Dialect(header_rows=1), f"{top}/b").filter("what NOT IN ('header')")


@query("SELECT 'crlf' AS kind, count(*) FILTER (s_suppkey % 3 = 0) AS n FROM supplier UNION ALL SELECT 'lf', count(*) FILTER (s_suppkey % 3 > 0) FROM supplier UNION ALL SELECT 'cr', count(*) FILTER (s_suppkey % 3 = 1) FROM supplier")
def line_end_census(spark, d):
    k = F.col("s_suppkey") % 3
    lines = read(spark, d, "supplier").select(F.concat("s_name", F.when(k == 0, "\r").when(k == 1, "\rx").otherwise("")).alias("value"))
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    lines.repartition(3).write.option("lineSep", "\n").text(path)
    return delimited.line_ends(spark, path).agg(*[F.sum(c).alias(c) for c in ("crlf", "lf", "cr")]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in ("crlf", "lf", "cr")])))


@query("SELECT 'with' AS kind, true AS header UNION ALL SELECT 'without', false")
def headers_and_none(spark, d):
    """A first record of names is a header, one with a number is none; one file of each kind at least."""
    customers = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    top = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    export.write_delimited(customers.repartition(3), f"{top}/with", export.Export())
    customers.select(F.concat_ws(",", *customers.columns)).repartition(3).write.text(f"{top}/without")
    found = delimited.has_header(spark, [f"{top}/with", f"{top}/without"])
    return found.groupBy(F.regexp_extract("_file", "/(with|without)/", 1).alias("kind")).agg(F.every("header").alias("header"))


@query("SELECT 'rewritten' AS alert, count(*) AS files FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT 'missing', count(*) FROM nation WHERE n_nationkey % 5 IN (2, 3)")
def follow_file_alerts(spark, d):
    """Customers in a file for each nation; between two triggers some files are rewritten and some go, and the stream tells which."""
    rows = read(spark, d, "customer").join(read(spark, d, "nation").select("n_nationkey"), F.col("n_nationkey") == F.col("c_nationkey"), "right")
    top = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.select("n_nationkey", F.coalesce("c_name", F.lit("none")).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(f"{top}/made")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = lambda k: hadoop.Path(f"{top}/in/{k}.txt")
    store.mkdirs(hadoop.Path(f"{top}/in"))
    for k in range(25):
        store.rename(store.globStatus(hadoop.Path(f"{top}/made/n_nationkey={k}/part-*"))[0].getPath(), place(k))

    def trigger():
        follow.note_listing(spark, f"{top}/in", f"{top}/listings")
        follow.start_alerts(follow.file_alerts(spark, f"{top}/listings"), f"{top}/alerts", f"{top}/state", available_now=True).awaitTermination()

    trigger()
    for k in range(25):
        if k % 5 in (2, 3):
            store.delete(place(k), False)
        elif k % 5 == 1:
            again = store.create(place(k), True)
            again.write(65)
            again.close()
    trigger()
    return spark.read.schema(follow.ALERT).parquet(f"{top}/alerts").groupBy("alert").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT p_brand, CASE WHEN count(*) FILTER (p_size > 49) > 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS rows_in, CASE WHEN count(*) FILTER (p_size > 49) > 0 THEN 0 ELSE count(*) FILTER (p_size > 25) END AS rows_out, count(*) FILTER (p_size > 49) AS issues FROM part GROUP BY 1")
def recipe_dry_run(spark, d):
    """A trial run over a folder for each brand: inputs with sizes that the profile refuses fail, and nothing is written."""
    part, top = read(spark, d, "part").select("p_partkey", "p_brand", "p_size"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    export.write_delimited(part.withColumn("brand", brand), top, split=export.Split("column", column="brand"))
    inputs = [f"{top}/part={r[0]}" for r in part.select(brand).distinct().collect()]
    steps = ({"kind": "validateProfile", "profile": "p", "fail_on_issues": True}, {"kind": "filter", "filter": {"column": "p_size", "operator": "gt", "value": "25"}}, {"kind": "export", "name": "{name}-done"})
    profiles = {"p": diagnose.FileProfile((diagnose.ColumnRule("p_size", kind="number", high=49.0),))}
    report = recipe.run_recipe(spark, recipe.Recipe("sizes", steps), inputs, f"{top}-out", profiles, dry_run=True)
    return report.select(F.replace(F.regexp_extract("input", "part=(.*)$", 1), F.lit("Brand"), F.lit("Brand#")).alias("p_brand"), "status", "rows_in", "rows_out", "issues")


@query("SELECT 'o_custkey' AS \"column\", count(DISTINCT o_custkey) AS exact, 7 AS parts, true AS within FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 7, true FROM orders UNION ALL SELECT 'o_orderkey', count(*), 7, true FROM orders")
def distinct_by_merged_sketches(spark, d):
    """Sketches of seven parts, united, are within their stated error of the exact counts."""
    orders, columns = read(spark, d, "orders"), ["o_custkey", "o_orderpriority", "o_orderkey"]
    parts = sketches.distinct_sketches(orders, columns, F.col("o_orderkey") % 7)
    exact = orders.agg(*[F.countDistinct(c).alias(c) for c in columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns])))
    found = sketches.distinct_estimates(parts).withColumn("parts", F.col("parts").cast("int"))
    return found.join(exact, "column").select("column", "exact", "parts", F.col("exact").between(F.col("low"), F.col("high")).alias("within"))


@query("SELECT 'first' AS state, count(DISTINCT c_custkey) AS n, 4 AS files FROM customer WHERE c_custkey % 5 < 4 UNION ALL SELECT 'more', count(DISTINCT c_custkey), 5 FROM customer")
def sketches_of_added_files(spark, d):
    """A folder that gets one more file: the store reads that file alone. Small counts are exact in a sketch of this size but for its error, which rounding to it hides."""
    customers, top = read(spark, d, "customer"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    reads = []

    def rows(paths):
        reads.append(len(paths))
        return delimited.read_delimited(spark, paths, keep_row=True)

    def state(name, keys):
        for k in keys:
            customers.filter(F.col("c_custkey") % 5 == k).select("c_custkey", "c_name").coalesce(1).write.option("header", "true").csv(f"{top}/{k}")
        stored = sketches.update_store(spark, f"{top}-store", delimited.file_listing(spark, f"{top}/*"), ["c_custkey"], rows)
        found = sketches.distinct_estimates(stored)
        exact = customers.filter(F.col("c_custkey") % 5 <= max(keys)).agg(F.countDistinct("c_custkey").alias("exact"))
        near = F.when(F.col("exact").between(F.col("low"), F.col("high")), F.col("exact")).otherwise(F.col("distinct"))
        return persisted(found.crossJoin(F.broadcast(exact)).select(F.lit(name).alias("state"), near.alias("n"), F.col("parts").cast("int").alias("files")))

    out = state("first", range(4)).unionByName(state("more", [4]))
    if reads != [4, 1]:
        raise ValueError(f"files read: {reads}")
    return out


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS value, count(*) AS count, true AS proven FROM orders GROUP BY 1 ORDER BY count DESC, value LIMIT 20")
def heavy_hitters(spark, d):
    """The days with most orders, by counters in every task and an exact count of what they leave."""
    days = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return sketches.heavy_hitters(days, "day", 20, 4_096).drop("bound")


@query("SELECT l_returnflag, true AS within FROM lineitem GROUP BY 1")
def groupby_distinct_sketch(spark, d):
    lines = read(spark, d, "lineitem")
    near = grouping.group_by(lines, GroupBy(("l_returnflag",), (Aggregate("countDistinct", "l_orderkey", "n"),), approximate=True))
    exact = grouping.group_by(lines, GroupBy(("l_returnflag",), (Aggregate("countDistinct", "l_orderkey", "m"),)))
    return near.join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("n") - F.col("m")) <= sketches.ERROR * F.col("m")).alias("within"))


@query(f"SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS v FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)")
def fill_forward_by_group(spark, d):
    """Groups of a fifth of all rows, and one may hold them all: each spreads over range parts."""
    rows = read(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return repair.repair(rows, repair.Repair("fillForward", ("v",), groups=("event_type",), by_group=True), ["event_id"]).select("event_id", "v")


def _gaps(spark, d):
    """Orders with a fifth of the prices and a third of the priorities blank, before and after fills."""
    k = F.col("o_orderkey")
    before = read(spark, d, "orders").select("o_orderkey", F.when(k % 5 > 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    filled = repair.repair(before, repair.Repair("fillConstant", ("o_orderpriority",), value="none"))
    return before, repair.repair(filled, repair.Repair("fillMode", ("o_orderstatus",)))


@query("SELECT CAST(count(*) FILTER (o_orderkey % 5 = 0) + count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS cells, count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0) AS rows, 2 AS columns FROM orders")
def repair_totals(spark, d):
    return repair.repair_totals(*_gaps(spark, d), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("SELECT 'o_orderpriority' AS \"column\", 'none' AS value, count(*) AS cells FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'o_orderstatus', (SELECT o_orderstatus FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), count(*) FROM orders WHERE o_orderkey % 5 = 0")
def repair_fills(spark, d):
    """Which value the blanks of a column got."""
    return repair.repair_fills(*_gaps(spark, d), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("(SELECT 'o_orderpriority' AS \"column\", o_orderkey AS key, '' AS was, 'none' AS now FROM orders WHERE o_orderkey % 3 = 0 ORDER BY 2 LIMIT 7) UNION ALL (SELECT 'o_orderstatus', o_orderkey, '', (SELECT o_orderstatus FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM orders WHERE o_orderkey % 5 = 0 ORDER BY 2 LIMIT 7)")
def repair_examples(spark, d):
    return repair.repair_examples(*_gaps(spark, d), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 7)


def _refused(act) -> bool:
    try:
        act()
    except (ValueError, FileExistsError):
        return True
    except Exception as e:  # noqa: BLE001  Spark's own refusal to write over a path
        return "ALREADY_EXISTS" in str(e)
    return False


@query("""SELECT 'join output' AS what, count(*) > 10 AS refused FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'pivot columns', count(DISTINCT o_custkey) > 5 FROM orders
UNION ALL SELECT 'pivot without aggregation', max(n) > 1 FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)
UNION ALL SELECT 'lookup with repeated keys', max(n) > 1 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)
UNION ALL SELECT 'writing over files', true UNION ALL SELECT 'recipe without export', true UNION ALL SELECT 'recipe of a newer version', true UNION ALL SELECT 'outputs of one name', true UNION ALL SELECT 'duplicate headers', true""")
def refusals(spark, d):
    """Jobs that would do harm or can't be right are refused, after a look at the tables."""
    orders, lines, path = read(spark, d, "orders"), read(spark, d, "lineitem"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    export.write_delimited(orders.select("o_orderkey"), path)
    on, write = (("o_orderkey", "l_orderkey"),), {"kind": "export", "name": "same"}
    tried = {
        "join output": lambda: joins.join_tables(orders, lines, joins.JoinSpec("inner", on, max_output_rows=10)),
        "pivot columns": lambda: reshape.pivot(orders, reshape.Pivot(("o_orderstatus",), "o_custkey", "o_totalprice", "sum", max_columns=5)),
        "pivot without aggregation": lambda: reshape.pivot(orders, reshape.Pivot(("o_custkey",), "o_orderstatus", "o_totalprice")),
        "lookup with repeated keys": lambda: joins.join_tables(orders, lines, joins.JoinSpec("left", on, lookup=True)),
        "writing over files": lambda: export.write_delimited(orders.select("o_orderkey"), path),
        "recipe without export": lambda: recipe.validate_recipe(recipe.Recipe("r", ({"kind": "filter"},)), [path], {}),
        "recipe of a newer version": lambda: recipe.validate_recipe(recipe.Recipe("r", (write,), 2), [path], {}),
        "outputs of one name": lambda: recipe.validate_recipe(recipe.Recipe("r", (write,)), [f"{path}/a", f"{path}/b"], {}),
        "duplicate headers": lambda: append.append_tables({"a": orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("K "))}, append.Append("nameInsensitive")),
    }
    return spark.createDataFrame([(what, _refused(act)) for what, act in tried.items()], "what string, refused boolean")


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_totalprice > 200000 AND o_orderkey % 2 = 0 GROUP BY 1 ORDER BY count DESC, value LIMIT 3")
def top_values_in_scope(spark, d):
    return profile.top_values(read(spark, d, "orders"), "o_orderpriority", 3, scope=(F.col("o_totalprice") > 200_000) & (F.col("o_orderkey") % 2 == 0))


@query("SELECT 'o_custkey' AS \"column\", count(*) AS rows, count(DISTINCT o_custkey) AS distinct, min(o_custkey) * 1.0::DOUBLE AS low FROM orders WHERE o_orderstatus = 'F'")
def profile_in_scope(spark, d):
    return profile.profile_columns(read(spark, d, "orders"), ["o_custkey"], scope=F.col("o_orderstatus") == "F").select("column", "rows", "distinct", F.col("low").cast("double").alias("low"))


@query("SELECT input, status, mapped, missing, rows FROM (SELECT 'customers' AS input, 'ok' AS status, ['key', 'segment'] AS mapped, [] :: VARCHAR[] AS missing, count(*) AS rows FROM customer UNION ALL SELECT 'suppliers', 'ok', ['key'], ['segment'], count(*) FROM supplier UNION ALL SELECT 'twice', 'failed', [], [], 0)")
def append_report_with_failures(spark, d):
    """An input with a header twice fails, the others go on; the report shows what each column maps to."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("KEY"))
    twice = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias(" Key"))
    return append.append_report({"customers": c, "suppliers": s, "twice": twice}, append.Append("nameInsensitive", continue_on_error=True))


@query("SELECT p_partkey AS key FROM part UNION ALL SELECT s_suppkey FROM supplier")
def append_first_of_duplicate_headers(spark, d):
    twice = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias(" key"))
    return append.append_tables({"parts": twice, "suppliers": read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))}, append.Append(duplicate_headers="first"))


_HEADS = "(SELECT n_nationkey AS i, CASE WHEN n_nationkey % 10 = 0 THEN '' WHEN n_nationkey % 2 = 0 THEN lower(r_name) ELSE r_name END AS h FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH h AS (SELECT i, h, count(*) OVER (PARTITION BY h) AS same, count(*) OVER (PARTITION BY lower(h)) AS alike FROM {_HEADS})
SELECT 'duplicateHeaders' AS issue, count(*) AS count, string_agg(i, ',' ORDER BY i) AS detail FROM h WHERE same > 1 AND h <> ''
UNION ALL SELECT 'duplicateHeadersCaseInsensitive', count(*), string_agg(i, ',' ORDER BY i) FROM h WHERE alike > 1 AND h <> ''
UNION ALL SELECT 'blankHeaders', count(*), string_agg(i, ',' ORDER BY i) FROM h WHERE h = ''""")
def header_issues_of_files(spark, d):
    """Headers as they stand in a file: a nation's column is named by its region, so names repeat, some in another case, and some are blank."""
    k = F.col("n_nationkey")
    named = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = F.when(k % 10 == 0, "").when(k % 2 == 0, F.lower("r_name")).otherwise(F.col("r_name"))
    head = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("i"), cell.alias("h")))), lambda x: x["h"]), ",").alias("value"))
    first = delimited.shapes(spark, _as_lines(spark, head, 1), delimited.Dialect(header_rows=0)).first()["first"]
    return spark.createDataFrame([(i, n, t) for i, _, n, t in diagnose.header_issues(first)], "issue string, count long, detail string")


@query("SELECT count(*) AS customers, count(*) AS differing, count(DISTINCT c_name) AS pseudonyms FROM customer")
def pseudonyms_by_salt(spark, d):
    """Another salt gives every value another pseudonym, the same salt the same; equal values share theirs."""
    a, b = pii.new_salt(), pii.new_salt()
    names = read(spark, d, "customer").select("c_name", *[fn.pseudonym(F.col("c_name"), "secret", s).alias(n) for s, n in ((a, "x"), (a, "y"), (b, "z"))])
    return names.agg(F.count(F.when(F.col("x") == F.col("y"), 1)).alias("customers"), F.count(F.when(F.col("x") != F.col("z"), 1)).alias("differing"), F.countDistinct("x").alias("pseudonyms"))


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 2 = 1")
def follow_new_rows(spark, d):
    """Rows of the batches after the first one: what came since someone looked."""
    ids, top = read(spark, d, "events").select("event_id"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    where = [f"{top}/{kind}" for kind in ("out", "state", "aside", "alerts")]
    for k in (0, 1):
        ids.filter(F.col("event_id") % 2 == k).select(F.col("event_id").cast("string")).coalesce(2).write.mode("append").text(f"{top}/in")
        stream = follow.follow(spark, f"{top}/in", ["id"], delimited.Dialect(header_rows=0))
        follow.start(stream, *where, available_now=True).awaitTermination()
    return follow.new_rows(spark, where[0], 0).select("id")


@query("SELECT status, count(*) AS files FROM (SELECT CASE WHEN n_nationkey = 0 THEN 'removed' WHEN n_nationkey % 4 = 1 THEN 'changed' ELSE 'same' END AS status FROM nation UNION ALL SELECT 'added') GROUP BY 1")
def changed_files(spark, d):
    """Two listings of a folder: one file for each nation, some rewritten, one gone, one new."""
    rows = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    top = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(f"{top}/made")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = lambda k: hadoop.Path(f"{top}/in/{k}.txt")
    store.mkdirs(hadoop.Path(f"{top}/in"))
    for k in range(25):
        store.rename(store.globStatus(hadoop.Path(f"{top}/made/n_nationkey={k}/part-*"))[0].getPath(), place(k))
    before = persisted(delimited.file_listing(spark, f"{top}/in"))
    store.delete(place(0), False)
    for k in [25, *range(1, 25, 4)]:
        again = store.create(place(k), True)
        again.write(65)
        again.close()
    return delimited.changed_files(before, delimited.file_listing(spark, f"{top}/in")).groupBy("status").agg(F.count(F.lit(1)).alias("files"))
