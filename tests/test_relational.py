"""Filters, sorts, joins, groups, append, dedup, reshape on small tables with expected rows."""
# The small tables and results of FIXTURES.md, each of which pins a rule that has to be met exactly.

# Small tables whose expected values pin a surveyed rule (FIXTURES.md names the rules). Other data are the tests' own.


import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabwright.operators import append, dedup, filters, find, grouping, joins, project, quantile, repair, reshape, sketches, sort
from tabwright.operators.filters import Condition, Group
from tabwright.operators.grouping import Aggregate, GroupBy
from tabwright.sources import delimited

SALES = "dept,amount,who\nsales,10,ann\nsales,20,bob\nops,5,cid\nsales,,dee\nops,abc,eve"


def test_group_by_all_aggregates(table, rows):
    spec = GroupBy(("dept",), tuple(Aggregate(f, c) for f, c in (("count", None), ("countNonblank", "amount"), ("sum", "amount"), ("mean", "amount"), ("min", "amount"), ("max", "amount"), ("first", "who"), ("last", "who"))), order_by=("_row",))
    assert rows(grouping.group_by(table(SALES), spec)) == [("ops", 2, 2, 5.0, 5.0, 5.0, 5.0, "cid", "eve"), ("sales", 3, 2, 30.0, 15.0, 10.0, 20.0, "ann", "dee")]
    assert grouping.group_report(table(SALES), spec).first()["invalid_numeric"] == 4


def test_group_by_medians_raw_keys_and_distinct(table, rows):
    assert rows(grouping.group_by(table("g,n\na,1\na,3\na,2\nb,10\nb,20"), GroupBy(("g",), (Aggregate("median", "n"),)))) == [("a", 2.0), ("b", 15.0)]
    assert grouping.group_by(table("g,n\nEast,1\nEast ,2"), GroupBy(("g",), (Aggregate("count"),))).count() == 2
    out = grouping.group_by(table("g,v\na,X\na,x\na, x \nb,y"), GroupBy(("g",), (Aggregate("countDistinct", "v", "d"),)))
    assert rows(out, "d") == [(2,), (1,)]


def test_group_by_blank_keys_and_normalised(table, rows):
    t = table("g,n\na,1\n,2\na,3")
    assert grouping.group_by(t, GroupBy(("g",), (Aggregate("count"),))).count() == 2
    spec = GroupBy(("g",), (Aggregate("count"),), blank_keys="exclude")
    assert grouping.group_by(t, spec).count() == 1
    assert grouping.group_report(t, spec).first()["blank_key_rows"] == 1
    out = grouping.group_by(table("g\nEast \neast\nWest"), GroupBy(("g",), (Aggregate("count", name="n"),), normalise=True, order="firstSeen", order_by=("_row",)))
    assert rows(out) == [("East ", 2), ("West", 1)]


def test_group_by_concat(table, rows):
    t = table("g,v\na,x\na,y\na,x")
    spec = GroupBy(("g",), (Aggregate("concat", "v", "c", " | "), Aggregate("concatDistinct", "v", "d", " | "), Aggregate("concat", "v", "s", " | ", 4)), order_by=("_row",))
    assert rows(grouping.group_by(t, spec)) == [("a", "x | y | x", "x | y", "x | …")]
    wide = grouping.group_by(table("g,v\na,éé\na,é"), GroupBy(("g",), (Aggregate("concat", "v", "c", "", 3),), order_by=("_row",)))
    assert rows(wide, "c") == [("é…",)]


def test_group_by_rejects(table):
    with pytest.raises(ValueError):
        grouping.group_by(table(SALES), GroupBy(("gone",), (Aggregate("count"),)))
    with pytest.raises(ValueError):
        grouping.group_by(table(SALES), GroupBy(("dept",), (Aggregate("first", "who"),)))


LEFT, RIGHT = "id,name\n1,alpha\n2,beta\n3,gamma", "id,score\n2,20\n2,21\n4,40"


@pytest.mark.parametrize(("kind", "n"), [("inner", 2), ("left", 4), ("right", 3), ("full", 5), ("leftAnti", 2), ("rightAnti", 1)])
def test_join_kinds(table, kind, n):
    left, right = table(LEFT).drop("_row"), table(RIGHT).drop("_row")
    out = joins.join_tables(left, right, joins.JoinSpec((("id", "id"),), kind))
    assert out.columns == ["id", "name", "id (right)", "score"]
    assert out.count() == n
    assert joins.join_preview(left, right, joins.JoinSpec((("id", "id"),), kind)).first()["output_rows"] == n


def test_join_blanks_equivalence_lookup(table):
    left, right = table("k,l\n,1\na,2").drop("_row"), table("k,r\n,9\na,8").drop("_row")
    assert joins.join_tables(left, right, joins.JoinSpec((("k", "k"),))).count() == 1
    assert joins.join_tables(left, right, joins.JoinSpec((("k", "k"),), blank_equal=True)).count() == 2
    a, b = table("k,l\n1.0,x\n2024-01-02,y").drop("_row"), table("k,r\n1,10\n01/02/2024,20").drop("_row")
    assert joins.join_tables(a, b, joins.JoinSpec((("k", "k"),), numeric_equal=True, date_equal=True)).count() == 2
    with pytest.raises(ValueError, match="more than once"):
        joins.join_tables(table(LEFT), table(RIGHT), joins.JoinSpec((("id", "id"),), lookup=True))
    with pytest.raises(ValueError, match="limit"):
        joins.join_tables(table(LEFT), table(RIGHT), joins.JoinSpec((("id", "id"),), max_output_rows=1))
    preview = joins.join_preview(table(LEFT), table(RIGHT), joins.JoinSpec((("id", "id"),))).first()
    assert (preview["matched_pairs"], preview["left_unmatched"], preview["right_unmatched"], preview["right_duplicate_keys"]) == (2, 2, 1, 1)


def test_anti_and_inner_cover_the_left(table):
    left, right = table("k\n1\n2\n2\n3\n"), table("k\n2\n5")
    semi = {r["_row"] for r in joins.join_tables(left, right, joins.JoinSpec((("k", "k"),))).collect()}
    anti = {r["_row"] for r in joins.join_tables(left, right, joins.JoinSpec((("k", "k"),), "leftAnti")).collect()}
    assert semi | anti == set(range(left.count())) and not semi & anti


def test_append(table, rows):
    a, b = table("id,name\n1,alpha\n2,beta").drop("_row"), table("name,id\ncharlie,3").drop("_row")
    assert rows(append.append_tables({"a": a, "b": b}, append.Append()))[2] == ("3", "charlie")
    x, y = table("id,extra\n1,x").drop("_row"), table("id,other\n1,y").drop("_row")
    assert rows(append.append_tables({"x": x, "y": y}, append.Append())) == [("1", "x", None), ("1", None, "y")]
    assert append.append_tables({"x": x, "y": y}, append.Append(schema="intersection")).columns == ["id"]
    p = append.append_tables({"p": table("x,y\n1,2").drop("_row"), "q": table("p,q,r\n3,4,5").drop("_row")}, append.Append("position"))
    assert p.columns == ["x", "y", "Column 3"]
    with pytest.raises(ValueError, match="more than once"):
        append.append_plan({"a": ["x", "x "], "b": ["x"]}, append.Append())
    plan = append.append_plan({"a": ["x", "x "], "b": ["x"]}, append.Append(continue_on_error=True))
    assert list(plan.failed) == ["a"]
    report = append.append_report({"x": x, "y": y}, append.Append())
    assert rows(report, "input", "mapped", "missing", "rows") == [("x", ["id", "extra"], ["other"], 1), ("y", ["id", "other"], ["extra"], 1)]


def test_dedup(table, rows):
    t = table("a,b,v\nx,1,p\nx,2,q\nx,1,r\ny,1,s\nx,1,t")
    assert rows(dedup.duplicate_report(t, dedup.Dedup(("a", "b")), ["_row"])) == [(5, 1, 2, 3)]
    assert sorted(r["_row"] for r in dedup.duplicate_rows(t, dedup.Dedup(("a", "b")), ["_row"]).collect()) == [0, 2, 4]
    k = table("k\nAda\n ada \na  da\na da\nada")
    assert dedup.duplicate_report(k, dedup.Dedup(("k",), trim=True, case_insensitive=True), ["_row"]).first()["excess"] == 2
    assert dedup.duplicate_report(k, dedup.Dedup(("k",), collapse_whitespace=True, case_insensitive=True), ["_row"]).first()["groups"] == 2
    b = table("k,v\n,1\n,2\na,3\na,4")
    assert rows(dedup.duplicate_report(b, dedup.Dedup(("k",)), ["_row"]))[0][:2] == (4, 2)
    assert rows(dedup.duplicate_report(b, dedup.Dedup(("k",), blank_keys_equal=False), ["_row"]))[0][:2] == (4, 1)
    assert rows(dedup.duplicate_report(b, dedup.Dedup(("k",), exclude_blank_keys=True), ["_row"]))[0][0] == 2
    sample = dedup.duplicate_groups(t, dedup.Dedup(("a", "b")), ["_row"]).collect()
    assert [(r["size"], [x["_row"] for x in r["rows"]]) for r in sample] == [(3, [0, 2, 4])]


@pytest.mark.parametrize(("keep", "left"), [("first", [0, 1]), ("last", [1, 3]), ("mostComplete", [1, 2])])
def test_dedup_keepers(table, keep, left):
    t = table("k,a,b\nx,1,\ny,9,9\nx,1,2\nx,3,4")
    assert sorted(r["_row"] for r in dedup.deduplicate(t, dedup.Dedup(("k",)), ["_row"], keep).collect()) == left


def test_reshape(table, rows):
    t = table("name,jan,feb\nann,1,2\nbob,3,")
    assert reshape.unpivot(t, ["name"], ["jan", "feb"]).count() == 4
    long = reshape.unpivot(t, ["name"], ["jan", "feb"], omit_blanks=True, source_row=["_row"])
    assert sorted((r["name"], r["attribute"], r["value"], r["source_row"]) for r in long.collect())[-1] == ("bob", "jan", "3", 2) and long.count() == 3
    p = table("k,h,v\na,x,1\na,x,3\na,y,10\nb,x,5")
    assert rows(reshape.pivot(p, reshape.Pivot(("k",), "h", "v", "sum")).orderBy("k")) == [("a", 4.0, 10.0), ("b", 5.0, None)]
    assert rows(reshape.pivot(p, reshape.Pivot(("k",), "h", "v", "count")).orderBy("k")) == [("a", 2, 1), ("b", 1, 0)]
    for how in ("mean", "median"):
        assert rows(reshape.pivot(p, reshape.Pivot(("k",), "h", "v", how)).orderBy("k"))[0] == ("a", 2.0, 10.0)
    with pytest.raises(ValueError, match="more than one value"):
        reshape.pivot(table("k,h,v\na,x,1\na,x,2"), reshape.Pivot(("k",), "h", "v"))
    exact = reshape.pivot(table("k,h,v\na,x,1\n a ,x,2\na, x ,3"), reshape.Pivot(("k",), "h", "v", order_by=("_row",)))
    assert exact.count() == 2 and " x " in exact.columns
    tr = reshape.transpose(table("a,b,c\n1,2,3\n4,5,6"), ["_row"])
    assert tr.columns == ["Column", "Row 1", "Row 2"] and rows(tr)[1] == ("a", "1", "4")
    with pytest.raises(ValueError):
        reshape.transpose(table("a\n1\n2\n3"), ["_row"], max_columns=2)


def test_filters(table, rows):
    t = table("name,qty\na,3\nb,7\nc,12")
    nested = Group((Condition("qty", "gt", "5"), Group((Condition("name", "equals", "a"), Condition("qty", "lt", "10")), "or")))
    assert rows(filters.filter_rows(t, nested), "_row") == [(1,)]
    assert rows(filters.filter_rows(table("name,qty\na,3\nb,n/a\nc,10"), Condition("qty", "gt", "5")), "_row") == [(2,)]
    assert filters.filter_rows(t, Group((), "or")).count() == 3
    blanks = table("a\nx\n\n \n")
    assert filters.filter_rows(table('a,b\n,1\nx,2'), Condition("a", "notEquals", "x")).count() == 1
    assert filters.filter_rows(blanks, Condition("a", "isEmpty")).count() == blanks.count() - 1
    assert filters.filter_rows(table("a,b\nAbc,1\nxbc,1"), Condition("a", "regex", "^a.*c$")).count() == 1
    with pytest.raises(ValueError):
        filters.filter_rows(t, Condition("qty", "gt", "five"))
    with pytest.raises(ValueError):
        filters.filter_rows(t, Condition("qty", "regex", "("))
    assert filters.from_json({"op": "or", "conditions": [{"column": "a", "operator": "equals", "value": "x"}]}) == Group((Condition("a", "equals", "x"),), "or")


def test_filter_reaches_the_scan(spark):
    df = filters.filter_rows(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), Condition("l_quantity", "gt", "5")).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,5.0)" in plan and "l_tax" not in plan.split("ReadSchema")[1]


def test_find_replace_sort_project(table, rows):
    t = table("a,b\nfoo,x\nbar,Foo\nfoofoo,y")
    assert rows(find.find(t, find.Find("foo"), "_row"), "_row", "column") == [(0, "a"), (1, "b"), (2, "a")]
    assert find.find(t, find.Find("foo", whole_cell=True, case_sensitive=True), "_row").count() == 1
    out = find.replace_all(t, find.Find("o+", regex=True), "$0$0").orderBy("_row")
    assert rows(out, "a", "b", "_changed") == [("foooo", "x", 1), ("bar", "Foooo", 1), ("foooofoooo", "y", 1)]
    literal = find.replace_all(t, find.Find("x"), "$1\\")
    assert rows(literal.orderBy("_row"), "b")[0] == ("$1\\",)
    s = table("v\n10\n9\nb\na\n1e1")
    assert rows(sort.sort_rows(s, [sort.SortKey("v")], ["_row"]), "v") == [("9",), ("10",), ("1e1",), ("a",), ("b",)]
    assert rows(sort.sort_rows(s, [sort.SortKey("v", True)], ["_row"]), "v")[0] == ("b",)
    assert project.keep_columns(t, ["b", "a"]).columns == ["a", "b"]
    with pytest.raises(ValueError):
        project.delete_columns(t, t.columns)
    assert project.insert_column(t, 1, "a").columns == ["_row", "a (2)", "a", "b"]
    patched = project.patch_cells(t, t.limit(0).select("_row", F.lit("a").alias("column"), F.lit("z").alias("value")).union(t.filter("_row = 1").select("_row", F.lit("a"), F.lit("z"))), "_row")
    assert rows(patched.orderBy("_row"), "a") == [("foo",), ("z",), ("foofoo",)]
    assert rows(project.rows_from(t, ["_row"], 1).orderBy("_row"), "_row") == [(1,), (2,)]
    assert project.lay_out(t, project.Layout(("a",), ("b",), ("gone",))).missing == ["gone"]


@pytest.mark.parametrize("most", [0, 20, 200, quantile.MOST_VALUES])
def test_group_quantiles(spark, most):
    """Against the plain rule: null groups, single values, ties over parts, nulls left out."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(40)) if rng.random() > 0.1 else None) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.755, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(shares))] for r in quantile.group_quantiles(df, {"g": F.col("g")}, F.col("x"), shares, most).collect()}
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    for own in by.values():
        own.sort()
    plain = lambda v, s: v[int(s * (len(v) - 1))] + (v[min(int(s * (len(v) - 1)) + 1, len(v) - 1)] - v[int(s * (len(v) - 1))]) * (s * (len(v) - 1) % 1)
    assert set(got) == set(by) and all(abs(a - plain(by[g], s)) < 1e-9 for g in by for a, s in zip(got[g], shares))
    whole = quantile.group_quantiles(df, {}, F.col("x"), [0.5], most).collect()
    assert len(whole) == 1 and quantile.group_quantiles(df.limit(0), {}, F.col("x"), [0.5], most).count() <= 1


@pytest.mark.parametrize("most", [0, 100, quantile.MOST_VALUES])
def test_groups_of_quantiles_have_any_name(spark, most):
    """Names that the steps use, too; brackets, ranks and the plain aggregate give the same."""
    names = ["i", "n", "low", "_x", "_n", "_lo0", "_of"]
    df = spark.range(4_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 4_001).cast("double").alias("x"))
    got = quantile.group_quantiles(df, {n: F.col("g") for n in names}, F.col("x"), [0.25, 0.5], most)
    assert got.columns == [*names, "q0", "q1"]
    by = {g: sorted(float(i * 37 % 4_001) for i in range(g, 4_000, 2)) for g in (0, 1)}
    at = lambda v, s: v[int(s * 1_999)] + (v[int(s * 1_999) + 1] - v[int(s * 1_999)]) * (s * 1_999 % 1)
    assert sorted(map(tuple, got.collect())) == [(*[g] * len(names), at(by[g], 0.25), at(by[g], 0.5)) for g in (0, 1)]


def test_brackets_narrow_and_prove(spark):
    """One value alone, few values with many ties, and many values; also what a sketch can't place is found."""
    n = 60_000
    x = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, F.col("id") * 7919 % 100_003).otherwise(F.col("id") % 5)
    df = spark.range(n).select((F.col("id") % 3).alias("g"), x.cast("double").alias("x")).repartition(5)
    shares = [0.0, 0.013, 0.5, 0.9, 1.0]
    by = {g: sorted([7.0 if g == 0 else float(i * 7919 % 100_003) if g == 1 else float(i % 5) for i in range(n) if i % 3 == g]) for g in range(3)}
    at = lambda v, s: v[int(s * (len(v) - 1))] + (v[min(int(s * (len(v) - 1)) + 1, len(v) - 1)] - v[int(s * (len(v) - 1))]) * (s * (len(v) - 1) % 1)
    cells = quantile.persisted(df.select("g", F.col("x").alias("_x")))
    for most in (40, 5_000):
        found = quantile._by_brackets(cells, ["g"], shares, most)
        assert found is not None
        got = {r["g"]: [r[f"q{i}"] for i in range(len(shares))] for r in found.collect()}
        assert all(abs(got[g][i] - at(by[g], s)) < 1e-9 for g in by for i, s in enumerate(shares))
    # no number: no proof, and ranks decide
    odd = df.withColumn("x", F.when(F.col("x") < 2, float("nan")).otherwise(F.col("x")))
    assert quantile._by_brackets(quantile.persisted(odd.select("g", F.col("x").alias("_x"))), ["g"], [1.0], 100) is None
    assert {r["g"]: str(r["q0"]) for r in quantile.group_quantiles(odd, {"g": F.col("g")}, F.col("x"), [1.0], 100).collect()}[2] == "nan"


def test_sketches_of_parts_unite(spark):
    df = spark.range(40_000).select((F.col("id") % 9).alias("part"), F.when(F.col("id") % 10 > 0, F.col("id") % 12_345).cast("string").alias("a"), F.lit(" x ").alias("b"))
    parts = sketches.distinct_sketches(df, ["a", "b"], F.col("part"))
    got = {r["column"]: r for r in sketches.distinct_estimates(parts).collect()}
    exact = df.agg(F.countDistinct("a")).first()[0]
    assert got["a"]["low"] <= exact <= got["a"]["high"] and (got["a"]["parts"], got["a"]["rows"], got["a"]["blanks"]) == (9, 40_000, 4_000)
    assert (got["b"]["distinct"], got["b"]["low"]) == (1, 0)
    assert sketches.distinct_sketches(df.limit(0), ["a"], F.col("part")).count() == 0
    assert [r["distinct"] for r in sketches.distinct_estimates(sketches.distinct_sketches(df.withColumn("a", F.lit(" ")), ["a"], F.lit(None).cast("string"))).collect()] == [0]


def test_sketch_store_reads_what_is_new(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store, reads = str(tmp_path / "store"), []

    def rows(paths):
        reads.append(sorted(p.rpartition("/")[2] for p in paths))
        return delimited.read_delimited(spark, paths, keep_row=True)

    def update():
        stored = sketches.update_store(spark, store, delimited.file_listing(spark, str(tmp_path / "in")), ["a"], rows)
        return {r["column"]: (r["parts"], r["rows"], r["distinct"]) for r in sketches.distinct_estimates(stored).collect()}

    put = lambda name, values: (tmp_path / "in" / name).write_text("a\n" + "".join(f"{v}\n" for v in values))
    assert update() == {}
    put("x y.csv", [1, 2, 3])
    put("b.csv", [3, 4])
    assert update() == {"a": (2, 5, 4)}
    put("c.csv", [9])
    assert update() == {"a": (3, 6, 5)}
    put("b.csv", [1, 1, 1, 1])
    assert update() == {"a": (3, 8, 4)}
    (tmp_path / "in" / "x y.csv").unlink()
    assert update() == {"a": (2, 5, 2)}
    assert reads == [["b.csv", "x y.csv"], ["c.csv"], ["b.csv"]]


def test_heavy_hitters(spark):
    rng = random.Random(6)
    values = [f"v{min(int(rng.paretovariate(0.7)), 10**6)}" for _ in range(20_000)] + ["", None, " v1 "] * 3
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    full = Counter(v.strip() for v in values if v and v.strip())
    want = sorted(full.items(), key=lambda x: (-x[1], x[0]))
    for k, counters in ((5, 300), (20, 100_000), (100, 100)):
        got = sketches.heavy_hitters(df, "v", k, counters).collect()
        proven, bound = got[0]["proven"], got[0]["bound"]
        assert all(full[r["value"]] == r["count"] for r in got)
        if proven:
            assert [(r["value"], r["count"]) for r in got] == want[:k]
        else:  # nothing larger than the bound is left out
            assert {v for v, n in want[:k] if n > bound} <= {r["value"] for r in got}
        assert proven == (counters != 100)
    few = df.filter("v = 'v1'")
    assert [tuple(r)[:3] for r in sketches.heavy_hitters(few, "v", 3, 10).collect()] == [("v1", full["v1"] - 3, True)]
    assert sketches.heavy_hitters(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        sketches.heavy_hitters(df, "v", 10, 5)


def test_fill_by_group_spreads_a_group(spark):
    """A group of all rows, and groups of many runs, forward and backward, with blanks at both ends."""
    rng = random.Random(8)
    rows = [(i, rng.choice("aaaaaaab"), rng.choice(["", "", None, str(i)])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "i long, g string, v string").repartition(5)
    for kind in ("fillForward", "fillBackward"):
        for groups in (("g",), ()):
            spec = repair.Repair(kind, ("v",), groups=groups, by_group=bool(groups))
            got = {r["i"]: r["v"] for r in repair.repair(df, spec, ["i"]).collect()}
            last, want = {}, {}
            for i, g, v in rows if kind == "fillForward" else rows[::-1]:
                key = g if groups else ""
                last[key] = v or last.get(key)
                want[i] = v if v else last[key] or v
            assert got == want
    # no window holds a group: rows meet in range parts only
    made = []
    keep, repair.ordered_parts = repair.ordered_parts, lambda *a, **k: made.append(keep(*a, **k)) or made[-1]
    try:
        repair.repair(df.withColumn("g", F.lit("one")), repair.Repair("fillForward", ("v",), groups=("g",), by_group=True), ["i"])
    finally:
        repair.ordered_parts = keep
    sizes = [r["n"] for r in made[0].groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 2 and max(sizes) < 2_000
