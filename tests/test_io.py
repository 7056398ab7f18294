"""Readers, writers, views, recipes, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tabwright.operators.filters import Condition
from tabwright.operators import diagnose
from tabwright.operators import order as order_module
from tabwright.operators.order import with_position
from tabwright.plans import recipe, views
from tabwright.sources import delimited as src
from tabwright.sources import export
from tabwright.sources.delimited import Dialect
from tabwright.streaming import follow


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def read(spark, path, rows=None, **options):
    df = src.read_delimited(spark, path, Dialect(**options), keep_row=True)
    return df.drop("_row", "_file").columns, [tuple(r)[:-2] for r in df.orderBy("_row").collect()]


def test_dialects(spark, tmp_path):
    p = put(tmp_path / "a.csv", "# metadata line\nExported by tool v3\nid,name\n1,ann\n2,bob\nTOTAL,2")
    assert read(spark, p, skip_first=2, skip_last=1) == (["id", "name"], [("1", "ann"), ("2", "bob")])
    numbered = src.read_delimited(spark, p, Dialect(skip_first=2, skip_last=1), record_numbers=True)
    assert sorted((r["id"], r["_record"]) for r in numbered.collect()) == [("1", 4), ("2", 5)]
    p = put(tmp_path / "b.csv", "Amount,Amount,Name\nNet,Gross,\n1,2,ann")
    assert read(spark, p, header_rows=2) == (["Amount Net", "Amount Gross", "Name"], [("1", "2", "ann")])
    p = put(tmp_path / "c.csv", 'id,note\n# a comment line\n1,"#not a comment"')
    assert read(spark, p, comment="#") == (["id", "note"], [("1", "#not a comment")])
    p = put(tmp_path / "d.csv", 'a,b,c\n1,2\n\n4,"5 ""x"", y",6\n7')
    assert read(spark, p)[1] == [("1", "2", ""), ("4", '5 "x", y', "6"), ("7", "", "")]
    assert tuple(src.ragged_report(spark, p).first()) == (3, 4, 2)
    assert read(spark, p, header_rows=0)[0] == ["Column 1", "Column 2", "Column 3"]
    p = put(tmp_path / "e.csv", "x\n€–“é", "cp1252")
    assert read(spark, p, encoding="windows-1252")[1] == [("€–“é",)]
    p = put(tmp_path / "f.csv", 'a;b\n1;"x\ny"')
    assert read(spark, p, delimiter=";", multi_line=True)[1] == [("1", "x\ny")]


def test_file_jobs(spark, tmp_path):
    for name, text in (("a.csv", "a;b;c\n1;2;3\n"), ("b.csv", 'x,"y;z;w"\n1,2\n'), ("c.csv", "plain\n"), ("d.csv", "1,2\n3,4\n")):
        put(tmp_path / name, text)
    got = {r["_file"].rpartition("/")[2]: r["delimiter"] for r in src.infer_delimiters(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ";", "b.csv": ",", "c.csv": ",", "d.csv": ","}
    heads = {r["_file"].rpartition("/")[2]: r["header"] for r in src.has_header(spark, str(tmp_path)).collect()}
    assert heads["d.csv"] is False and heads["c.csv"] is True
    before = spark.createDataFrame(src.file_listing(spark, str(tmp_path)).collect(), "path string, length long, modificationTime timestamp")
    put(tmp_path / "e.csv", "new\n")
    (tmp_path / "c.csv").unlink()
    put(tmp_path / "d.csv", "1,2\n3,4\n5,6\n")
    changes = {r["path"].rpartition("/")[2]: r["status"] for r in src.changed_files(before, src.file_listing(spark, str(tmp_path))).collect()}
    assert changes == {"a.csv": "same", "b.csv": "same", "c.csv": "removed", "d.csv": "changed", "e.csv": "added"}
    profiles = spark.createDataFrame([("p", "glob", "a*.csv"), ("q", "extension", "csv"), ("r", "directory", "/none")], "profile string, kind string, pattern string")
    matched = {r["path"].rpartition("/")[2]: r["profile"] for r in src.match_profiles(src.file_listing(spark, str(tmp_path)), profiles).collect()}
    assert matched["a.csv"] == "p" and matched["b.csv"] == "q"
    diff = {r["what"] for r in src.reading_differences(spark, str(tmp_path / "a.csv"), Dialect(), Dialect(delimiter=";")).collect()}
    assert diff == {"delimiter", "header", "columns"}


def test_export_round_trip(spark, table, tmp_path):
    t = table('a,b\nx,"q ""y"", z"\n,plain\n" sp ",é')
    for i, options in enumerate((export.Export(), export.Export(quote="always", delimiter=";", line_end="\n"), export.Export(gzip=True), export.Export(encoding="windows-1252"))):
        out = str(tmp_path / f"out{i}")
        export.write_delimited(t.drop("_row"), out, options, order_by=None)
        back = src.read_delimited(spark, out, Dialect(delimiter=options.delimiter, encoding=options.encoding))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.drop("_row").collect()))
    with pytest.raises(ValueError):
        export.write_delimited(t, str(tmp_path / "never"), export.Export(quote="never"))


def test_splits_and_manifest(spark, table, tmp_path):
    t = table("n,region\n" + "\n".join(f"{i},{r}" for i, r in enumerate(["a/b", "a_b", "a_b-2", "", "a/b", "x.", "x"])))
    labels = {r["value"]: r["label"] for r in export.value_labels(t.select(F.col("region").alias("value")).distinct()).collect()}
    assert len(set(labels.values())) == len(labels) and labels[""] == "(blank)" and labels["a/b"] == "a_b"
    parts = export.split_labels(t, export.Split("rows", 3), ["_row"])
    assert [r["part"] for r in parts.orderBy("_row").collect()] == ["001"] * 3 + ["002"] * 3 + ["003"]
    out = str(tmp_path / "split")
    export.write_delimited(t.select("n", "region"), out, export.Export(), export.Split("column", column="region"))
    back = src.read_delimited(spark, [str(p) for p in (tmp_path / "split").glob("part=*")])
    assert back.count() == 7
    listed = export.manifest(spark, out).collect()
    assert sum(r["rows"] for r in listed) == 7 and all(len(r["sha256"]) == 64 for r in listed)
    by_bytes = export.split_labels(t, export.Split("bytes", 20), ["_row"])
    assert by_bytes.count() == 7 and by_bytes.select("part").distinct().count() > 1


def test_renderers(table, rows):
    t = table('name,note\nO\'Neil,"a|b\\c\nd"\n,x').drop("_row")
    assert rows(export.render_rows(t, "sqlValues")) == [("('O''Neil', 'a|b\\c\nd')",), ("(NULL, 'x')",)]
    assert rows(export.render_rows(t, "markdown"))[0] == ("| O'Neil | a\\|b\\\\c<br>d |",)
    assert json.loads(rows(export.render_rows(t, "jsonObject"))[1][0]) == {"name": "", "note": "x"}
    assert json.loads(rows(export.render_rows(t, "jsonArray"))[0][0]) == ["O'Neil", "a|b\\c\nd"]
    counts, sample = export.unencodable(table("a\nx\né\n漢"), "windows-1252", "_row")
    assert rows(counts) == [("a", 1)] and rows(sample, "_row", "value") == [(2, "漢")]


def test_records_with_line_ends(spark, tmp_path):
    """Quoted line ends make no columns and no ragged records; a byte order mark names the encoding."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text('a,b\n1,"x\ny,z"\n2,"p ""q"" r"\n\n3\n4,5,6\n')
    d = Dialect(multi_line=True)
    assert src.read_delimited(spark, str(tmp_path / "a"), d).columns == ["a", "b", "Column 3"]
    assert tuple(src.ragged_report(spark, str(tmp_path / "a"), d).first()) == (2, 5, 2)
    assert [tuple(r)[1:] for r in src.ragged_sample(spark, str(tmp_path / "a"), d).collect()] == [(4, 1, 2), (5, 3, 2)]
    (tmp_path / "b").mkdir()
    for kind in ("utf-16-le", "utf-16-be", "utf-8"):
        (tmp_path / "b" / "x.csv").write_bytes("\ufeffa,b\n1,é漢\n".encode(kind))
        found = src.read_delimited(spark, str(tmp_path / "b"), src.with_bom(spark, str(tmp_path / "b"), Dialect()))
        assert [tuple(r) for r in found.collect()] == [("1", "é漢")]


def test_ordered_parts_have_one_exchange(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    made = []
    keep, order_module.persisted = order_module.persisted, lambda d: made.append(d) or keep(d)
    try:
        parts = order_module.ordered_parts(df, ["k"], parts=5)
    finally:
        order_module.persisted = keep
    assert made[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1
    rows = sorted((r["_part"], r["_place"], r["k"]) for r in parts.collect())
    assert [k for *_, k in rows] == list(range(1000)) and len({p for p, *_ in rows}) > 3 and rows[0][1] == 1


def test_positions_keep_order(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id")).repartition(9)
    got = [r["_pos"] for r in with_position(df, ["k", "id"]).orderBy("k", "id").collect()]
    assert got == list(range(5000))


def test_views(table):
    t = table("a,b,c\n2,x,1\n1,y,2")
    view = views.load_view(json.dumps({"name": "v", "filter": {"column": "gone", "operator": "isEmpty"}, "sort": [{"column": "a"}, {"column": "no"}], "layout": {"hidden": ["c"], "pinned": ["b"]}}))
    shown = views.apply_view(t, view)
    assert shown.missing == ["gone", "no"] and not shown.filter_applied
    assert shown.df.columns == ["b", "_row", "a"] and [r["a"] for r in shown.df.collect()] == ["1", "2"]


RECIPE = {"name": "r", "steps": [{"kind": "filter", "filter": {"column": "n", "operator": "gt", "value": "1"}}, {"kind": "transform", "transform": "uppercase", "columns": ["v"]}, {"kind": "deduplicate", "columns": ["v"]}, {"kind": "selectColumns", "columns": ["v"]}, {"kind": "sort", "keys": [{"column": "v", "descending": True}]}, {"kind": "export", "name": "{name}-out"}]}


def test_recipe(spark, tmp_path):
    for name, text in (("x.csv", "n,v\n1,a\n2,b\n3,B\n4,c\n"), ("y.csv", "v\nb\n")):
        put(tmp_path / name, text)
    own = recipe.load_recipe(json.dumps(RECIPE))
    out = str(tmp_path / "out")
    paths = [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")]
    dry = recipe.run_recipe(spark, own, paths, out, dry_run=True).collect()
    assert [r["status"] for r in dry] == ["ok", "failed"] and dry[0]["rows_out"] == 2 and not (tmp_path / "out").exists()
    report = recipe.run_recipe(spark, own, paths, out).collect()
    assert [(r["status"], r["rows_in"], r["rows_out"]) for r in report] == [("ok", 4, 2), ("failed", 1, 0)]
    assert sorted(r[0] for r in src.read_delimited(spark, out + "/x-out").collect()) == ["B", "C"]
    assert recipe.run_recipe(spark, own, paths, out).first()["status"] == "skipped"
    stopped = recipe.run_recipe(spark, own, paths[::-1], out, continue_on_error=False).collect()
    assert [r["status"] for r in stopped] == ["failed", "skipped"]
    for bad in ({**RECIPE, "version": 2}, {**RECIPE, "steps": []}, {**RECIPE, "steps": RECIPE["steps"][:1]}, {**RECIPE, "steps": [{"kind": "export", "name": "a/b"}]}, {**RECIPE, "steps": [{"kind": "export", "name": "same"}]}):
        with pytest.raises(ValueError):
            recipe.run_recipe(spark, recipe.load_recipe(json.dumps(bad)), paths, out)


def test_recipe_on_many_inputs_is_one_plan(spark, tmp_path):
    """Like inputs share plans; unlike and broken ones run alone; results are those of single runs."""
    rng = random.Random(2)
    paths = []
    for i in range(9):
        rows = [f"{rng.randrange(5)},{rng.choice('abcB')}" for _ in range(rng.choice([0, 1, 5, 20]))]
        paths.append(put(tmp_path / f"f {i}.csv", "n,v\n" + "".join(f"{r}\n" for r in rows)))
    (tmp_path / "folder").mkdir()
    put(tmp_path / "folder" / "a.csv", "n,v\n3,z\n")
    put(tmp_path / "folder" / "b.csv", "n,v\n4,y\n4,Y\n")
    paths += [str(tmp_path / "folder"), put(tmp_path / "wider.csv", "n,v,w\n7,q,1\n"), put(tmp_path / "bad.csv", "v\nb\n")]
    steps = [{"kind": "validateProfile", "profile": "p"}, *RECIPE["steps"]]
    profiles = {"p": diagnose.FileProfile((diagnose.ColumnRule("n", kind="number", high=3.0), diagnose.ColumnRule("v", unique=True)))}
    own = recipe.load_recipe(json.dumps({**RECIPE, "steps": steps}))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("together", "")
    report = recipe.run_recipe(spark, own, paths, str(tmp_path / "out"), profiles).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    alone = recipe.run_recipe(spark, own, paths, str(tmp_path / "alone"), profiles, continue_on_error=False).collect()
    cut = lambda r: (r["input"], r["status"], r["rows_in"], r["rows_out"], r["issues"], r["steps"])
    assert [cut(r) for r in report[:-1]] == [cut(r) for r in alone[:-1]] and report[-1]["status"] == alone[-1]["status"] == "failed"
    assert len(tracker.getJobIdsForGroup("together")) < 60
    for r, a in zip(report[:-1], alone):
        if r["rows_out"]:
            x, y = ([tuple(v) for v in src.read_delimited(spark, k["output"], keep_row=True).orderBy("_row").drop("_row", "_file").collect()] for k in (r, a))
            assert x == y and len(x) == r["rows_out"]
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    again = recipe.run_recipe(spark, own, paths[:4], str(tmp_path / "out"), profiles).collect()
    assert {r["status"] for r in again} == {"skipped"}
    strict = recipe.load_recipe(json.dumps({**RECIPE, "steps": [{**steps[0], "fail_on_issues": True}, *steps[1:]]}))
    failing = recipe.run_recipe(spark, strict, paths[:6], str(tmp_path / "strict"), profiles, dry_run=True).collect()
    assert [r["status"] for r in failing] == ["failed" if r["issues"] else "ok" for r in report[:6]]
    more = recipe.run_recipe(spark, own, paths[:4], str(tmp_path / "out"), profiles, overwrite=True).collect()
    assert [cut(r) for r in more] == [cut(r) for r in report[:4]]


def test_follow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "1.csv", "id,v\n1,a\n2,b\n")
    where = [str(tmp_path / x) for x in ("out", "ck", "bad", "alerts")]

    def go():
        stream = follow.follow(spark, str(folder), ["id", "v"], spec=Condition("v", "notEquals", "b"))
        follow.start(stream, *where, available_now=True).awaitTermination(120)

    go()
    put(folder / "2.csv", "id,v\n3,c\n4\n")
    go()
    rows = spark.read.parquet(where[0])
    assert sorted(r["id"] for r in rows.collect()) == ["1", "3"]
    assert [r["id"] for r in follow.new_rows(spark, where[0], 0).collect()] == ["3"]
    alerts = spark.read.json(where[3]).collect()
    assert [(r["alert"], r["records"]) for r in alerts] == [("widthChanged", 1)]


def counted(spark, path, **options):
    d = Dialect(header_rows=0, **options)
    return {r["fields"]: r["records"] for r in src.field_counts(spark, path, d).collect()}, [tuple(r) for r in src.read_delimited(spark, path, d).collect()]


def test_fields_are_counted_as_the_reader_reads(spark, tmp_path):
    p = put(tmp_path / "inches.csv", '5" pipe,a,6" hose\n')
    assert counted(spark, p) == ({3: 1}, [('5" pipe', "a", '6" hose')])
    p = put(tmp_path / "slash.csv", '1,"x\\"y,z",3\n')
    assert counted(spark, p, escape="\\") == ({3: 1}, [("1", 'x"y,z', "3")])
    p = put(tmp_path / "empty.csv", 'a,b,,\n\n"x,y"\n1,"x ""q"", y",z,\nsolo\n""\n,\n')
    assert counted(spark, p)[0] == {4: 2, 1: 3, 2: 1}
    p = put(tmp_path / "open.csv", 'a,"not closed,b\nc,d\n')
    assert counted(spark, p) == ({2: 2}, [("a", "not closed,b"), ("c", "d")])
    p = put(tmp_path / "lines.csv", '# c\na,"l1\nl2,x",b\n\n\n# d\n1,2\n"p\n"\n')
    assert counted(spark, p, multi_line=True, comment="#") == ({3: 1, 2: 1, 1: 1}, [("a", "l1\nl2,x", "b"), ("1", "2", ""), ("p\n", "", "")])
    p = put(tmp_path / "wide.csv", ",".join("x" * 300) + "\n1,2\n")
    assert counted(spark, p)[0] == {300: 1, 2: 1}
    p = put(tmp_path / "none.csv", "")
    assert counted(spark, p) == ({}, [])


def test_field_counts_equal_a_plain_reader(spark, tmp_path):
    import csv
    import io

    rng = random.Random(5)
    cells = ["", "", "a", "b c", '5" x', '"x,y"', '"q ""z"", "', '""', "é", "1"]
    records = [",".join(rng.choice(cells) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    p = put(tmp_path / "random.csv", "\n".join(records) + "\n")
    want = {}
    for r in csv.reader(io.StringIO("\n".join(records))):
        if r:
            want[len(r)] = want.get(len(r), 0) + 1
    assert counted(spark, p)[0] == want and len(want) > 4


def test_marks_overrule_the_encoding(spark, tmp_path):
    folder = tmp_path / "m, n"
    folder.mkdir()
    for i, (kind, mark) in enumerate((("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-8", b"\xef\xbb\xbf"), ("utf-8", b""))):
        (folder / f"{i} x.csv").write_bytes(mark + f"a,b\n{i},é漢\n".encode(kind))
    (folder / "empty.csv").write_bytes(b"")
    marks = {r["_file"].rpartition("/")[2]: r["mark"] for r in src.byte_order_marks(spark, str(folder)).collect()}
    assert marks == {"0 x.csv": "utf-16le", "1 x.csv": "utf-16be", "2 x.csv": "utf-8", "3 x.csv": None}
    got = src.read_delimited(spark, str(folder), keep_row=True)
    assert got.columns[:2] == ["a", "b"] and [tuple(r)[:2] for r in got.orderBy("_row").collect()] == [(str(i), "é漢") for i in range(4)]
    with pytest.raises(ValueError):
        src.with_bom(spark, str(folder), Dialect())
    assert src.with_bom(spark, str(folder / "0 x.csv"), Dialect()).encoding == "utf-16le"
    assert src.read_delimited(spark, str(folder / "2 x.csv"), Dialect(encoding="windows-1252")).collect()[0][1] == "é漢"
    assert src.read_delimited(spark, str(folder / "3 x.csv"), Dialect(encoding="windows-1252", marks=False)).collect()[0][1] == "Ã©æ¼¢"


def test_first_bytes_leave_the_rest_alone(spark, tmp_path):
    """Whatever follows isn't read: here bytes that can't be unpacked."""
    import gzip

    packed = gzip.compress(b"\xef\xbb\xbf" + random.Random(6).randbytes(1 << 20))
    (tmp_path / "damaged.csv.gz").write_bytes(packed[:300_000] + b"\xff" * 300_000)
    (tmp_path / "empty.csv.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "short.csv").write_bytes(b"a")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "plain.csv").write_bytes(b"\xff\xfeabc")
    (tmp_path / "_hidden.csv").write_bytes(b"xyz")
    got = {r["_file"].rpartition("/")[2]: bytes(r["head"]) for r in src.first_bytes(spark, str(tmp_path)).collect()}
    assert got == {"damaged.csv.gz": b"\xef\xbb\xbf", "short.csv": b"a", "plain.csv": b"\xff\xfea"}


@pytest.mark.parametrize("blank", [False, True])
def test_one_pass_over_records_with_line_ends(spark, tmp_path, blank):
    """One header record is left out by the reader itself, with the results of the way for any number of records; also if the first file has no record."""
    if blank:
        put(tmp_path / "0.csv", "\n\n")
    put(tmp_path / "1 x.csv", '# c\n\n"a\nb",,c\n1,"x\n\ny",2\n\n"",,\n3\n')
    put(tmp_path / "2.csv", "other,head\n4,5,6\n7,8,9\n")
    put(tmp_path / "3.csv", "only,a,header\n")
    put(tmp_path / "4.csv", "")
    for last in (0, 1, 2):
        d = Dialect(multi_line=True, comment="#", skip_last=last)
        got, want = src.read_delimited(spark, str(tmp_path), d, width=3), src.read_delimited(spark, str(tmp_path), d, width=3, record_numbers=True).drop("_record")
        assert got.columns == want.columns == ["a\nb", "Column 2", "c"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == (5, 3, 1)[last]
        if not last and not blank:
            assert got._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1


def test_line_ends(spark, tmp_path):
    texts = {"a": b"a,b\r\n4,x\ry\n1,2\r", "b": b"a\r\n", "c": b"a\nb", "d": b"\xef\xbb\xbfa\r\nb\r\n", "e": b"\xef\xbb\xbfa\r\nb", "f": "a\r\nb\n".encode("utf-16-le"), "g": "\ufeffa\r\nb\r\n".encode("utf-16-be")}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = {r["_file"].rpartition("/")[2]: (r["crlf"], r["lf"], r["cr"]) for r in src.line_ends(spark, str(tmp_path)).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 0), "c": (0, 1, 0), "d": (2, 0, 0), "e": (1, 0, 0), "f": (1, 1, 0), "g": (2, 0, 0)}
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "x").write_bytes(b"a,b\n1,2\n")
    differing = {r["what"]: (r["a"], r["b"]) for r in src.reading_differences(spark, str(tmp_path / "only"), Dialect(), Dialect(), str(tmp_path / "d")).collect()}
    assert differing["bom"] == ("false", "true") and differing["lineEnd"] == ("lf", "crlf")


def test_alerts_of_rewritten_and_missing_files(spark, tmp_path):
    import os
    import time

    folder, where = tmp_path / "in", [str(tmp_path / k) for k in ("listings", "alerts", "state")]
    folder.mkdir()
    for name in ("same", "grown", "touched", "gone", "back"):
        (folder / f"{name} 1.csv").write_text("a,b\n1,2\n")

    def look():
        time.sleep(0.3)
        follow.note_listing(spark, str(folder), where[0])
        follow.start_alerts(follow.file_alerts(spark, where[0]), where[1], where[2], available_now=True).awaitTermination(120)
        found = spark.read.schema(follow.ALERT).parquet(where[1]).collect() if os.path.exists(where[1]) else []
        return sorted((r["file"].rpartition("/")[2].split(" ")[0].split("%")[0], r["alert"], r["length_before"], r["length_now"]) for r in found)

    assert look() == []
    (folder / "grown 1.csv").write_text("a,b\n1,2\n3,4\n")
    os.utime(folder / "touched 1.csv", (1, 1))
    (folder / "gone 1.csv").unlink()
    (folder / "back 1.csv").unlink()
    (folder / "new 1.csv").write_text("a\n")
    want = [("back", "missing", 8, None), ("gone", "missing", 8, None), ("grown", "rewritten", 8, 12), ("touched", "rewritten", 8, 8)]
    assert look() == want
    (folder / "back 1.csv").write_text("a,b\n9,9\n9,9\n")
    assert look() == want
    for f in folder.iterdir():
        f.unlink()
    assert look() == sorted([*want, ("back", "missing", 12, None), *((n, "missing", k, None) for n, k in (("grown", 12), ("new", 2), ("same", 8), ("touched", 8)))])


def test_watch_notes_listings(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("a\n")
    query = follow.watch(spark, str(tmp_path / "in"), str(tmp_path / "listings"), str(tmp_path / "state"), every="1 second")
    try:
        for _ in range(60):
            if len(list((tmp_path / "listings").glob("snapshot=*"))) > 1:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert spark.read.schema(follow.SNAPSHOT).parquet(str(tmp_path / "listings" / "snapshot=0")).count() == 2
