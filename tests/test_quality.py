"""Profiles, diagnostics, rules, outliers, repair, comparison, clusters, personal data, scalars."""
# The small tables and results of FIXTURES.md, each of which pins a rule that has to be met exactly.

# Small tables whose expected values pin a surveyed rule (FIXTURES.md names the rules). Other data are the tests' own.


import hashlib
import hmac
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from tabwright.functions import cells
from tabwright.functions import pairs
from tabwright.functions import text as fn
from tabwright.operators import cluster, compare, diagnose, graph, order, outlier, pii, profile, quantile, repair, rules, semantic, transform


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_cell_classes(spark):
    got = values(spark, cells.class_of, None, " ", " 3.5 ", "nan", "inf", "1e400", "1d", "0", "yes", "T", "2024-03-01", "1.2.3", "2024-13-40", "2024-02-30", "31/01/2024", "2024-01-02T03:04:05+02:00", "x", " ")
    assert got == ["blank", "blank", "number", "text", "text", "text", "text", "number", "bool", "bool", "date", "text", "text", "text", "date", "date", "text", "blank"]
    days = values(spark, lambda c: F.date_format(cells.date(c), "yyyy-MM-dd HH:mm"), "1/2/2024", "31/01/2024", "2024-01-02T03:04:05+02:00", "2024/1/2 3:4:5")
    assert days == ["2024-01-02 00:00", "2024-01-31 00:00", "2024-01-02 01:04", "2024-01-02 03:04"]


def test_profile(table, rows):
    t = table("fruit,n\napple,1\nbanana,2\napple,3\ncherry,4\napple,5\nbanana,6\n,7")
    p = profile.profile_columns(t, ["fruit"]).first()
    assert (p["rows"], p["blanks"], p["distinct"], p["kind"], p["shortest"], p["longest"]) == (7, 1, 3, "text", 5, 6)
    assert rows(profile.top_values(t, "fruit", 3)) == [("apple", 3), ("banana", 2), ("cherry", 1)]
    q = profile.profile_columns(table("v\n1\n2\n3\n4\n5\n6\n7\n8"), ["v"]).first()
    assert (q["q1"], q["median"], q["q3"], q["kind"]) == (2.75, 4.5, 6.25, "number")
    d = profile.profile_columns(table("when\n2024-03-01\n2023-12-25\n2024-01-15\n12/25/2023"), ["when"], ["_row"]).first()
    assert (d["earliest"], d["latest"], d["kind"]) == ("2023-12-25", "2024-03-01", "date")


def test_profile_of_large_columns(spark, monkeypatch):
    """Columns with more values than one aggregate may hold, side by side, one of them without any."""
    monkeypatch.setattr(profile, "group_quantiles", partial(quantile.group_quantiles, most_values=50))
    n = 1_003
    df = spark.range(n).select(F.when(F.col("id") > 0, F.col("id") * 7 % n).alias("a"), (F.col("id") % 5).cast("string").alias("b"), F.lit("x").alias("c"))
    got = {r["column"]: (r["rows"], r["blanks"], r["distinct"], r["q1"], r["median"], r["q3"]) for r in profile.profile_columns(df).collect()}
    assert got == {"a": (n, 1, n - 1, 251.25, 501.5, 751.75), "b": (n, 0, 5, 1.0, 2.0, 3.0), "c": (n, 0, 1, None, None, None)}


def test_summaries_of_large_columns(spark, monkeypatch):
    monkeypatch.setattr(profile, "group_quantiles", partial(quantile.group_quantiles, most_values=100))
    df = spark.range(1_200).select(F.concat(F.lit("Brand#"), F.col("id") % 25).alias("brand"), (F.col("id") % 30 + 1).cast("int").alias("size"))
    got = [tuple(r) for r in profile.column_summaries(df).drop("mean").collect()]
    assert got == [("brand", "text", 0, 25, None, None), ("size", "number", 0, 30, 1.0, 30.0)]


def test_profile_of_a_large_scope(spark, monkeypatch):
    """More values in scope than one aggregate may hold; those out of scope don't count."""
    monkeypatch.setattr(profile, "group_quantiles", partial(quantile.group_quantiles, most_values=50))
    df = spark.range(2_001).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-1).alias("k"), (F.col("id") % 2).alias("odd"))
    got = profile.profile_columns(df, ["k"], scope=F.col("odd") == 0).first()
    assert (got["rows"], got["distinct"], got["low"], got["q1"], got["median"], got["q3"]) == (1_001, 1_001, 0.0, 500.0, 1_000.0, 1_500.0)


def test_diagnostics(table, rows):
    heads = {(i, n): d for i, _, n, d in diagnose.header_issues(["id", "id", "ID", "", "name"])}
    assert heads == {("duplicateHeaders", 2): "0,1", ("duplicateHeadersCaseInsensitive", 3): "0,1,2", ("blankHeaders", 1): "3"}
    t = table("n\n1\n2\nx\n4\ny")
    assert rows(diagnose.diagnose(t.select("n"))) == [("mixedTypes", "n", 2, "number")]
    assert rows(diagnose.issue_rows(t, "mixedTypes", "n"), "_row") == [(2,), (4,)]


def test_profile_rules(table, rows):
    t = table("id,amount,email\n1,10,a@b.c\n1,oops,bad-email\n,2000,x@y.z")
    r = diagnose.ColumnRule
    spec = diagnose.FileProfile((r("id", required=True, unique=True), r("amount", kind="number", low=0, high=1000), r("email", pattern="^[^@]+@[^@]+$")))
    found = {(a, c): n for a, c, n in rows(diagnose.validate_profile(t, spec))}
    assert found == {("requiredBlank", "id"): 1, ("nonUnique", "id"): 1, ("typeMismatch", "amount"): 1, ("outOfRange", "amount"): 2, ("regexMismatch", "email"): 1}
    assert rows(diagnose.profile_issue_rows(t, spec.rules[0], "nonUnique"), "_row") == [(0,), (1,)]


def test_rules(table, rows):
    def broken(text, rule):
        return [r[0] for r in rows(rules.violating_rows(table(text), [rule]).orderBy("_row"), "_row")]

    low = "low,high\n9.5,10\n11,10\n,10\nabc,10"
    assert broken(low, rules.Rule("r", "numericCompare", ("low", "high"), (("op", "<="),))) == [1, 3]
    dates = "start,end\n2024-01-02,2024-01-10\n2024-02-01,2024-01-01\n2024-03-01,2024-03-01"
    assert broken(dates, rules.Rule("r", "dateOrder", ("start", "end"))) == [1, 2]
    assert broken(dates, rules.Rule("r", "dateOrder", ("start", "end"), (("allow_equal", True),))) == [1]
    sums = "net,tax,gross\n100,20,120\n100,20,121\n100,20,140\n,,"
    assert broken(sums, rules.Rule("r", "sumEquals", ("net", "tax", "gross"), (("tolerance", 1),))) == [2]
    assert broken(sums, rules.Rule("r", "sumEquals", ("net", "tax", "gross"), (("tolerance", 20), ("percent", True)))) == []
    pairs = "country,currency\nUS,USD\nUS,EUR\nDE,EUR\n,"
    assert broken(pairs, rules.Rule("r", "allowedCombinations", ("country", "currency"), (("allowed", (("US", "USD"), ("DE", "EUR"))),))) == [1]
    some = "a,b\n1,\n1,2\n,"
    assert [broken(some, rules.Rule("r", k, ("a", "b"))) for k in ("exactlyOne", "atLeastOne", "atMostOne")] == [[1, 2], [2], [1]]
    assert broken("a,b\nx, x \n,\nx,y", rules.Rule("r", "columnsEqual", ("a", "b"))) == [2]
    assert broken("a,b\nx,\ny,\nx,1", rules.Rule("r", "conditionalRequired", ("a", "b"), (("when", "equals"), ("value", "x")))) == [0]
    assert rows(rules.check_rules(table(low), [rules.Rule("r", "numericCompare", ("low", "high"))])) == [("r", 2)]


def flagged(t, spec):
    return sorted(r["x"] for r in outlier.flag_outliers(t, spec).filter("outlier").collect())


def test_outliers(table, rows):
    t = table("x\n" + "\n".join(map(str, [*range(1, 10), 100])))
    assert flagged(t, outlier.Outlier("x", "iqr")) == ["100"]
    ten = table("x\n" + "\n".join(map(str, range(1, 11))))
    assert len(flagged(ten, outlier.Outlier("x", "percentile", low=10, high=90))) == 2
    assert flagged(ten, outlier.Outlier("x", "zscore", threshold=2)) == []
    for cells_, n in (("1,2,3,4,5,100", 1), ("7,7,7,7,9", 1), ("7,7,7", 0)):
        assert len(flagged(table("x\n" + cells_.replace(",", "\n")), outlier.Outlier("x", "mad"))) == n
    g = table("g,x\na,9\na,10\na,11\na,10\na,60\nb,950\nb,1000\nb,1100\nb,1000\nb,1050")
    assert flagged(g, outlier.Outlier("x", "iqr", ("g",))) == ["60"]
    assert flagged(g, outlier.Outlier("x", "iqr")) == []
    assert rows(outlier.outlier_report(g, outlier.Outlier("x", "iqr", ("g",))), "group", "flagged") == [(["a"], 1), (["b"], 0)]
    fixed = outlier.correct_outliers(g, outlier.Outlier("x", "iqr", ("g",)), "groupMedian")
    assert rows(fixed.filter("_row = 4"), "x") == [("10",)]
    assert outlier.correct_outliers(g, outlier.Outlier("x", "iqr", ("g",)), "removeRows").count() == 9
    c = table("x\na\na\na\nb")
    assert flagged(c, outlier.Outlier("x", "rareCategory", share=0.26)) == ["b"] and flagged(c, outlier.Outlier("x", "rareCategory", share=0.25)) == []
    assert flagged(c, outlier.Outlier("x", "unexpectedCategory", allowed=("a",))) == ["b"]
    assert flagged(c, outlier.Outlier("x", "patternMismatch", pattern="a|c")) == ["b"]


def test_repair(table, rows):
    t = table("group,value\na,1\na,\nb,\nb,2\nb,")
    col = lambda df: [r["value"] or "" for r in df.orderBy("_row").collect()]
    assert col(repair.repair(t, repair.Repair("fillForward", ("value",), groups=("group",)), ["_row"])) == ["1", "1", "", "2", "2"]
    assert col(repair.repair(t, repair.Repair("fillBackward", ("value",), groups=("group",)), ["_row"])) == ["1", "", "2", "2", ""]
    n = table("n,x\n1,a\n2,b\n,a\n4,b\nabc,")
    assert [r["n"] for r in repair.repair(n, repair.Repair("fillMean", ("n",))).orderBy("_row").collect()][2].startswith("2.333")
    assert [r["n"] for r in repair.repair(n, repair.Repair("fillMedian", ("n",))).orderBy("_row").collect()][2] == "2"
    assert [r["x"] for r in repair.repair(n, repair.Repair("fillMode", ("x",))).orderBy("_row").collect()][4] == "a"
    i = table("n,x\n,a\n10,a\n,a\n,a\n40,a\n,a")
    got = lambda **o: [r["n"] or "" for r in repair.repair(i, repair.Repair("interpolate", ("n",), **o), ["_row"]).orderBy("_row").collect()]
    assert got() == ["", "10", "20", "30", "40", ""]
    assert got(extrapolate=True) == ["10", "10", "20", "30", "40", "40"]
    h = table("a,b,c\n1,,\n1,2,3\n,,")
    assert rows(repair.remove_blank_rows(h, ["a", "b", "c"], 0.6), "_row") == [(1,)]
    assert repair.remove_blank_columns(h, ["a", "b", "c"], 0.6).columns == ["_row", "a"]


def test_fill_median_of_large_columns(spark, monkeypatch):
    """Two columns at once, each with more values than one aggregate may hold."""
    monkeypatch.setattr(repair, "group_quantiles", partial(quantile.group_quantiles, most_values=50))
    k = F.col("id")
    df = spark.range(1_200).select("id", F.when(k % 3 > 0, k.cast("double")).alias("v"), F.when(k % 4 > 0, k * 10).alias("w"))
    got = {r["id"]: (r["v"], r["w"]) for r in repair.repair(df, repair.Repair("fillMedian", ("v", "w"))).collect()}
    assert got == {i: (float(i) if i % 3 else 600.0, i * 10 if i % 4 else 6_000) for i in range(1_200)}


def test_report_of_a_large_repair(spark, monkeypatch):
    monkeypatch.setattr(repair, "group_quantiles", partial(quantile.group_quantiles, most_values=50))
    df = spark.range(1_200).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"))
    after = repair.repair(df, repair.Repair("fillMedian", ("v",)))
    assert [tuple(r) for r in repair.repair_report(df, after, ["v"], "id").collect()] == [("v", 400, 0, 0)]


@pytest.mark.parametrize("runs", [1, 9, 400])
def test_fill_forward_across_parts(spark, runs):
    """Against a loop, over many range parts; a run ends where the key changes, wherever the parts are cut."""
    import random

    rng = random.Random(runs)
    keys, k = [], 0
    for _ in range(1500):
        k = (k + 1) % 3 if rng.random() < runs / 1500 else k
        keys.append(k)
    cells_ = [rng.choice([None, None, None, i]) if rng.random() < 0.2 else None for i in range(1500)]
    df = spark.createDataFrame([(i, str(a), b) for i, (a, b) in enumerate(zip(keys, cells_))], "_row long, k string, v long").repartition(7)
    want, last = [], None
    for i, (a, b) in enumerate(zip(keys, cells_)):
        last = b if b is not None else last if i and keys[i - 1] == a else None
        want.append(last)
    out = repair.repair(df, repair.Repair("fillForward", ("v",), groups=("k",)), ["_row"])
    assert [r["v"] for r in out.orderBy("_row").collect()] == want


def statuses(found):
    return [r["status"] for r in found.records.orderBy(F.col("left_key").asc_nulls_last(), F.col("right_key").asc_nulls_last()).collect()]


def test_compare(table, rows):
    both = (("a", "a"), ("b", "b"))
    a, b = table("a,b\n1,x\n2,y\n3,z"), table("a,b\n1,x\n2,CHANGED\n3,z\n4,new")
    assert statuses(compare.compare_tables(a, b, compare.Compare(("_row",), mapping=both))) == ["unchanged", "changed", "unchanged", "added"]
    k = (("id", "id"), ("region", "region"), ("v", "v"))
    l_, r_ = table("id,region,v\n1,e,10\n2,w,20\n3,e,30"), table("id,region,v\n1,e,10\n3,e,31\n4,w,40")
    found = compare.compare_tables(l_, r_, compare.Compare(("_row",), ("id", "region"), k))
    assert statuses(found) == ["unchanged", "removed", "changed", "added"]
    assert rows(found.cells, "column", "before", "after") == [("v", "30", "31")]
    v = (("id", "id"), ("v", "v"))
    conflicts = compare.compare_tables(table("id,v\n1,a\n1,b\n2,c"), table("id,v\n1,z\n2,c\n3,d\n3,e"), compare.Compare(("_row",), ("id",), v))
    assert statuses(conflicts) == ["conflict", "conflict", "unchanged", "conflict", "conflict"]
    assert statuses(compare.compare_tables(table("id,v\n1,a"), table("id,v\n1,x\n1,y"), compare.Compare(("_row",), ("id",), v))) == ["conflict", "conflict"]
    e = (("id", "id"), ("n", "n"), ("d", "d"), ("t", "t"))
    x, y = table("id,n,d,t\n1,1,2024-03-01, pad \n2,2,2024-01-01,x"), table("id,n,d,t\n1,1.0,03/01/2024,pad\n2,2.5,2024-01-01,x")
    assert statuses(compare.compare_tables(x, y, compare.Compare(("_row",), ("id",), e, trim=True, numeric_equal=True, date_equal=True))) == ["unchanged", "changed"]
    assert set(statuses(compare.compare_tables(x, x, compare.Compare(("_row",), ("id",), e)))) == {"unchanged"}


def test_clusters(table, rows):
    t = table('name\nJohn Doe\n"doe, john"\nJOHN  DOE\nJane Roe\njohn doe\nJane Roe')
    assert rows(cluster.cluster_values(t, cluster.Cluster("name")), "suggestion", "rows", "values") == [("JOHN  DOE", 4, 4)]
    m = table("name\nMississippi\nMississipi\nMissisippi\nTexas")
    assert rows(cluster.cluster_values(m, cluster.Cluster("name", "levenshtein", threshold=2)), "values") == [(3,)]
    assert cluster.cluster_values(m, cluster.Cluster("name", "jaroWinkler", threshold=0.95)).first()["values"] == 3
    with pytest.raises(ValueError, match="pairs"):
        cluster.cluster_values(m, cluster.Cluster("name", "levenshtein", max_pairs=1))
    fixed = cluster.apply_mapping(m, "name", {"Missisippi": "Mississippi"})
    assert fixed.filter("name = 'Mississippi'").count() == 2


def test_levenshtein_clusters_lose_no_pair(spark):
    import random

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "name string")
    for k in (1, 2):
        vals = cluster._values(df, cluster.Cluster("name")).withColumn("norm", F.col("value"))
        got = {tuple(r) for r in cluster._links(vals, cluster.Cluster("name", "levenshtein", threshold=k)).collect()}

        def lev(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            return row[-1]

        want = {(a, b) for a in words for b in words if a < b and lev(a, b) <= k and abs(len(a) - len(b)) <= max(len(a), len(b)) // 4 + 3}
        assert got == want


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.8, 0.9])
def test_jaro_winkler_clusters_lose_no_pair(spark, threshold):
    """Against all pairs within the length band, anagrams and values that share no pair of characters among them."""
    rng = random.Random(3)
    values = {"".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12))) for _ in range(110)} | {"badcfe", "abcdef", "é", "zé"}
    values = sorted(values)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            x, y = (v.replace("é", "e") for v in (a, b))
            if abs(len(x) - len(y)) <= max(len(x), len(y)) // 4 + 3 and fn.jaro_winkler_of(x, y) >= threshold:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame([(v,) for v in values], "name string").repartition(3)
    got = {r["value"]: r["cluster"] for r in cluster.cluster_members(df, cluster.Cluster("name", "jaroWinkler", threshold=threshold)).collect()}
    assert got == {v: root(v) for v in values}


def test_components_of_a_long_chain(spark, monkeypatch):
    """A chain of 300 ends after a number of rounds that grows with its logarithm."""
    saved = []
    monkeypatch.setattr(graph, "persisted", lambda df: saved.append(1) or order.persisted(df))
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in graph.components(links).collect()} == {0} and len(saved) < 25


def test_rule_samples(table):
    t = table("a,b\n1,2\n5,2\n7,2\n9,1")
    found = rules.rule_samples(t, [rules.Rule("less", "numericCompare", ("a", "b")), rules.Rule("same", "columnsEqual", ("b", "b"), (("negate", True),))], "_row", 2).collect()
    assert sorted((r["rule"], r["_row"], tuple(sorted(r["cells"].items()))) for r in found) == [("less", 1, (("a", "5"), ("b", "2"))), ("less", 2, (("a", "7"), ("b", "2"))), ("same", 0, (("b", "2"),)), ("same", 1, (("b", "2"),))]


def test_similarity(spark):
    for a, b, want in (("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("same", "same", 1.0), ("", "x", 0.0)):
        assert abs(fn.jaro_winkler_of(a, b) - want) < 0.011
    assert values(spark, fn.fingerprint, "Éric  the-Red, the") == ["eric red the"]
    assert values(spark, lambda c: fn.ngram_fingerprint(c, 3), "ab", "abab") == ["ab", "ababab"[:3] + "bab"]


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [("email", "a.user@example.co.uk", "not-an-email@nowhere"), ("ipv4", "192.168.0.1", "999.1.1.1"), ("ipv6", "2001:db8::ff00:42:8329", "2001:::1"), ("percentage", "12.5%", "12.5"), ("currency", "$1,234.56", "1234x"), ("phoneNumber", "+1 555-123-4567", "12"), ("postalCode", "90210-1234", "9021"), ("json", '{"a": 1}', "{broken"), ("url", "https://x.org/a", "x.org"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567")],
)
def test_detectors(spark, kind, good, bad):
    assert values(spark, lambda c: fn.matches(c, kind), good, bad, None, " ") == [True, False, False, False]


def test_semantic_actions_and_scan(table, rows, spark):
    assert values(spark, fn.url_host, "https://[2001:db8::1]:8443/x", "https://user@example.com:8080/p", "http://[unclosed", "plain") == ["2001:db8::1", "example.com", None, None]
    assert values(spark, fn.email_domain, "a@b.c", "a@b", "x") == ["b.c", None, None]
    assert values(spark, fn.percent_to_decimal, "12.5%", "12") == [0.125, None]
    t = table("m\n" + "\n".join(f"u{i}@x.org" for i in range(12)))
    assert semantic.semantic_scan(t, ["m"]).first()["detected"] == "email"
    c = table("m\n" + "\n".join("ab"[i % 2] for i in range(40)))
    assert semantic.semantic_scan(c, ["m"]).first()["detected"] == "categorical"
    assert semantic.semantic_scan(table("m\na@b.c"), ["m"]).first()["detected"] is None
    assert rows(semantic.semantic_action(table("m\n A@B.C "), "m", "email", "normalize"), "m") == [("a@b.c",)]


def test_personal_data(table, rows, spark):
    ssn = lambda c: fn.matches_pii(c, "ssn")
    assert values(spark, ssn, "123-45-6789", "000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000") == [True] + [False] * 5
    card = lambda c: fn.matches_pii(c, "paymentCard")
    assert values(spark, card, "4111 1111 1111 1111", "4111 1111 1111 1112", "411", "x") == [True, False, False, False]
    t = table("a,b\nuser@example.com,10.0.0.1\n+1 555-123-4567,ACC-12345\nplain,text")
    found = pii.pii_scan(t, (*pii.DETECTORS, pii.Detector("custom", r"ACC-\d{5}", "account")), ["a", "b"])
    assert sum(r["matches"] for r in found.collect()) == 4
    assert values(spark, lambda c: fn.mask(c, "email"), "user@example.com") == ["•••@example.com"]
    assert values(spark, lambda c: fn.mask(c, "ssn"), "123-45-6789", "ab", "a") == ["•" * 7 + "6789", "•b", "a"]
    want = "pii_" + hmac.new(b"secret\x1fsalt", b"user@example.com", hashlib.sha256).hexdigest()[:16]
    out = pii.redact(t, pii.Detector("email"), "a", pii.Redaction("pseudonymize", secret="secret", salt="salt"))
    assert rows(out.filter("_row = 0"), "a") == [(want,)]
    assert "secret" not in out._jdf.queryExecution().toString()
    assert pii.redact(t, pii.Detector("email"), "a", pii.Redaction("removeRows")).count() == 2
    assert pii.redaction_audit(t, pii.Detector("email"), "a", pii.Redaction("fixed")).first()["cells"] == 1


def test_transforms(table, rows, spark):
    assert values(spark, fn.title_case, "ada del rey-smith") == ["Ada Del Rey-Smith"]
    t = table("a\n10-20\nx")
    one = lambda kind, **o: [r["a"] for r in transform.transform(t, transform.Transform(kind, o), ["a"]).orderBy("_row").collect()]
    assert one("replaceRegex", pattern=r"(\d+)-(\d+)", replace="$2/$1") == ["20/10", "x"]
    assert values(spark, lambda c: fn.normalise_number(c, True), "1.234,56", "x") == ["1234.56", None]
    assert values(spark, fn.normalise_date, "03/01/2024", "soon") == ["2024-03-01", None]
    assert values(spark, fn.normalise_bool, "yes", "0", "maybe") == ["TRUE", "FALSE", None]
    assert rows(transform.transform_report(t, transform.Transform("normalizeNumbers"), ["a"])) == [("a", 0, 2)]
    with pytest.raises(Exception, match="normalizeNumbers of a"):
        transform.transform(t, transform.Transform("normalizeNumbers"), ["a"], on_error="failAll").collect()
    s = transform.split_column(t, "a", "-").orderBy("_row")
    assert s.columns == ["_row", "a 1", "a 2"] and rows(s, "a 1", "a 2") == [("10", "20"), ("x", "")]
    assert rows(transform.merge_columns(table("a,b,c\n1,,3"), ["c", "a", "b"], "-"), "c+a+b") == [("3-1-",)]


def test_kernels_equal_the_plain_functions():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcé漢🙂") for _ in range(n))
    x = [word(rng.randrange(12)) for _ in range(3_000)]
    y = [word(rng.randrange(12)) if rng.random() < 0.5 else "".join(c if rng.random() < 0.8 else rng.choice("abc") for c in v) + word(rng.randrange(3)) for v in x]
    x, y = [*x, "", "a", "", "x" * 200, word(90)], [*y, "", "", "b", "x" * 201, word(150)]
    assert pairs.jaro_winkler(x, y).tolist() == [fn.jaro_winkler_of(a, b) for a, b in zip(x, y)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, e in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != e))
        return row[-1]

    far = [edits(a, b) for a, b in zip(x, y)]
    for most in (0, 1, 2, 4):
        assert pairs.within_edits(x, y, most).tolist() == [d <= most for d in far]
    assert pairs.jaro_winkler([], []).tolist() == [] and pairs.within_edits([], [], 1).tolist() == []


@pytest.mark.parametrize("block", [1, 3, 1_000])
def test_pairs_of_a_key_meet_once_over_blocks(spark, monkeypatch, block):
    """One key for all values: whatever the blocks, batches and homes, each linked pair comes out once."""
    monkeypatch.setattr(cluster, "BLOCK", block)
    rng = random.Random(block)
    values = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    df = spark.createDataFrame([(v, v, "k") for v in values], "value string, norm string, key string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, cluster._compared(df, lambda x, y: pairs.within_edits(x, y, 1)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lev = lambda a, b: bool(pairs.within_edits([a], [b], 1)[0])
    assert got == [(a, b) for a in values for b in values if a < b and lev(a, b)]
