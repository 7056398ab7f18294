"""Filter audit, Merkle manifest and license scans against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tabwright.llm import audit, licenses, merkle

WS = "\\x20\\x09-\\x0D"


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, part string, _fails string, _digest string, good string"


def odd_documents():
    """Nulls in every column, empty and long texts, copies, repeated rows, ids that repeat, and columns with clashing names."""
    many = " ".join(f"w{i}" for i in range(150))
    texts = [None, "", many, many + " # end", many.upper(), "Same same same", "a" * 50, many, many, None, "x  y\x0bz", "É" * 200 + " A", many * 40, "Same same same", "under 100 | words", "\n\t "]
    rows = [(i if i % 7 != 6 else None, t, [None, "", "en", "de"][i % 4], ["a", None, "b"][i % 3], len(t or "") or None, "p", "f", "d", "g") for i, t in enumerate(texts)]
    rows += [(i, f"Capital {i} LETTERS", "en", "a", None, "p", "f", "d", "g") for i in range(100, 120)]
    return [*rows, rows[3], rows[3], (3, "other", "en", "a", 5, "p", "f", "d", "g")]


# --- 11: filter audit -----------------------------------------------------------------------------------------------


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 7, 100, 4097):
        words = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        assert audit.positional_popcount(words).tolist() == [int(((words >> np.uint32(i)) & 1).sum()) for i in range(32)]


def plain_audit(docs, labels):
    def failing(d):
        text = d[1] or ""
        w = re.findall(f"[^{WS}]+", text)
        same = [x[0] for x in docs if (x[1] or "") == text and x[0] is not None]
        out = ""
        out += "A" * (len(w) < 100)
        out += "B" * (100 * len(set(w)) < 80 * len(w))
        out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
        out += "D" * bool(re.search("[#$%&*|]", text))
        out += "E" * (d[0] is not None and any(x < d[0] for x in same))
        return out

    said = lambda i, k: any(x[0] == i and i is not None and x[k] == 1 for x in labels)
    rows = [(d[2] or "", failing(d), said(d[0], 1), said(d[0], 2)) for d in docs]
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed_by[x] += len(gone)
                out.append([part, order, step, len(left), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == x for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        for r in out:
            if r[0] == part:
                r.append(removed_by[r[1][r[2] - 1]])
    return sorted(map(tuple, out))


def test_op11_on_odd_rows(spark, tmp_path):
    docs = odd_documents()
    labels = [(i, i % 2, i % 3 == 0) for i in range(12)] + [(None, 1, True), (3, 0, None), (3, 1, None), (8, None, True)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    sf = write(spark, tmp_path, documents=(docs, DOCUMENTS), labels=(labels, "doc_id long, quality int, toxic int"))
    out = audit.op11_filter_audit(spark, sf)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == plain_audit(docs, labels)


def test_op11_empty(spark, tmp_path):
    sf = write(spark, tmp_path, documents=([], DOCUMENTS), labels=([], "doc_id long, quality int, toxic int"))
    assert audit.op11_filter_audit(spark, sf).count() == 0


def test_subset_survivors_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(audit, "MOST_GROUPS", 5)
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 700).alias("p"))
    out = audit.subset_survivors(df, F.col("p"), [F.col("id") % 2 == 0, F.col("id") > 2000], {"odd": F.col("id") % 3 == 0})
    got = {(r["part"], r["subset"]): (r["survivors"], r["odd"]) for r in out.collect()}
    assert len(got) == 2800
    for p, s in ((0, 0), (1, 1), (699, 3), (350, 2)):
        own = [i for i in range(3000) if i % 700 == p and not (s & 1 and i % 2 == 0) and not (s & 2 and i > 2000)]
        assert got[str(p), s] == (len(own), sum(i % 3 == 0 for i in own))
    with pytest.raises(ValueError):
        audit.subset_survivors(df, F.col("p"), [F.lit(True)] * 6)


# --- 12: Merkle manifest --------------------------------------------------------------------------------------------


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 :][:16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def plain_leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for i, text, lang, source, n in [d[:5] for d in docs]:
        own = plain_leaf((i, source, lang, n, text))
        bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        held = plain_leaf((i, source, lang, n, text and text.translate(lower))) if bad else own
        by.setdefault(source, []).append((i, own, held))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_levels([x[1] for x in by[s]])
    top = plain_levels([trees[s][-1][0] for s in order])
    root = top[-1][0]
    out = []
    for k, s in enumerate(order):
        for at, (i, own, held) in enumerate(by[s]):
            path = plain_path(trees[s], at) + plain_path(top, k)
            up = held
            for left, right in path:
                up = H("".join([*left, up, *right]))
            out.append((i, own, trees[s][-1][0], root, H("".join("".join(a + b) for a, b in path)), up, up == root))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_op12_on_odd_rows(spark, tmp_path):
    docs = odd_documents()
    sf = write(spark, tmp_path, documents=(docs, DOCUMENTS))
    out = merkle.op12_merkle_manifest(spark, sf)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = out.collect()
    assert by_text(got) == by_text(plain_manifest(docs)) and not all(r["verified"] for r in got)


def test_op12_empty_and_alone(spark, tmp_path):
    sf = write(spark, tmp_path / "a", documents=([], DOCUMENTS))
    assert merkle.op12_merkle_manifest(spark, sf).count() == 0
    one = [(None, "Text", None, None, None, "p", "f", "d", "g")]
    sf = write(spark, tmp_path / "b", documents=(one, DOCUMENTS))
    (row,) = merkle.op12_merkle_manifest(spark, sf).collect()
    assert row["leaf"] == row["root"] == row["folded_root"] and row["proof_sha256"] == H("") and row["verified"]


def test_op12_parts_of_several_blocks_and_many_parts(spark, tmp_path):
    docs = [(i, f"Text {i % 7}", "en", "hot" if i < 4500 else f"s{i}", i) for i in range(9000)]
    sf = write(spark, tmp_path, documents=([(*d, "p", "f", "d", "g") for d in docs], DOCUMENTS))
    assert by_text(merkle.op12_merkle_manifest(spark, sf).collect()) == by_text(plain_manifest(docs))


def test_append_log_is_in_postorder(spark):
    def postorder(level, index, n):
        out = []
        if level:
            for child in range(index * 16, min(index * 16 + 16, -(-n // 16 ** (level - 1)))):
                out += postorder(level - 1, child, n)
        return [*out, (level, index)]

    for n in (1, 2, 16, 17, 255, 256, 257, 4000):
        top = merkle.levels_over(n)
        assert [merkle.position(*node, n, top) for node in postorder(top, 0, n)] == list(range(merkle.subtree_size(n, top)))
    n = 5000
    rows = spark.range(n).select(F.col("id"), F.lit("one").alias("part"), F.sha2(F.encode(F.col("id").cast("string"), "UTF-8"), 256).alias("_leaf"))
    made = merkle.manifest(rows, "id", "part", ["id"])
    levels = plain_levels([H(str(i)) for i in range(n)])
    want = [(level, index, levels[level][index]) for level, index in postorder(4, 0, n)]
    assert [tuple(r) for r in made.log().orderBy("position").select("level", "index", "digest").collect()] == want
    assert [r[0] for r in made.log().orderBy("position").select("position").collect()] == list(range(len(want)))


# --- 13: license scans ----------------------------------------------------------------------------------------------


def plain_scan(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, percent=80):
    w = re.findall("[0-9a-z\u0080-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, p.label) for p in phrases for ws in [licenses.words(p.text)] for i in range(len(w)) if w[i : i + len(ws)] == ws]
    found = set()
    for t in templates:
        own, size = set(licenses.words(t.text)), licenses.step(t)
        for at in range(0, max(len(w), 1), size):
            shared = len(own & set(w[at : at + 2 * size]))
            if (at == 0 or at + size < len(w)) and 100 * shared >= percent * len(own):
                found.add((t.label, at, 2 * size, shared / len(own)))
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    base = sorted({x for _, x in places})
    score = 1.0 if base else max([x[3] for x in found], default=0.0)
    return len(w), len(places), first, last, base, sorted({*base, *(x[0] for x in found)}), score, sorted(found)


def license_texts():
    t = {x.label: x.text for x in licenses.TEMPLATES}
    cut = " ".join(t["mit"].split()[:-6])
    filler = " ".join(f"Wort{i}" for i in range(37))
    return [
        None,
        "",
        "...",
        "Released under the MIT License.",
        "UNDER  the\n* MIT-License, apache license (version 2) and Apache License, Version 2.0; CC BY-NC",
        "under the mité license",
        "under the mit",
        "under the",
        "license",
        t["mit"],
        f"{filler}\n# {cut}\n{filler}",
        filler * 3 + t["bsd"].upper().replace(" ", "\n// "),
        " ".join(t["mit"].split()[::-1]),
        " ".join(t["mit"].split()[:40]),
        t["gpl"] + filler + t["gpl"],
        (filler + " cc by nc ") * 3000,
        "cc by nc",
        "cc by nc",
    ]


def test_op13_on_odd_rows(spark, tmp_path):
    docs = [(i if i not in (3, 9) else None, x, None, None, None, "p", "f", "d", "g") for i, x in enumerate(license_texts())]
    docs += [docs[4], (5, "another text under this id cc by nc", "en", "a", 1, "p", "f", "d", "g")]
    sf = write(spark, tmp_path, documents=(docs, DOCUMENTS))
    out = licenses.op13_license_scan(spark, sf)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = []
    for d in docs:
        n, k, first, last, base, labels, score, _ = plain_scan(d[1])
        want.append((d[0], n, k, first, last, ",".join(base), ",".join(labels), score))
    assert by_text(out.collect()) == by_text(want)
    assert {"mit", "bsd", "gpl", "cc-by-nc"} <= {x for r in want for x in r[6].split(",")}
    assert licenses.op13_license_scan(spark, write(spark, tmp_path / "none", documents=([], DOCUMENTS))).count() == 0


def test_template_join_is_exact(spark):
    """Random texts of few words around the thresholds, ties of frequencies, short and long templates, a phrase that overlaps itself."""
    rng = random.Random(3)
    some = [f"w{i}" for i in range(60)]
    templates = [licenses.Template(f"t{k}", " ".join(rng.choice(some) for _ in range(rng.choice([1, 2, 5, 12, 16, 17, 30, 40])))) for k in range(25)]
    phrases = [licenses.Template("again", "w1 w1"), licenses.Template("one", "w2")]
    texts = [" ".join(rng.choice(some[: rng.choice([5, 30, 60])]) for _ in range(rng.choice([0, 1, 3, 15, 16, 17, 31, 32, 33, 48, 64, 65, 200]))) for _ in range(150)] + ["w1 w1 w1 w2", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for percent in (50, 80, 100):
        out = licenses.scan_licenses(df, templates=templates, phrases=phrases, percent=percent).collect()
        assert len(out) == len(texts)
        for r in out:
            want = plain_scan(texts[r["doc_id"]], templates, phrases, percent)
            assert tuple(r)[1:8] == want[:7]
            assert [tuple(x) for x in r["found"]] == [Row(*x) for x in want[7]]
    with pytest.raises(ValueError):
        licenses.scan_licenses(df, templates=[licenses.Template("x", "...")])
