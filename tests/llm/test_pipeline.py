"""The pipeline's stages against plain versions of them, with planted junk, lines, copies and passages."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import WS, brute_leaks, brute_near, lev, reference  # noqa: F401

from tabwright.llm import lines

SF = "/root/testdata/sf0.001"


def plain_lines(docs):
    """doc -> text after line dedup, None for a document that is dropped."""
    edits = lambda n: max((k for start, k in lines.BANDS if n >= start), default=0)
    first = {}
    for d, t in sorted(docs.items()):
        for i, x in enumerate([] if t is None else t.split("\n")):
            if x.strip(WS):
                first.setdefault(x.strip(WS), (d, i))
    # a line near to an earlier one: lengths and bags of characters rule most pairs out before the distance is counted
    bags = {x: collections.Counter(x) for x in first}
    early = {}
    for b in first:
        for a in first:
            k = edits(min(len(a), len(b)))
            if first[a] < first[b] and abs(len(a) - len(b)) <= k and sum((bags[a] - bags[b]).values()) <= k and lev(a, b) <= k:
                early[b] = True
                break
    out = {}
    for d, t in docs.items():
        all_lines = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(all_lines) if not x.strip(WS) or (first[x.strip(WS)] == (d, i) and x.strip(WS) not in early)]
        gone = len(kept) < len(all_lines)
        out[d] = t if not gone else "\n".join(kept) if any(x.strip(WS) for x in kept) else None
        if gone and out[d] is None:
            out[d] = False
    return {d: t for d, t in out.items() if t is not False}


@pytest.fixture(scope="module")
def planted():
    """(documents, junk ids, benchmark items)"""
    rng = random.Random(21)
    words = ["".join(rng.choice("bdfklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(2000)]
    weights = [1 / (5 + i) for i in range(len(words))]
    line = lambda n: " ".join(rng.choices(words, weights, k=n)).capitalize() + "."
    texts = [line(rng.randrange(30, 60)) if i % 3 == 0 else "\n".join(line(rng.randrange(8, 20)) for _ in range(rng.randrange(1, 6))) for i in range(150)]
    licence = line(15)
    for i in range(100, 110):
        texts[i] += "\n" + licence  # a line that repeats, once with a change in it
    texts[110] += "\n" + licence.replace("a", "e", 1)
    texts += [texts[0], texts[3] + " more", texts[1] + "\n" + line(12)]  # copies: exact, near, by their lines
    # one word of sixty is another: too many edits for line dedup, and 51 of 61 shingles in common
    long = [line(60), line(60).split()]
    texts += [long[0], " ".join([*long[0].split()[:30], "zqxjkwzqxjkw", *long[0].split()[31:]]), " ".join(long[1]), " ".join([*long[1][:59], "zqxjkwzqxjkw"])]
    items = [(i, line(14)) for i in range(5)] + [(9, "zq zw")]
    texts += [f"{line(12)[:-1]} {items[2][1]} {line(9)}", f"Zq, zw {line(10)}", "", " \n", "Short one.", "OK"]
    docs = dict(enumerate(texts))
    docs[len(docs)] = None
    junk = set()
    for k in range(24):
        junk.add(5000 + k)
        own = line(rng.randrange(25, 50))
        docs[5000 + k] = [own.upper().replace(" ", "!! "), " | ".join(own.split()), " ".join(w + "$$$ &&&" for w in own.split()), " ".join(f"{w} {w}" for w in own.split())][k % 4]
    return docs, junk, items


def test_stages_equal_plain_versions(spark, planted, tmp_path, reference):  # noqa: F811
    texts, junk, items = planted
    schema = "doc_id long, text string, lang string, source string, n_chars long, `keep` string"
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "own") for d, t in texts.items()], schema).repartition(4)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.drop("keep").write.parquet(str(tmp_path / "documents.parquet"))
    want = {d: t for d, t in texts.items() if d not in junk}
    steps = [want, plain_lines(want)]
    groups = brute_near(sorted(steps[-1].items()), 5)
    steps.append({d: t for d, t in steps[-1].items() if groups[d][1] == d})
    leaks = brute_leaks(list(steps[-1].items()), items)
    steps.append({d: t for d, t in steps[-1].items() if not leaks[d][1]})
    assert [len(s) for s in steps] == sorted({len(s) for s in steps}, reverse=True)  # every stage has something to do
    for (name, stage), expected in zip(corpus_pipeline.STAGES, [*steps, steps[-1]]):
        out = stage(spark, docs, str(tmp_path)).cache()
        rows = out.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == expected and len(rows) == len(expected), name
        assert {r["keep"] for r in rows} == {"own"} and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows), name
        if name != "bpe":
            assert out.columns == docs.columns
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
            docs = out
    assert {r["doc_id"]: (r["ids"], r["n_tokens"]) for r in rows} == {d: (i := reference.encode_ordinary(t or ""), len(i)) for d, t in steps[-1].items()}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["ids"] for r in run.collect()} == {r["doc_id"]: r["ids"] for r in rows}


def test_stages_take_odd_rows(spark, planted, tmp_path):
    """Null and repeated ids, rows that repeat, a very long text: no stage fails, and rows without words stay."""
    texts, junk, items = planted
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(d, t) for d, t in texts.items()] + [(None, None), (None, texts[5]), (7, texts[8]), (9, texts[9]), (9, texts[9]), (8000, "x" * 300_000), (8001, "very long words " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        ids = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert ids[8000] == 1 and docs.filter("doc_id IS NULL AND text IS NULL").count() == 1, name
    assert ids[9] == 1 and docs.filter("text IS NULL OR text = ''").count() >= 2


def test_pipeline_keeps_clean_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, SF)
    bad = labels.filter("quality = 0")
    assert good.join(bad, "doc_id", "left_semi").count() <= 0.1 * bad.count()
    assert good.join(labels.filter("quality = 1"), "doc_id", "left_semi").count() == labels.filter("quality = 1").join(docs, "doc_id", "left_semi").count()
    assert docs.filter(F.col("text").isNull()).count() == good.filter(F.col("text").isNull()).count()
