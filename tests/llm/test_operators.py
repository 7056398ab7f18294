"""Each operator against brute force on small tables, with nulls, empty and long texts, repeats, ties and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from tabwright.llm import bpe, chat, common, decontaminate, exact, lines, near, quality, registry, secrets, sharding, token_counts
from tabwright.llm.common import flat, strings

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture
def frame(spark):
    def make(*texts, **more):
        extra = ", ".join(f"{k} string" for k in more)
        return spark.createDataFrame([(i, t, *more.values()) for i, t in enumerate(texts)], "doc_id long, text string" + (f", {extra}" if more else "")).repartition(3)

    return make


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def reference():
    own = bpe.tokenizer(bpe.default_ranks())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


# --- 2: byte-level BPE ----------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(reference):
    rng = random.Random(1)
    alphabet = "ab'sdtrevlm  \n\t1２é　!?.漢🙂ⅷ'"
    all_texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["", " ", "'", "''s", "  's", "a" * 3000, "ab" * 2000 + "  ", "\ufeff\x00x"]
    all_texts += ["a" + chr(i) + "1" + chr(i) + " b" for i in [*range(0x3100), *range(0x3100, 0x110000, 97)] if not 0xD800 <= i < 0xE000]
    own = bpe.tokenizer(bpe.default_ranks())
    ids, at, _, _ = own.encode(*flat(strings(pa.array(all_texts))))
    ids = ids.to_numpy()
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [reference.encode_ordinary(t) for t in all_texts]


def test_bpe_encode_decode(frame, reference):
    long = "Ünïcode words, 'll and more. " * 8000
    df = bpe.encode(frame("It's 12 o'clock", None, "", long, "x", ids="taken"))
    out = {r["doc_id"]: r for r in bpe.decode(df).collect()}
    for i, t in enumerate(["It's 12 o'clock", "", "", long, "x"]):
        assert out[i]["ids"] == reference.encode_ordinary(t) and bytes(out[i]["decoded"]) == t.encode()
        assert (out[i]["offsets"] or [0])[-1] == len(t.encode()) and len(out[i]["offsets"]) == len(out[i]["ids"])
    assert bpe.encode(frame("x").limit(0)).count() == 0
    twice = frame("It's 12", "It's 12", "It's 12").withColumn("doc_id", F.lit(1))
    assert [r["ids"] for r in bpe.encode(twice).collect()] == [reference.encode_ordinary("It's 12")] * 3


def test_op2(spark, texts, reference):
    out = bpe.op2_bpe_roundtrip(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))


# --- 1: token counts ------------------------------------------------------------------------------------------------


def test_edits_count_like_encoding_anew(reference):
    rng = random.Random(2)
    own = bpe.tokenizer(bpe.default_ranks())
    some = lambda n: "".join(rng.choice("ab'sdtrevlm  \n\t1é　!?.漢🙂'") for _ in range(rng.randrange(n)))
    all_texts = [some(300) for _ in range(600)] + ["", " ", "'", some(9000)]
    found = token_counts.documents(own, strings(pa.array(all_texts)))
    for _ in range(5):
        edits = []
        for i, t in enumerate(all_texts):
            at, drop, put = rng.randrange(len(t) + 3), rng.choice([0, 0, 1, 2, 5, 50]), some(rng.choice([1, 3, 10]))
            edits.append((found[i], at, drop, put))
            all_texts[i] = t[:at] + put + t[at + drop :]
        token_counts.apply_edits(own, edits)
        assert [(d.data.decode(), d.tree.n_tokens, d.tree.n_bytes) for d in found] == [(t, len(reference.encode_ordinary(t)), len(t.encode())) for t in all_texts]


def test_edit_reencodes_little(frame):
    df = frame("many words stand here " * 5000, None, "short", n_tokens="taken")
    log = df.sparkSession.createDataFrame([(0, 1, 50_000, 3, "new"), (0, 2, 10, None, None), (2, 1, 99, 1, "!"), (7, 1, 0, 0, "x")], "doc_id long, seq int, at int, drop int, put string")
    out = {r["doc_id"]: r for r in token_counts.count_edited(token_counts.with_edit_log(df, log), edited="now").collect()}
    assert out[0]["pieces_encoded"] < 40 < 10_000 < out[0]["n_pieces"] and out[0]["tree_tokens"][1] == out[0]["n_tokens_edited"]
    assert (out[1]["n_tokens"], out[1]["n_tokens_edited"], out[1]["now"]) == (0, 0, "") and out[2]["now"] == "short!"
    assert set(out) == {0, 1, 2}


def test_stored_trees_encode_only_what_edits_touch(spark, reference, tmp_path):
    """Three batches on a table that is stored in between, against encoding anew; a place that is edited again and again stays cheap."""
    rows = [(0, "many words stand here, it's true " * 4000), (1, None), (2, ""), (2, "été 漢字 🙂 x"), (None, "last one"), (5, "again and " * 50)]
    now = {i: t or "" for i, (_, t) in enumerate(rows)}
    df = spark.createDataFrame([(k, i, t, "own") for i, (k, t) in enumerate(rows)], "doc_id long, row int, text string, tokens string").repartition(3)
    token_counts.build_trees(df).write.parquet(str(tmp_path / "0"))
    rng = random.Random(12)
    for batch in range(3):
        edits = {i: [(rng.randrange(len(t) + 2), rng.choice([0, 1, 5]), rng.choice([" and", "x", "", "''s 漢"])) for _ in range(4)] for i, t in now.items()}
        edits[5] = [(20, 0, f" w{k}") for k in range(120)]
        for i, own in edits.items():
            for at, drop, put in own:
                now[i] = now[i][:at] + put + now[i][at + drop :]
        given = spark.createDataFrame(list(edits.items()), f"row int, edits array<{token_counts.EDIT}>")
        stored = spark.read.parquet(str(tmp_path / str(batch)))
        token_counts.edit_trees(stored.join(given, "row")).drop("edits").write.parquet(str(tmp_path / str(batch + 1)))
        out = {r["row"]: r for r in spark.read.parquet(str(tmp_path / str(batch + 1))).collect()}
        assert {i: (r["text"], r["n_tokens"], sum(r["tokens"]), sum(r["sizes"])) for i, r in out.items()} == {i: (t, n := len(reference.encode_ordinary(t)), n, len(t.encode())) for i, t in now.items()}
        assert out[0]["pieces_encoded"] < 120 and out[5]["pieces_encoded"] < 120 * 30


def test_trees_of_a_hot_place():
    own = bpe.tokenizer(bpe.default_ranks())
    (doc,) = token_counts.documents(own, strings(pa.array(["word " * 500])))
    for k in range(1500):
        token_counts.apply_edits(own, [(doc, 1000, 0, f"n{k} ")])
    assert max(map(len, doc.tree.sizes)) <= token_counts.CROWDED and doc.tree.n_bytes == len(doc.data)
    (fresh,) = token_counts.documents(own, strings(pa.array([doc.data.decode()])))
    assert fresh.tree.n_tokens == doc.tree.n_tokens


def test_edit_log_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "x"), (3, "z")], "doc_id long, text string")
    log = spark.createDataFrame([(1, 1, 0, 0, "q"), (1, 1, 0, 0, "p"), (None, 1, 0, 1, ""), (9, 1, 0, 0, "y")], "doc_id long, seq int, at int, drop int, put string")
    out = token_counts.count_edited(token_counts.with_edit_log(df, log), edited="now").collect()
    assert sorted(((r["doc_id"], r["now"]) for r in out), key=repr) == [(1, "qpabc"), (1, "qpabc"), (3, "z"), (None, "x")]


def test_op1(spark, texts, reference):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("edits", token_counts.derived_edits())
    edited = {}
    for r in docs_.collect():
        t = r["text"]
        for e in r["edits"]:
            t = t[: e["at"]] + e["put"] + t[e["at"] + e["drop"] :]
        edited[r["doc_id"]] = t
    for r in token_counts.op1_token_counts(spark, SF).collect():
        assert r["n_tokens"] == len(reference.encode_ordinary(texts[r["doc_id"]]))
        assert r["n_tokens_edited"] == len(reference.encode_ordinary(edited[r["doc_id"]]))


# --- 3: lines -------------------------------------------------------------------------------------------------------


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def one_edit(a, b):
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute_lines(docs_):
    first, near_ = {}, collections.defaultdict(set)
    for d, t in sorted(docs_):
        for i, x in enumerate((t or "").split("\n") if t is not None else []):
            if x.strip(WS):
                first.setdefault(x.strip(WS), (d, i))
    long = [x for x in first if len(x) >= lines.MIN_CHARS]
    for i, a in enumerate(long):
        for b in long[:i]:
            if one_edit(a, b):
                near_[a].add(b)
                near_[b].add(a)
    out = {}
    for d, t in docs_:
        n_exact = n_near = n_links = 0
        keep = []
        all_lines = t.split("\n") if t is not None else []
        for i, raw in enumerate(all_lines):
            x = raw.strip(WS)
            n_links += len(near_[x]) if x else 0
            if x and first[x] != (d, i):
                n_exact += 1
            elif x and any(first[y] < first[x] for y in near_[x]):
                n_near += 1
            else:
                keep.append(raw)
        out[d] = (len(all_lines), n_exact, n_near, n_links, sha("\n".join(keep)))
    return out


def test_op3(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé \t") for _ in range(rng.randrange(28, 80))) for _ in range(12)] + ["x" * 40, "é" * 70_000]
    docs_ = []
    for d in range(120):
        own = []
        for _ in range(rng.randrange(6)):
            b = list(rng.choice(base))
            k, kind = rng.randrange(len(b)), rng.random()
            if kind < 0.2:
                b[k] = rng.choice("xyz")
            elif kind < 0.4:
                b.insert(k, rng.choice("xya"))
            elif kind < 0.6:
                del b[k]
            own.append("".join(b))
            if rng.random() < 0.3:
                own.append(rng.choice(["", "  ", "ok", "ok "]))
        docs_.append((d, "\n".join(own) if rng.random() > 0.05 else None))
    df = spark.createDataFrame(docs_, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lines, "read", lambda *_: df)
    got = {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_near"], r["n_links"], r["text_sha256"]) for r in lines.op3_line_dedup(spark, "").collect()}
    want = brute_lines(docs_)
    assert got == want and sum(x[2] for x in want.values()) > 10
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df.withColumn("dropped", F.lit("own")), drop_emptied=True).collect()}
    for d, t in docs_:
        lost = want[d][1] + want[d][2]
        if d in kept:
            assert sha(kept[d] or "") == want[d][4]
        else:
            assert lost and not lost < sum(bool(x.strip(WS)) for x in t.split("\n"))
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_within():
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choice("abé") for _ in range(rng.randrange(14))) for _ in range(2)) for _ in range(3000)]
    long = "".join(rng.choice("abcd") for _ in range(300))
    pairs += [(long, long[3:100] + "xy" + long[100:]), (long, long[4:100] + "xy" + long[100:]), ("", ""), ("é" * 70_000, "é" * 69_999)]
    said = pa.array([x for p in pairs for x in p])
    want = [lev(a, b) if len(a) < 1000 else 1 for a, b in pairs]
    for k in (1, 2, 3, 4, 5, 9):
        got = lines.within(*lines._padded(said, k), np.arange(0, len(said), 2), np.arange(1, len(said), 2), k)
        assert got.tolist() == [d <= k for d in want], k


def test_lines_of_odd_rows(spark):
    """Null ids, ids that repeat with other texts, rows that repeat, string ids, empty and very long texts, clashing names."""
    a, b = "the quick brown fox jumps over the lazy dog", "a line of other words that is long enough, too"
    rows = [(None, a), (2, a + "x"), (3, b), (3, b + "\n" + a + "y"), (3, b + "!"), (5, None), (6, ""), (7, "\n\n"), (8, "z" * 300_000), (9, "z" * 300_000 + "q"), (9, "z" * 300_000 + "q")]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(k if k is None else {"long": int, "string": str}[kind](k), t, "own") for k, t in rows], f"doc_id {kind}, text string, `dropped` string").repartition(3)
        got = collections.Counter((None if r["doc_id"] is None else int(r["doc_id"]), r["text"], r["dropped"]) for r in lines.dedup_lines(df).collect())
        # which of the three texts of id 3 comes first is the order of their hashes: one line near b stays, and b itself is near it or equal
        assert sum(got.values()) == len(rows)
        texts_ = collections.defaultdict(list)
        for (k, t, own), n in got.items():
            assert own == "own"
            texts_[k] += [t] * n
        assert texts_[None] == [""] and texts_[2] == [a + "x"] and texts_[5] == [None] and texts_[6] == [""] and texts_[7] == ["\n\n"]
        assert sorted("\n".join(texts_[3]).replace("\n", " ").split()) in (sorted(b.split()), sorted((b + "!").split()))
        assert texts_[8] == ["z" * 300_000] and texts_[9] == ["", ""]


@pytest.mark.parametrize("block", [lines.BLOCK, 3])
def test_op3_bands(spark, monkeypatch, block):
    """Changed words and other edits up to and past what each length allows, as the registered query and the pipeline use them."""
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(6)
    edits = lambda n: max((k for start, k in lines.BANDS if n >= start), default=0)
    base = ["".join(rng.choice("abcdefé ") for _ in range(n)) for n in (31, 33, 39, 41, 58, 62, 79, 84, 101, 104, 127, 130, 250)] + ["ab" * 60]
    docs_ = []
    for d in range(80):
        own = []
        for _ in range(rng.randrange(1, 5)):
            b = list(rng.choice(base))
            for _ in range(rng.randrange(5)):
                k, kind = rng.randrange(len(b)), rng.random()
                b[k : k + (kind > 0.3)] = [rng.choice("xyab")] * (kind < 0.7)
            own.append("".join(b).strip(WS))
        docs_.append((d, "\n".join(own)))
    first, near_ = {}, collections.defaultdict(set)
    for d, t in docs_:
        for i, x in enumerate(t.split("\n")):
            first.setdefault(x, (d, i))
    for a in first:
        for b in first:
            if a != b and len(a) <= len(b) and lev(a, b) <= edits(len(a)):
                near_[a].add(b)
                near_[b].add(a)
    want = {}
    for d, t in docs_:
        all_lines = list(enumerate(t.split("\n")))
        left = [x for i, x in all_lines if first[x] == (d, i) and not any(first[y] < (d, i) for y in near_[x])]
        want[d] = (sum(len(near_[x]) for _, x in all_lines), sha("\n".join(left)))
    df = spark.createDataFrame(docs_, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lines, "read", lambda *_: df)
    got = {r["doc_id"]: (r["n_links"], r["text_sha256"]) for r in registry.QUERIES["op3_line_dedup"](spark, "").collect()}
    assert got == want and sum(x[0] for x in want.values()) > 100


def test_a_large_batch_against_a_tiny_or_empty_snapshot(spark, monkeypatch):
    monkeypatch.setattr(exact, "KEYS_PER_FILTER", 500)
    for n in (0, 10):
        old = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
        new = spark.range(5, 20_005).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
        snapshot = exact.build_snapshot(old)
        assert snapshot.buckets == 1 and exact.parts_of_bucket(20_000, 1) == 40
        screened = exact.screen(exact.digests(new, "doc_id", "text").select("digest"), snapshot.filters, snapshot.buckets)
        assert max(n - 5, 0) <= screened.count() <= (400 if n else 0)
        out = exact.ingest_batch(new, snapshot)
        assert out.count() == 20_000 and out.filter("met").count() == max(n - 5, 0) and out.filter("kept").count() == 20_000 - max(n - 5, 0)


def test_lines_that_share_a_long_passage(spark, monkeypatch):
    """Keys crowded by one passage are refined by rare substrings: the same links as by brute force, and few pairs."""
    monkeypatch.setattr(lines, "BLOCK", 8)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    shared = [(0, word(60)), (1, word(70))]
    said = [x + word(45).strip() + "." if side == 0 else word(45).strip() + x for side, x in shared for _ in range(45)]
    for x in rng.sample(said, 30):
        b = list(x)
        for _ in range(rng.randrange(1, 8)):
            k, kind = rng.randrange(len(b)), rng.random()
            b[k : k + (kind > 0.3)] = [rng.choice("xyab")] * (kind < 0.7)
        said.append("".join(b).strip(WS))
    said = list(dict.fromkeys(x.strip(WS) for x in said))
    edits = lambda n: max((k for start, k in lines.BANDS if n >= start), default=0)

    def apart(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        a, b = a[n:][::-1], b[n:][::-1]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return lev(a[n:], b[n:])

    want = collections.Counter()
    for i, a in enumerate(said):
        for j, b in enumerate(said[:i]):
            if abs(len(a) - len(b)) <= 5 and apart(a, b) <= edits(min(len(a), len(b))):
                want.update((i, j))
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(3)
    refined, own = [], lines._refined

    def spied(members, *more):
        out = own(members, *more)
        refined.append((members.filter("blocks > 1").select("spot").distinct().count(), out.filter("mark IS NOT NULL").select("spot").distinct().count(), out.filter("mark IS NULL AND blocks > 1").count()))
        return out

    monkeypatch.setattr(lines, "_refined", spied)
    got = {r["doc_id"]: r["n_links"] for r in lines.line_decisions(df, bands=lines.BANDS).collect()}
    assert got == {i: want[i] for i in range(len(said))} and sum(want.values()) > 30
    assert refined[0][0] > 3 and refined[0][1] > 3 and refined[0][2] == 0


@pytest.mark.parametrize("bands", [((4, 1),), ((2, 1), (6, 2)), lines.BANDS])
def test_rare_substrings_of_near_lines_meet(bands):
    rng = random.Random(12)
    q, starts = lines._gram(bands), [start for start, _ in bands]
    assert all(start - q + 1 >= k * q + 1 for start, k in bands)
    rare = np.array([rng.randrange(50) for _ in range(lines.GRAM_BUCKETS)])
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.choice(starts) + rng.randrange(6)))
        b = list(a)
        for _ in range(int(lines.allowed(np.array(len(a)), bands))):
            k, kind = rng.randrange(len(b)), rng.random()
            b[k : k + (kind > 0.3)] = [rng.choice("abx")] * (kind < 0.7)
        pair = pa.array([a, "".join(b)])
        line, gram, again, sizes = lines._grams(pair, q)
        if sizes.min() < starts[0] or lev(a, "".join(b)) > lines.allowed(sizes.min(), bands):
            continue
        assert len(set(zip(line, gram, again))) == len(line) == (sizes - q + 1).sum()
        kept = []
        for n in (0, 1):
            all_ = sorted((rare[int(g) % lines.GRAM_BUCKETS], int(g), int(x)) for m, g, x in zip(line, gram, again) if m == n)
            kept.append(set(all_[: int(lines.allowed(sizes[n], bands)) * q + 1]))
        assert kept[0] & kept[1]


def test_lines_of_swapped_characters_stay(spark):
    texts = [w + tail for n in (1024, 2048, 4096) for w in hostile(n) for tail in ("", "\nthe same line", "x")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, bands=lines.BANDS).collect()}
    want, seen = {}, set()
    for i, t in enumerate(texts):
        kept = [x for x in t.split("\n") if x not in seen]
        seen |= set(kept)
        want[i] = "\n".join(kept)
    # a word and the word with one more character are near
    near_too = {i for i in want if texts[i].endswith("x")}
    assert {i: t for i, t in out.items() if i not in near_too} == {i: t for i, t in want.items() if i not in near_too}
    assert all(out[i] == "" for i in near_too)


# --- 4: exact dedup -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 20_000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    filter_ = exact.build_fuse(keys)
    assert exact.may_contain(keys, *filter_).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert exact.may_contain(others, *filter_).mean() < 0.006
    if n == 20_000:
        assert len(filter_[3]) * 8 / n < 11


def test_ingest(frame):
    t = ["a b", "ab", "a\tb ", None, "", " \n", "c", "C", "é" * 300_000, "é " * 300_000]
    df = frame(*t, *t, keep_id="taken")
    for old in (F.lit(False), F.lit(True), F.col("doc_id") < 7, F.xxhash64("doc_id") > 0):
        groups = collections.defaultdict(list)
        for i, x in enumerate([*t, *t]):
            groups[re.sub(f"[{WS}]", "", x or "")].append((-len(x or ""), i))
        out = {r["doc_id"]: r for r in exact.ingest(df, old, keys_per_filter=4).collect()}
        assert len(out) == 20
        for members in groups.values():
            for _, i in members:
                assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (min(members)[1], len(members), i == min(members)[1])
    assert exact.ingest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ingest_of_odd_ids(spark, kind):
    """Null ids, ids that repeat with equal and with other texts: as many rows as came in, one of each text kept."""
    to = {"long": int, "string": str}[kind]
    rows = [(None, "a b c"), (1, "abc"), (None, "abc"), (2, "x"), (2, "y"), (2, "x"), (3, "y "), (None, None), (4, ""), (None, "solo")]
    df = spark.createDataFrame([(k if k is None else to(k), t) for k, t in rows], f"doc_id {kind}, text string").repartition(3)
    for old in (F.lit(False), F.lit(True), F.length("text") < 2, F.col("doc_id").isNull()):
        out = exact.ingest(df, old).collect()
        assert collections.Counter(None if r["doc_id"] is None else int(r["doc_id"]) for r in out) == collections.Counter(k for k, _ in rows)
        assert sorted((r["digest"].hex(), r["group_size"]) for r in out if r["kept"]) == sorted((sha(t), n) for t, n in (("abc", 3), ("x", 2), ("y", 2), ("", 2), ("solo", 1)))
        keep = {r["digest"].hex(): r["keep_id"] for r in out}
        assert keep == {sha(t): k if k is None else to(k) for t, k in (("abc", None), ("x", 2), ("y", 3), ("", 4), ("solo", None))}


def test_snapshot_is_stored_and_read(spark, frame, tmp_path, monkeypatch):
    old = frame("a b", "c", "c ", None)
    exact.build_snapshot(old, keys_per_filter=1).write(str(tmp_path / "snapshot"))
    monkeypatch.setattr(exact, "build_filters", None)  # none is built again
    snapshot = exact.read_snapshot(spark, str(tmp_path / "snapshot"), old)
    for _ in range(2):
        batch = spark.createDataFrame([(10, "ab"), (11, "new"), (12, "ne w"), (13, " ")], "doc_id long, text string")
        out = {r["doc_id"]: (r["kept"], r["met"], r["keep_id"], r["group_size"]) for r in exact.ingest_batch(batch, snapshot).collect()}
        assert out == {10: (False, True, 0, 2), 11: (False, False, 12, 2), 12: (True, False, 12, 2), 13: (False, True, 3, 2)}
    assert exact.ingest_batch(batch.limit(0), snapshot).count() == 0


# --- 5: quality -----------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {r["doc_id"]: r["keep"] for r in quality.op5_quality(spark, sf).collect()}
    right = sum(out[d] == bool(q) for d, q in labels.items())
    assert right / len(labels) > 0.97
    good = [d for d, q in labels.items() if q]
    assert sum(out[d] for d in good) / len(good) > 0.99


def test_quality_edges(frame):
    df = frame(None, "", "few words", "plain words make this a text of some length, as one may see. " * 4, "word " * 400, "LOUD!! WORDS!! " * 60, score="taken", keep="taken")
    model, scorer = quality.train(df)
    out = {r["doc_id"]: r for r in quality.classify(df, model, scorer).collect()}
    assert all(out[i]["keep"] for i in (0, 1, 2)) and isinstance(out[0]["score"], float)
    empty = df.limit(0)
    assert quality.classify(empty, *quality.train(empty)).count() == 0


def test_label_model_finds_the_classes():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.8
    k = len(quality.LABELLERS)
    votes = np.full((5000, k), quality.NONE)
    for i in range(k):
        says = rng.random(5000) < 0.6
        wrong = rng.random(5000) < 0.1
        votes[says, i] = (truth ^ wrong)[says]
    patterns, counts = np.unique(quality._pattern(votes), return_counts=True)
    model = quality.fit_labels(patterns, counts)
    assert abs(model.good - 0.8) < 0.03
    assert ((model.posterior(quality._pattern(votes)) > 0.5) == truth).mean() > 0.95


def test_label_model_and_scorer_equal_plain_versions():
    rng = np.random.default_rng(2)
    k = len(quality.LABELLERS)
    patterns = np.unique(quality._pattern(rng.integers(0, 3, (60, k))))
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    digits = [[p // 3**i % 3 for i in range(k)] for p in patterns.tolist()]
    start = {quality.BAD: [0.88, 0.02, 0.10], quality.GOOD: [0.02, 0.88, 0.10]}
    share, said = 0.8, {c: [list(v) for _ in range(k)] for c, v in start.items()}

    def chances():
        out = []
        for d in digits:
            good, bad = share, 1 - share
            for i, v in enumerate(d):
                if v != quality.NONE:
                    good, bad = good * said[quality.GOOD][i][v], bad * said[quality.BAD][i][v]
            out.append(good / (good + bad))
        return out

    for _ in range(5):
        good = chances()
        for c, own in ((quality.GOOD, good), (quality.BAD, [1 - g for g in good])):
            for i in range(k):
                sums = [start[c][v] + sum(w * n for w, n, d in zip(own, counts, digits) if d[i] == v) for v in range(3)]
                said[c][i] = [x / sum(sums) for x in sums]
        share = (sum(g * n for g, n in zip(good, counts)) + 4) / (counts.sum() + 5)
    model = quality.fit_labels(patterns, counts, rounds=5)
    assert abs(model.good - share) < 1e-9 and np.allclose(model.posterior(patterns), chances(), atol=1e-9)

    scorer = quality.Scorer(rng.normal(size=quality.SIZE), 0.3)
    all_texts = ["plain words here", "", "ab", "$$$ LOUD!! ||", "é" * 20, "one two " * 40]
    data, offsets = flat(strings(pa.array(all_texts)))
    found = quality._measure(data, offsets)
    got = scorer.chance(data, offsets, found)
    for i, t in enumerate(all_texts):
        places = quality.hashed(*flat(strings(pa.array([t]))))
        places = [p for p in places.tolist() if p >= 0]
        assert len(places) == max(len(t.encode()) - 2, 0)
        tenth = sum(scorer.weights[(1 << quality.HASH_BITS) + 11 * j + min(int(found[m][i] * 10), 10)] for j, m in enumerate(quality.MEASURES))
        z = scorer.bias + sum(scorer.weights[p] for p in places) / max(len(places), 1) + quality.STRESS * tenth
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_of_other_junk(spark):
    """Texts of another make than the test tables': prose stays, markup soup, shouting, stutter and rows of signs go, short ones too."""
    rng = random.Random(13)
    words = ["".join(rng.choice("bdfklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    weights = [1 / (5 + i) for i in range(len(words))]
    prose = lambda n: " ".join(rng.choices(words, weights, k=n)).capitalize() + "."
    junk = [
        lambda n: " ".join(rng.choice(["<div>", "{x=1}", "&&nbsp;", "</p>", "word", "#tag#"]) for _ in range(n)),
        lambda n: " ".join(w.upper() + "!!" for w in prose(n).split()),
        lambda n: " ".join(w + " " + w for w in prose(n).split()),
        lambda n: " | ".join(prose(2) for _ in range(n)),
    ]
    rows = [(i, " ".join(prose(rng.randrange(6, 15)) for _ in range(rng.randrange(1, 20)))) for i in range(400)]
    rows += [(1000 + i, junk[i % 4](rng.randrange(25, 80))) for i in range(80)] + [(2000 + i, junk[i % 4](8)) for i in range(8)]
    rows += [(3000, "Thank you!"), (3001, "OK"), (3002, "bye bye"), (3003, None), (3004, "NASA"), (None, "a b"), (3000, "Thank you!")]
    df = spark.createDataFrame([(k, t, "own") for k, t in rows], "doc_id long, text string, label_good string")
    out = quality.classify(df, *quality.train(df)).collect()
    kept = [r["doc_id"] for r in out if r["keep"]]
    assert len(out) == len(rows) and sum(k is not None and k < 400 for k in kept) >= 396
    assert sum(k is not None and 1000 <= k < 2000 for k in kept) <= 4 and sum(k is not None and 2000 <= k < 3000 for k in kept) <= 3
    assert sorted((k for k in kept if k is None or k >= 3000), key=repr) == [3000, 3000, 3001, 3002, 3003, 3004, None]


def test_quality_sample_stays_small_on_the_driver(spark, monkeypatch):
    """The features of the sample come as packed bytes: no object for each of them in the driver, which has to hold them all."""
    import tracemalloc

    rng = random.Random(14)
    texts = ["".join(rng.choices("abcdefghij klmnop\u00e9", k=4000)) for _ in range(150)] + ["<{#&" * 300] * 50 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, own = [], quality._sample

    def traced(*args):
        tracemalloc.start()
        try:
            seen.append(own(*args))
            seen.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
        return seen[0]

    monkeypatch.setattr(quality, "_sample", traced)
    quality.train(df)
    (rows, good), most = seen
    assert len(rows) == len(good) > 100
    for places, shares in rows:  # as they were: places of trigrams and tenths, shares that sum up to one and the tenths' weight
        assert len(places) == len(shares) and max(places) < quality.SIZE
        assert abs(sum(shares) - 1 - quality.STRESS * len(quality.MEASURES)) < 1e-3
    n = sum(len(places) for places, _ in rows)
    assert n > 100_000 and most < 20 * n


# --- 6: secrets -----------------------------------------------------------------------------------------------------


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(x):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(x) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_base(frame):
    rng = random.Random(4)
    bits = ["password", "Token", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh", "a1b2", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é漢🙂", "\n", "secret:", "x" * 9]
    texts_ = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)] + [None, "", "token=" + "z" * 9, "0a" * 50_000, "a\ud7ffb token=abcdefgh9 " * 700]
    out = {r["doc_id"]: r for r in secrets.scan(frame(*texts_, base="taken", spans="taken")).collect()}
    for i, x in enumerate(texts_):
        assert [tuple(s) for s in out[i]["base"]] == base_spans(x or ""), x
        assert set(map(tuple, out[i]["base"])) <= set(map(tuple, out[i]["spans"]))
    assert secrets.scan(frame("x").limit(0)).count() == 0


def brute_spans(x):
    """All spans: base ones, and by class the stretch of the windows whose entropy, counted anew for each, is high enough."""
    import math

    out, kinds = base_spans(x), [*secrets.BASE, *secrets.ENTROPY]
    allowed = re.compile(secrets.ALLOWED)
    for kind, (pattern, least) in secrets.ENTROPY.items():
        for m in re.finditer(pattern, x):
            if allowed.match(m[1]):
                continue
            w = secrets.WINDOW
            hot = [s for s in range(len(m[1]) - w + 1) if -sum(c / w * math.log2(c / w) for c in collections.Counter(m[1][s : s + w]).values()) >= least - 1e-9]
            if hot:
                found = m[1][hot[0] : hot[-1] + w]
                if len(re.findall(secrets.PLACEHOLDER, found)) * secrets.PER_WORD < len(found):
                    out.append((m.start() + hot[0], kinds.index(kind), m.start() + hot[-1] + w, kind))
    return sorted(out)


def test_secret_entropy(frame):
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "aB1="]
    rng = random.Random(6)
    texts_ = [rng.choice(["", "KEY=", "é/", "a b "]) + "".join(rng.choice(a) for _ in range(rng.randrange(20, 70))) + rng.choice(["", "=", " z"]) for a in alphabets for _ in range(60)]
    texts_ += ["a" * 60 + "1B", "123e4567-e89b-12d3-a456-426614174000", "1" * 40, "exampleKey0aB1cD2eF3gH4iJ5kL6", "JBSWY3DPEHPK3PXPGEZDGNBVGY3TQOJQ", "docs/example/some/Zx81kLqP04mNvT73aYwE"]
    out = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(*texts_)).collect()}
    hits = collections.Counter()
    for i, x in enumerate(texts_):
        assert [tuple(s) for s in out[i]] == brute_spans(x), x
        hits.update(s["kind"] for s in out[i])
    assert all(hits[k] > 10 for k in secrets.ENTROPY)
    assert not any(s["kind"].startswith("entropy") for i in (301, 302, 303) for s in out[i]) and out[304]


def test_secrets_of_very_long_candidates(frame):
    """A million characters of every branch of the allow-list, and near misses, end in time and without deep recursion."""
    rng = random.Random(7)
    hot = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(50_000))
    long = ["1" * 1_000_000, "ab-" * 330_000 + "c1", "/" + "ab/" * 330_000 + "c", "abcdefg1" * 125_000, "x" * 200_000 + "-1", "ab-" * 60_000 + "c1x!", hot]
    out = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(*long)).collect()}
    assert not any(s["kind"].startswith("entropy") for i in range(6) for s in out[i])
    assert [tuple(s) for s in out[6]] == brute_spans(hot)


def test_op6(spark, monkeypatch):
    rng = random.Random(8)
    bits = ["password=", "token: ", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é ", "\n", "9f86d081884c7d659a2feaa0c55ad015", "Zx81kLqP04mNvT73aYwE", "/", "=", "x"]
    texts_ = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(200)] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts_)] + [(3, texts_[3]), (None, "token=abcdefgh1")]
    monkeypatch.setattr(secrets, "read", lambda *_: spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((tuple(r) for r in secrets.op6_secret_scan(spark, "").collect()), key=repr)
    want = []
    for i, t in rows:
        base, spans = base_spans(t or ""), brute_spans(t or "")
        text_of = lambda found: ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        want.append((i, *(sum(s[3] == k for s in base) for k in ("assign", "access", "hex")), sha(text_of(base)), text_of(spans)))
    assert got == sorted(want, key=repr) and sum("entropy" in w[5] for w in want) > 50


def test_secret_hex_after_a_name(frame):
    value = "9F86D081884C7D659A2FEAA0C55AD015"
    heads = ["SIGNING_KEY=", "keys/", "sk_", "sk-", "key: "]
    out = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(*[h + value for h in heads], "A" + value, "+" + value)).collect()}
    for i, h in enumerate(heads):
        assert ("entropy_hex", len(h), len(h) + len(value)) in {(s["kind"], s["start"], s["end"]) for s in out[i]}
    assert any(s["kind"] == "entropy_hex" and s["start"] == 0 for s in out[5]) and not any(s["kind"] == "entropy_hex" for s in out[6])


def test_redact_secrets(frame):
    out = secrets.redact(frame("my token=abcdefgh1 ok", None, "clean", spans="own"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "my [secret] ok", 1: "", 2: "clean"}


# --- 7: near duplicates ---------------------------------------------------------------------------------------------


def plain_shingles(t, k):
    w = re.findall(f"[^{WS}]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def hostile(n):
    """A word of n characters (a power of two) and the one with its two characters swapped: sums of powers modulo 2 ** 64 can't tell them apart from 1,024 on."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def brute_near(docs_, words):
    sets = [plain_shingles(t, words) for _, t in docs_]
    holders, parent = collections.defaultdict(list), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        met = collections.Counter(j for x in s for j in holders[x])
        for j, k in met.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    low = {}
    for i, (d, _) in enumerate(docs_):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)] if len(sets[i]) else d) for i, (d, _) in enumerate(docs_)}


def test_shingles():
    plain = plain_shingles
    rng = random.Random(7)
    all_texts = [" ".join(rng.choice(["A", "a", "b", "É", "é", "cc", "\t", ""]) for _ in range(rng.randrange(12))) for _ in range(500)] + ["", " ", "x", "xy", "x y"]
    sets = near.shingle_sets(*flat(strings(pa.array(all_texts))), 4)
    names = {}
    for t, s in zip(all_texts, sets):
        assert len(s) == len(plain(t, 4))
        assert names.setdefault(frozenset(plain(t, 4)), s.tobytes()) == s.tobytes()
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("words", [4, 5])
def test_few_words_alone_in_a_partition(spark, words):
    few = [(n, " ".join(f"w{n}{i}" for i in range(n))) for n in range(7)]
    for n, text in few:
        (only,) = near.shingle_sets(*flat(strings(pa.array([text]))), words)
        assert len(only) == (max(n - words + 1, 1) if n else 0)
    df = spark.createDataFrame(spark.sparkContext.parallelize(few, len(few)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.keep_one(df, words=words).collect()) == list(range(7))


@pytest.mark.parametrize("crowd", [2, 64])
def test_near_duplicates(spark, monkeypatch, crowd):
    monkeypatch.setattr(near, "CROWD", crowd)
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(4)]
    docs_ = [(0, None), (1, ""), (2, "one"), (3, "ONE "), (4, "two words")]
    for d in range(5, 200):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        docs_.append((d, " ".join(words)))
    docs_ += [(200, docs_[9][1]), (201, docs_[9][1] + " \n")]
    df = spark.createDataFrame(docs_, "doc_id long, text string").repartition(4)
    out = near.near_duplicates(df.withColumn("component_id", F.lit("own")), words=4).collect()
    want = brute_near(docs_, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want and len({c for _, c in want.values()}) > 10
    kept = near.keep_one(df, words=4)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert near.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_of_odd_ids(spark, kind):
    """Null ids and ids that repeat with other texts lose no link; one row of each group stays."""
    to = {"long": int, "string": str}[kind]
    words = [f"w{i}" for i in range(60)]
    a, a2, z, z2 = " ".join(words), " ".join(words[:-2]), " ".join(words[::-1]), " ".join(words[::-1][:-2])
    rows = [(1, a), (1, z), (2, a2), (3, z2), (None, a2), (None, z2 + " more"), (None, None), (4, ""), (4, ""), (5, "one two"), (5, "one two"), (None, "seul"), (6, "x " * 150_000)]
    df = spark.createDataFrame([(k if k is None else to(k), t, "own") for k, t in rows], f"doc_id {kind}, text string, kept string").repartition(3)
    got = collections.Counter((r["doc_id"] and int(r["doc_id"]), r["n_shingles"] > 0, r["component_id"] and int(r["component_id"])) for r in near.near_duplicates(df, words=4).collect())
    assert got == collections.Counter({(1, True, 1): 2, (2, True, 1): 1, (3, True, 1): 1, (None, True, 1): 2, (None, False, None): 1, (4, False, 4): 2, (5, True, 5): 2, (None, True, None): 1, (6, True, 6): 1})
    left = sorted(((r["doc_id"] and int(r["doc_id"]), r["text"], r["kept"]) for r in near.keep_one(df, words=4).collect()), key=repr)
    assert left == sorted([(1, a, "own"), (1, z, "own"), (None, None, "own"), (4, "", "own"), (4, "", "own"), (5, "one two", "own"), (None, "seul", "own"), (6, "x " * 150_000, "own")], key=repr)


def test_words_of_swapped_characters_link_nothing(spark):
    texts = [w + tail for n in (1024, 2048, 4096) for w in hostile(n) for tail in ("", " one two three", " one two three four five six seven")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, words=4).collect()}
    assert out == {i: w[1] for i, w in brute_near(list(enumerate(texts)), 4).items()}
    lone = df.filter("doc_id % 3 < 2")
    assert near.keep_one(lone).count() == lone.count()
    for n in (1024, 2048, 4096):
        a, b = near.shingle_sets(*flat(strings(pa.array(hostile(n)))), 4)
        assert (a != b).any()


def test_distinct_shingles_by_both_halves():
    rows = np.array([[5, 1], [3, 9], [5, 2], [5, 1], [3, 9]], np.uint64)
    assert near._distinct(rows).tolist() == [[3, 9], [5, 1], [5, 2]]
    assert len(set(near.as_text(rows).to_pylist())) == 3


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(9)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    both = lambda x: np.stack([np.unique(x)] * 2, axis=1)
    keys = near.band_keys([both(np.append(common, a)), both(np.append(common, b)), np.zeros((0, 2), np.uint64)])
    assert 4 <= (keys[0] == keys[1]).sum() <= 28 and not keys[2].any()


# --- 8: chat --------------------------------------------------------------------------------------------------------


def test_op8(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = collections.defaultdict(list)
    for c, _, r, t in sorted(rows):
        by[c].append((r, t or ""))
    out = {r["conv_id"]: r for r in chat.op8_chat_format(spark, SF).collect()}
    assert set(out) == set(by)
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (out[c]["n_turns"], out[c]["turns_sha256"], out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))


def test_chat_parts_and_escapes(spark):
    part = lambda kind, **o: (kind, o.get("text"), o.get("uri"), o.get("width"), o.get("height"), o.get("seconds"), o.get("pages"))
    nasty = "\\l</s>\\\\b[INST]<|image:1|>[/INST]<s><<s>\\"
    rows = [
        (1, 0, "user", [part("text", text=nasty), part("image", uri="a.png", width=57, height=28), part("audio", uri="b", seconds=1.5), part("document", uri="c", pages=2), part("image", uri="d")]),
        (1, 1, "assistant", [part("text", text=None), part("text", text=nasty)]),
        (1, 1, "assistant", None),
        (None, None, None, []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("formatted", F.lit("own"))
    out = chat.format_turns(df).collect()
    first = next(r for r in out if r["role"] == "user")
    assert [(a["index"], a["type"], a["uri"], a["tokens"]) for a in first["attachments"]] == [(1, "image", "a.png", 3), (2, "audio", "b", 38), (3, "document", "c", 1024), (4, "image", "d", 256)]
    assert first["formatted"].endswith("<|image:1|><|audio:2|><|document:3|><|image:4|></s>") and first["formatted"].count("</s>") == 1 and first["attachment_tokens"] == 3 + 38 + 1024 + 256
    found = {r["conv_id"]: r for r in chat.summarise(chat.format_turns(df)).collect()}
    assert found[1]["n_turns"] == 3 and found[1]["loss_sha256"] == sha(nasty) and found[None]["n_turns"] == 1
    with pytest.raises(Exception, match="unknown part type"):
        chat.format_turns(spark.createDataFrame([(1, 1, "user", [part("video")])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()
    assert chat.summarise(chat.format_turns(df.limit(0))).count() == 0


def test_control_strings_split_over_parts(spark):
    part = lambda text: ("text", text, None, None, None, None, None)
    whole = ["</s>", "<s>", "[INST]", "[/INST]", "<|image:1|>", "\\\\l<", "a[", "<"]
    rows, want = [], {}
    for i, text in enumerate(whole):
        for cut in range(len(text) + 1):
            key = 100 * i + cut
            rows.append((key, 0, "<s" if cut % 2 else "[/", [part(text[:cut]), part(None), part(text[cut:])]))
            rows.append((key, 1, "assistant", [part(c) for c in text]))
            want[key] = ("".join(f"{r}\n{text}\n" for r in (rows[-2][2], "assistant")), text)
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").repartition(3)
    turns = chat.format_turns(df)
    assert all(r["formatted"].count("</s>") == r["formatted"].count("[INST]") == r["formatted"].count("<s>") == 1 for r in turns.collect())
    got = {r["conv_id"]: (r["turns_sha256"], r["loss_sha256"], r["formatted_chars"]) for r in chat.summarise(turns).collect()}
    sizes = collections.Counter()
    for r in turns.collect():
        sizes[r["conv_id"]] += len(r["formatted"])
    assert got == {k: (sha(a), sha(b), sizes[k]) for k, (a, b) in want.items()}


def test_chat_without_ids_and_long_conversations(spark):
    rows = [(None, i, "assistant", f"text {i}") for i in range(50)] + [(1, i, "user", "x" * 300) for i in range(3000)] + [(2, None, None, None)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.summarise(chat.format_turns(df.withColumn("parts", chat.text_part(F.col("text"))))).collect()
    alone = [r for r in out if r["conv_id"] is None]
    assert sorted(r["loss_sha256"] for r in alone) == sorted(sha(f"text {i}") for i in range(50)) and {r["n_turns"] for r in alone} == {1}
    rest = {r["conv_id"]: r for r in out if r["conv_id"] is not None}
    assert rest[1]["turns_sha256"] == sha(("user\n" + "x" * 300 + "\n") * 3000) and rest[2]["n_turns"] == 2 and len(rest) == 2


# --- 9: sharding ----------------------------------------------------------------------------------------------------


def test_sharding(frame):
    import zlib

    texts_ = [None, "", "é"] + [f"text {i % 50}" for i in range(997)]
    out = sharding.shard_rows(frame(*texts_, shard="own")).collect()
    counts = collections.Counter(r["shard"] for r in out)
    assert len(out) == 1000 and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(40))
    for s in range(40):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    for r in out:
        data = (texts_[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    assert sharding.shard_rows(frame("x").limit(0)).count() == 0
    few = sharding.shard_rows(frame("a", "b", "b")).collect()
    assert len({(r["shard"], r["slot"]) for r in few}) == 3


def test_ring_moves_little():
    owners = [s for _, s in sharding.ring(40, 64, 16)]
    counts = {arc: 25 for arc in range(len(owners))}
    taken = sharding.ranges(counts, owners, 40)
    own = sum(b - a for arc, a, b, s, _ in taken if owners[arc] == s)
    assert sum(b - a for _, a, b, _, _ in taken) == 25 * len(owners) and own / (25 * len(owners)) > 0.9


def brute_shards(rows, shards, virtual, ring_bits):
    """The shard of each key (id, text): keys in ring order take their arc's shard as far as its share goes, then overflow clockwise, arc by arc."""
    import zlib

    nodes = sharding.ring(shards, virtual, ring_bits)
    keys = collections.defaultdict(list)
    for (key, text), h in rows:
        place = (h % (1 << 64)) >> (64 - ring_bits)
        arc = next((i for i, (slot, _) in enumerate(nodes) if slot >= place), 0)
        crc = zlib.crc32((text or "").encode())
        keys[arc].append((crc % sharding.CELLS, h, key, crc))
    free = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    out, over = {}, []
    for arc, (_, shard) in enumerate(nodes):
        for k in sorted(keys[arc]):
            if free[shard]:
                free[shard] -= 1
                out[k[2]] = shard
            else:
                over.append((arc, k[2]))
    for arc, key in over:
        shard = next(s for s in (nodes[(arc + step) % len(nodes)][1] for step in range(1, len(nodes))) if free[s])
        free[shard] -= 1
        out[key] = shard
    return out


def test_shards_equal_a_plain_ring(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text")).repartition(3)
    hashes = [((r["doc_id"], r["text"]), r["h"]) for r in df.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).collect()]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(df, shards=7, virtual=16, ring_bits=10).collect()}
    assert got == brute_shards(hashes, 7, 16, 10)


@pytest.mark.parametrize("crowd_rows", [20, sharding.CROWD_ROWS])
def test_shards_of_hot_keys(spark, crowd_rows):
    """A third of the rows has no id, a third repeats one row: counts stay one apart, slots without gaps, and hot cells are cut."""
    rows = [(None, f"t{i}") for i in range(600)] + [(5, "same")] * 600 + [(i, None) for i in range(600)] + [(-1, "x" * 500_000)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), crowd_rows=crowd_rows).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(k for k, _ in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 40 and {len(v) for v in slots.values()} <= {45, 46} and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_one_more_shard_moves_little(spark):
    """From 40 to 41 shards a plain ring moves one key in 41; bounded loads may move as many again, not more."""
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    a, b = (sharding.shard_rows(df, shards=n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (40, 41))
    both = a.join(b, "doc_id")
    moved, between = both.agg(F.avg((F.col("s40") != F.col("s41")).cast("int")), F.avg(((F.col("s40") != F.col("s41")) & (F.col("s41") != 40)).cast("int"))).first()
    assert 1 / 41 * 0.9 < moved < 0.08 and between < 0.055


# --- 10: decontamination --------------------------------------------------------------------------------------------


def brute_leaks(docs_, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or ""))
    grams = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            grams[tuple(w[k : k + 10])].add(i)
    out = {}
    for d, t in docs_:
        w, hit, found = split(t), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    found.update(str(x) for x in grams[g] if x is not None)
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("most", [0, 48 << 20])
def test_decontamination(spark, frame, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    rng = random.Random(10)
    some = lambda n: " ".join(rng.choice(["A", "b", "É", "é", "c-d", "7", "x,"]) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 5, 9, 10, 12, 30]))) for i in range(1, 12)] + [(20, None), (21, "?!"), (None, some(11)), (22, "solo")]
    texts_ = [some(rng.randrange(60)) for _ in range(60)] + [None, "", "... ", "Solo", items[0][1].upper() + " " + items[1][1]] + ["pad " * 3000 + items[2][1]] * 2
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.contamination(frame(*texts_, items="own", n_hit="own"), bench).collect()}
    want = brute_leaks(list(enumerate(texts_)), items)
    assert got == want and any(x[1] for x in want.values()) and not all(x[1] for x in want.values())
    left = {r["doc_id"] for r in decontaminate.remove_contaminated(frame(*texts_), bench).collect()}
    assert left == {d for d, x in want.items() if not x[1]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(frame(*texts_), bench).collect()}
    assert all(cut[d] == texts_[d] if not x[1] else len(cut[d].split()) == x[0] - x[1] for d, x in want.items())
    assert {r["n_hit"] for r in decontaminate.contamination(frame("a b"), bench.limit(0)).collect()} == {0}
    assert decontaminate.contamination(frame("a").limit(0), bench).count() == 0


def test_decontamination_of_odd_rows(spark):
    """Null and repeated ids are judged by their own texts; very long words and texts are whole."""
    item = " ".join(["w" * 200_000, *(f"b{i}" for i in range(11))])
    rows = [(None, "x " + item), (None, "clean"), (1, item), (1, "clean too"), (2, "word " * 100_000 + item + " tail"), (3, None), (3, None)]
    df = spark.createDataFrame([(k, t, "own") for k, t in rows], "doc_id long, text string, spans string").repartition(3)
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontaminate.contamination(df, bench).filter("doc_id IS NOT NULL").collect()) == [(1, 2, 0), (1, 12, 12), (2, 100_013, 12), (3, 0, 0), (3, 0, 0)]
    left = sorted(((r["doc_id"], r["text"], r["spans"]) for r in decontaminate.remove_contaminated(df, bench).collect()), key=repr)
    assert left == sorted([(None, "clean", "own"), (1, "clean too", "own"), (3, None, "own"), (3, None, "own")], key=repr)
    cut = sorted(((r["doc_id"], r["text"] and r["text"][-9:]) for r in decontaminate.remove_spans(df, bench).collect()), key=repr)
    assert cut == sorted([(None, "x"), (None, "clean"), (1, ""), (1, "clean too"), (2, "word tail"), (3, None), (3, None)], key=repr)


# --- the native operators' plans --------------------------------------------------------------------------------------


@pytest.mark.parametrize("query", [secrets.op6_secret_scan, sharding.op9_sharding, decontaminate.op10_decontamination])
def test_native_plans_hold_no_python(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
