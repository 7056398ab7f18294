"""A quality classifier from weak labels.

Heuristic labellers look at counts of each text and vote good, bad or nothing. Expectation-maximisation over the
counts of vote patterns (all documents; at most 3 ** labellers patterns, whatever the input) estimates how often each
labeller votes what on good and on bad documents, without any given labels. Posteriors of a bounded sample then train
a hashed linear scorer, which judges every document by its whole text.

In texts under MIN_WORDS words repetition says nothing, and shares are of a text of some length at least, so that one
mark in a few words is none of much; such a text is rejected only if the votes and the scorer agree. Texts without
words, null and empty ones among them, give no evidence: they get no votes, score as the prior and are kept. Texts may
be of any length. Rows are judged one by one, so repeated rows and ids, null ids too, get equal results; the sample is
ordered by the key's hash, then the key, and of rows that tie any may be in it. Outputs take the place of columns of
their names, other columns stay. An empty table trains nothing and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import chunks, flat, read, replacing, saved, strings, tidy
from tabwright.llm.near import word_hashes

#: Rows of each class (by posterior) that train the scorer, and its hash space. They bound what reaches the driver:
#: at most 2 * SAMPLE sparse vectors of up to 2 ** HASH_BITS counts, packed (PLACE and SHARE, six bytes a count).
SAMPLE, HASH_BITS = 1_500, 14
EPOCHS, RATE, DECAY = 400, 2.0, 1e-5
#: A document is rejected if it is bad with at least this chance.
REJECT_AT = 0.5

GOOD, BAD, NONE = 1, 0, 2


@dataclass(frozen=True)
class Labeller:
    """Votes BAD at or above ``bad``, GOOD below ``good`` of the measure (None: never)."""

    name: str
    measure: str
    bad: float | None
    good: float | None


#: Shares of characters or words; words below which repetition doesn't count, and the least words, characters that aren't
#: space, and ASCII letters that shares are taken of. Each kind of junk is the matter of two or more labellers; a
#: labeller of one kind has nothing to say about the others, so only the last two ever vote GOOD.
MIN_WORDS, LEAST_WORDS, LEAST_SOLID, LEAST_LETTERS = 20, 10, 50, 20
LABELLERS = (
    Labeller("symbols", "symbol_share", 0.10, None),
    Labeller("shouting", "upper_share", 0.50, None),
    Labeller("bangs", "bang_share", 0.20, None),
    Labeller("pipes", "pipe_share", 0.20, None),
    Labeller("repeats", "repeat_share", 0.45, None),
    Labeller("adjacent", "adjacent_share", 0.10, None),
    Labeller("marks", "mark_share", 0.08, 0.02),
    Labeller("oddness", "oddness", 1.0, 0.5),
)


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of texts that lie side by side, from byte classes and word hashes."""
    n = len(offsets) - 1
    sums = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
    classes = _BYTE_CLASS[data]
    solid = np.maximum(sums(classes != _SPACE), LEAST_SOLID)
    hashes, at = word_hashes(data, offsets)
    own = np.diff(at)
    words = np.maximum(own, LEAST_WORDS)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[at[:-1][at[:-1] < len(hashes)]] = False
    word_sums = lambda mask: np.diff(np.append(0, np.cumsum(mask))[at])
    distinct = np.fromiter((len(np.unique(hashes[a:b])) for a, b in zip(at[:-1], at[1:])), np.int64, n)
    # a long text repeats common words by nature: compare with how many distinct words its length lets expect
    expected = np.minimum(words, 12.0 * words**0.6)
    upper, lower = sums(classes == _UPPER), sums(classes == _LOWER)
    marks = sums(np.isin(classes, [_SYMBOL]) | (data == 33) | (data == 124)) / solid
    out = {
        "mark_share": marks,
        "symbol_share": sums(classes == _SYMBOL) / solid,
        "upper_share": upper / np.maximum(upper + lower, LEAST_LETTERS),
        "bang_share": sums(data == 33) / words,
        "pipe_share": sums(data == 124) / words,
        "repeat_share": np.where(own < MIN_WORDS, 0, np.clip(1 - distinct / expected, 0, 1)),
        "adjacent_share": word_sums(same) / np.maximum(own, MIN_WORDS),
    }
    # how far the text is along towards the nearest bad end: 1 is there
    out["oddness"] = np.max([out[x.measure] / x.bad for x in LABELLERS if x.measure in out], axis=0)
    return out | {"words": own}


_SPACE, _SYMBOL, _UPPER, _LOWER, _REST = range(5)
_BYTE_CLASS = np.full(256, _REST, np.uint8)
_BYTE_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_BYTE_CLASS[list(b"#$%&*@^~<>{}\\=_+")] = _SYMBOL
_BYTE_CLASS[65:91] = _UPPER
_BYTE_CLASS[97:123] = _LOWER


def votes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, labellers) of GOOD, BAD, NONE."""
    return _votes(_measure(data, offsets))


def _votes(found: dict[str, np.ndarray]) -> np.ndarray:
    out = np.full((len(found["words"]), len(LABELLERS)), NONE, np.int8)
    for i, one in enumerate(LABELLERS):
        x = found[one.measure]
        if one.good is not None:
            out[x < one.good, i] = GOOD
        if one.bad is not None:
            out[x >= one.bad, i] = BAD
    out[found["words"] == 0] = NONE
    return out


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1]))


def vote_patterns(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and pattern (the votes as digits to the base 3)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column(text))
            for a, b in chunks(column):
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), pa.array(_pattern(votes_of(*flat(column.slice(a, b - a)))), pa.int64())], names=[key, "pattern"])

    return df.select(key, text).mapInArrow(tidy(run), f"`{key}` {kind}, pattern long")


@dataclass
class LabelModel:
    """The chance of a good document, and of each vote (last axis) of each labeller (middle) given bad or good (first)."""

    good: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that documents with these vote patterns are good. Abstaining says nothing."""
        digits = patterns[:, None] // 3 ** np.arange(self.votes.shape[1]) % 3
        odds = np.full(len(patterns), np.log(self.good / (1 - self.good)))
        for i in range(self.votes.shape[1]):
            ratio = np.log(self.votes[1, i] / self.votes[0, i])
            ratio[NONE] = 0.0
            odds += ratio[digits[:, i]]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns with their counts. It starts from labellers that are right 9 times in 10, which fixes which class is which."""
    k = len(LABELLERS)
    digits = patterns[:, None] // 3 ** np.arange(k) % 3
    start = np.array([[0.88, 0.02, 0.10], [0.02, 0.88, 0.10]])
    model = LabelModel(0.8, np.repeat(start[:, None, :], k, axis=1))
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * counts, good * counts])
        votes = np.stack([[np.bincount(digits[:, i], w, 3) for i in range(k)] for w in weight]) + start[:, None, :]
        votes /= votes.sum(2, keepdims=True)
        share = (weight[1].sum() + 4) / (counts.sum() + 5)
        moved = abs(share - model.good)
        model = LabelModel(float(np.clip(share, 1e-6, 1 - 1e-6)), votes)
        if moved < 1e-10:
            break
    return model


def hashed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the byte trigrams in the hash space; trigrams that reach into the next text are -1. Digits hash alike."""
    if len(data) < 3:
        return np.full(len(data), -1, np.int64)
    x = _FOLD[data].astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    out = np.append((h >> np.uint32(32 - HASH_BITS)).astype(np.int64), [-1, -1])
    for back in (1, 2):
        at = offsets[1:] - back
        out[at[at >= offsets[:-1]]] = -1
    return out


def tenths(found: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, measures): places after the trigrams' hash space, one for each tenth of each measure."""
    return np.stack([(1 << HASH_BITS) + 11 * i + np.clip(found[m] * 10, 0, 10).astype(np.int64) for i, m in enumerate(MEASURES)], axis=1)


#: What the scorer sees besides trigrams, and how much one of these places counts against a share of trigrams.
MEASURES = ("mark_share", "symbol_share", "upper_share", "bang_share", "pipe_share", "repeat_share", "adjacent_share")
SIZE, STRESS = (1 << HASH_BITS) + 11 * len(MEASURES), 0.2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[48:58] = 48
#: How places and shares of the sample are packed into bytes. As arrays they would be objects, one by one, in the driver's JVM and Python.
PLACE, SHARE = np.dtype("<u2"), np.dtype("<f4")
assert SIZE <= 1 << 16


@dataclass
class Scorer:
    """score = bias + mean weight of the trigrams + weights of the measures' tenths; the chance of good is its logistic function."""

    weights: np.ndarray
    bias: float

    def chance(self, data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray]) -> np.ndarray:
        places = hashed(data, offsets)
        w = np.append(self.weights, 0.0)
        sums = np.diff(np.append(0.0, np.cumsum(w[places]))[offsets])
        n = np.diff(np.append(0, np.cumsum(places >= 0))[offsets])
        more = STRESS * self.weights[tenths(found)].sum(1)
        return 1 / (1 + np.exp(-np.clip(self.bias + sums / np.maximum(n, 1) + more, -50, 50)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, prior: float) -> Scorer:
    """Logistic regression on trigram shares (scaled by the root of how rare they are) with soft targets; classes weigh alike."""
    size = SIZE
    index = np.concatenate([i for i, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    scale = 1 / np.sqrt(np.bincount(index, value, size) / max(len(rows), 1) + 1e-4)
    scale[1 << HASH_BITS :] = 1.0
    work = np.empty(len(index))  # one array for all products
    value *= np.take(scale, index, out=work, mode="clip")
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not len(rows) or good.min() > REJECT_AT or good.max() < REJECT_AT:
        return Scorer(weights, bias)  # one class alone: nothing to tell apart
    each = np.where(good >= 0.5, 0.5 / max((good >= 0.5).sum(), 1), 0.5 / max((good < 0.5).sum(), 1))
    bias, speed, speed_b = 0.0, np.zeros(size), 0.0
    for _ in range(EPOCHS):
        np.multiply(value, np.take(weights, index, out=work, mode="clip"), out=work)
        chance = 1 / (1 + np.exp(-np.clip(np.bincount(row, work, len(rows)) + bias, -50, 50)))
        error = (chance - good) * each
        np.multiply(value, np.take(error, row, out=work, mode="clip"), out=work)
        speed = 0.9 * speed + np.bincount(index, work, size) + DECAY * weights
        speed_b = 0.9 * speed_b + error.sum()
        weights, bias = weights - RATE * speed, bias - RATE * speed_b
    return Scorer(weights * scale, bias)


def _sample(df: DataFrame, voted: DataFrame, patterns: np.ndarray, key: str, text: str, model: LabelModel, size: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The features and posteriors of at most ``size`` documents of each class that the votes are sure of, by the smallest hash of the key."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column(text))
            for a, b in chunks(column):
                data, offsets = flat(column.slice(a, b - a))
                found = _measure(data, offsets)
                places, index, value = hashed(data, offsets), [], []
                for x, y, more in zip(offsets[:-1], offsets[1:], tenths(found)):
                    own = places[x:y]
                    i, n = np.unique(own[own >= 0], return_counts=True)
                    index.append(np.append(i, more).astype(PLACE).tobytes())
                    value.append(np.append(n / max(n.sum(), 1), np.full(len(more), STRESS)).astype(SHARE).tobytes())
                good = model.posterior(_pattern(_votes(found)))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), pa.array(good), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=[key, "good", "index", "value"])

    texts, chance, picked = df.select(key, text), model.posterior(patterns), None
    for sure in (patterns[chance > 0.9], patterns[chance < 0.1]):
        own = voted.filter(F.col("pattern").isin(sure.tolist())).orderBy(F.xxhash64(key), key).limit(size).select(F.col(key).alias("_key"))
        picked = own if picked is None else picked.unionByName(own)
    rows = texts.join(F.broadcast(picked.distinct()), texts[key] == F.col("_key"), "left_semi").mapInArrow(tidy(run), f"`{key}` {kind}, good double, index binary, value binary").orderBy(F.xxhash64(key), key).limit(4 * size).collect()
    return [(np.frombuffer(r["index"], PLACE), np.frombuffer(r["value"], SHARE)) for r in rows], np.array([r["good"] for r in rows])


def train(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The label model over all rows of ``df`` and the scorer from its posteriors."""
    voted = saved(vote_patterns(df, key, text))
    counted = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    patterns = np.array([r["pattern"] for r in counted], np.int64)
    model = fit_labels(patterns, np.array([r["n"] for r in counted], np.float64))
    rows, good = _sample(df, voted, patterns, key, text, model, sample)
    return model, fit_scorer(rows, good, model.good)


def classify(df: DataFrame, model: LabelModel, scorer: Scorer, text: str = "text") -> DataFrame:
    """Adds label_good (posterior of the votes), score (the scorer's chance of good) and keep, in the place of columns of these names."""
    df = replacing(df, ["label_good", "score", "keep"])
    schema = T.StructType([*df.schema.fields, T.StructField("label_good", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column(text))
            for a, b in chunks(column):
                data, offsets = flat(column.slice(a, b - a))
                part = batch.slice(a, b - a)
                found = _measure(data, offsets)
                score, voted = scorer.chance(data, offsets, found), model.posterior(_pattern(_votes(found)))
                score[found["words"] == 0] = model.good
                # a prior under one half must not reject what there is no evidence about
                keep = (score > 1 - REJECT_AT) | (found["words"] == 0) | ((found["words"] < MIN_WORDS) & (voted > 1 - REJECT_AT))
                columns = [pa.array(voted), pa.array(score), pa.array(keep)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "label_good", "score", "keep"])

    return df.mapInArrow(tidy(run), schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, *train(docs)).select("doc_id", F.round("label_good", 6).alias("label_good"), F.round("score", 6).alias("score"), "keep")
