"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of letters and digits (and all characters beyond ASCII) after lower-casing A-Z. A phrase is found where
its words stand one after the other. Templates are found as sets: blocks of a text are stretches of 2 L words that begin
every L words, where L is the power of two that a template's words fit into, so a notice of a template's length lies in
a block as a whole, wherever it stands and however its lines are broken. A block meets a template if it holds at least
``threshold`` of the template's distinct words (its containment).

The join is exact. Words are numbered by their frequency in the whole corpus, the rarest first, and a template that
needs a of its t words can only meet blocks that hold one of its t - a + 1 rarest (prefix filter), at least a words of
the vocabulary (length filter), and whose words after the first shared one still suffice (positional filter). Only
blocks that pass the first two leave their task, as sorted lists of numbers; they meet an index of the templates'
prefixes, and what passes the third is counted in full.

Templates and phrases are parameters of a stated size, so what is sent to all tasks is bounded; of the corpus only the
counts of the templates' words, which are as few, come to the driver.

Null texts count as empty; texts without words have no blocks. Rows count row by row: repeated rows and ids, and null
ids, change nothing. Texts may be of any length. Columns besides the key and the text don't matter, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import chunks, flat, read, saved, sized, strings, tidy, words_of

#: Words of all templates and phrases together; more are refused.
MOST_WORDS = 200_000
#: Words of the smallest blocks' step.
LEAST_STEP = 16
THRESHOLD_PERCENT = 80


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: Phrases and the labels that they give.
PHRASES = (Template("mit", "under the mit license"), Template("apache-2", "apache license version 2"), Template("cc-by-nc", "cc by nc"))
#: The notices that the licenses' own authors ask to place on works.
TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_LOWER[[i for i in range(128) if not chr(i).isalnum()]] = 32


def words(text: str) -> list[str]:
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))


def step(template: Template) -> int:
    """L of a template: the power of two that its words fit into."""
    return max(LEAST_STEP, 1 << (len(words(template.text)) - 1).bit_length())


@dataclass(frozen=True)
class _Vocabulary:
    """The distinct words of templates and phrases; what tasks need of them."""

    words: list[str]
    phrases: list[tuple[str, list[int]]]
    templates: list[tuple[str, int, list[int]]]  # label, step, word numbers

    @staticmethod
    def of(templates, phrases) -> _Vocabulary:
        for t in (*templates, *phrases):
            if not words(t.text):
                raise ValueError(f"a text of {t.label} has no words")
        if sum(len(words(t.text)) for t in (*templates, *phrases)) > MOST_WORDS:
            raise ValueError(f"templates and phrases have more than {MOST_WORDS} words")
        known = sorted({w for t in (*templates, *phrases) for w in words(t.text)})
        number = {w: i for i, w in enumerate(known)}
        return _Vocabulary(known, [(p.label, [number[w] for w in words(p.text)]) for p in phrases], [(t.label, step(t), sorted({number[w] for w in words(t.text)})) for t in templates])

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts (-1: not of the vocabulary), and the texts' offsets in them."""
        data, offsets = flat(texts)
        found, at = words_of(_LOWER[data], offsets)
        return pc.index_in(found, value_set=pa.array([w.encode() for w in self.words], pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False), at


def word_counts(df: DataFrame, text: str, vocabulary: _Vocabulary) -> np.ndarray:
    """How often each word of the vocabulary stands in all texts. A task gives one row per word that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            column = strings(batch.column(0))
            for a, b in chunks(column):
                numbers, _ = vocabulary.numbers(column.slice(a, b - a))
                counts += np.bincount(numbers[numbers >= 0], minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met], pa.int64())], names=["word", "n"])

    out = np.zeros(len(vocabulary.words), np.int64)
    for r in df.select(F.col(text).alias("_text")).mapInArrow(tidy(run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _needed(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def _blocks(numbers: np.ndarray, at: np.ndarray, rank: np.ndarray, members: np.ndarray, prefix: np.ndarray, least: int, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Texts, first words and sorted word ranks of the blocks of a step that hold a prefix word and enough others."""
    hits = np.flatnonzero((numbers >= 0) & members[numbers])
    owner = np.searchsorted(at, hits, side="right") - 1
    last = (hits - at[owner]) // length
    size = np.diff(at)[owner]
    owner, block, value = np.tile(owner, 2), np.append(last, last - 1), np.tile(rank[numbers[hits]], 2)
    # the words of a last block that is no longer than a step are in the one before, too
    real = (block == 0) | ((block > 0) & ((block + 1) * length < np.tile(size, 2)))
    rows = np.unique(np.stack([owner[real], block[real], value[real]], axis=1), axis=0) if real.any() else np.zeros((0, 3), np.int64)
    fresh = np.flatnonzero(np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
    ends = np.append(fresh[1:], len(rows))
    held = np.add.reduceat(prefix[rows[:, 2]].astype(np.int64), fresh) if len(fresh) else fresh
    kept = np.flatnonzero((held > 0) & (ends - fresh >= least))
    return rows[fresh[kept], 0], rows[fresh[kept], 1] * length, [rows[a:b, 2] for a, b in zip(fresh[kept], ends[kept])]


def _scanned(df: DataFrame, key: str, text: str, vocabulary: _Vocabulary, rank: np.ndarray, percent: int) -> DataFrame:
    """_k, n_words, n_base, first_word, last_word, base (labels), blocks (arrays of step, first word, ranks in order)."""
    shapes = []
    for length in sorted({t[1] for t in vocabulary.templates}):
        own = [sorted(rank[t[2]].tolist()) for t in vocabulary.templates if t[1] == length]
        members, prefix = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
        for t in vocabulary.templates:
            members[t[2]] |= t[1] == length
        for ranks in own:
            prefix[ranks[: len(ranks) - _needed(len(ranks), percent) + 1]] = True
        shapes.append((members, prefix, min(_needed(len(ranks), percent) for ranks in own), length))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column("_text"))
            for a, b in chunks(column):
                numbers, at = vocabulary.numbers(column.slice(a, b - a))
                n = b - a
                n_base, first, last = np.zeros(n, np.int64), np.full(n, len(numbers), np.int64), np.full(n, -1, np.int64)
                base: list[set[str]] = [set() for _ in range(n)]
                for label, phrase in vocabulary.phrases:
                    places = max(len(numbers) - len(phrase) + 1, 0)
                    hit = np.ones(places, bool)
                    for i, word in enumerate(phrase):
                        hit &= numbers[i : i + places] == word
                    start = np.flatnonzero(hit)
                    owner = np.searchsorted(at, start, side="right") - 1
                    whole = start + len(phrase) <= at[owner + 1]
                    start, owner = start[whole] - at[owner[whole]], owner[whole]
                    np.add.at(n_base, owner, 1)
                    np.minimum.at(first, owner, start)
                    np.maximum.at(last, owner, start)
                    for i in np.unique(owner).tolist():
                        base[i].add(label)
                blocks: list[list[list[int]]] = [[] for _ in range(n)]
                for members, prefix, least, length in shapes:
                    for owner, word, ranks in zip(*_blocks(numbers, at, rank, members, prefix, least, length)):
                        blocks[owner].append([length, int(word), *ranks.tolist()])
                none = n_base == 0
                columns = [
                    batch.column("_k").slice(a, n),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(n_base),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array([sorted(x) for x in base], pa.list_(pa.string())),
                    pa.array(blocks, pa.list_(pa.list_(pa.int32()))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_k", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    schema = f"_k {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>"
    return df.select(F.col(key).alias("_k"), F.col(text).alias("_text")).mapInArrow(tidy(run), schema)


def _joined(scanned: DataFrame, vocabulary: _Vocabulary, rank: np.ndarray, percent: int) -> DataFrame:
    """_row, found: what of the templates the row's blocks meet (label, first_word, words, containment)."""
    index = []
    for number, (label, length, own) in enumerate(vocabulary.templates):
        ranks = sorted(rank[own].tolist())
        needed = _needed(len(ranks), percent)
        index += [(number, label, length, place, r, needed, ranks) for place, r in enumerate(ranks[: len(ranks) - needed + 1])]
    spark = scanned.sparkSession
    prefixes = F.broadcast(spark.createDataFrame(index, "template int, label string, step int, place int, rank int, needed int, own array<int>"))
    block = F.explode("blocks")
    each = scanned.filter(F.size("blocks") > 0).select("_row", block.alias("_b")).select("_row", F.get("_b", 0).alias("step"), F.get("_b", 1).alias("first_word"), F.slice("_b", 3, F.size("_b")).alias("ranks"))
    met = each.select("*", F.posexplode("ranks").alias("at", "rank")).join(prefixes, ["step", "rank"])
    left = 1 + F.least(F.size("own") - F.col("place") - 1, F.size("ranks") - F.col("at") - 1)
    shared = F.size(F.array_intersect("ranks", "own"))
    pairs = met.filter(left >= F.col("needed")).withColumn("shared", shared).filter(F.col("shared") >= F.col("needed"))
    one = F.struct("label", F.col("first_word").cast("long").alias("first_word"), (2 * F.col("step")).cast("long").alias("words"), (F.col("shared") / F.size("own")).alias("containment"))
    return pairs.groupBy("_row").agg(F.sort_array(F.collect_set(one)).alias("found"))


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per row: key, n_words, n_base (places of phrases), first_word and last_word (where the first and last of them begin), base_labels and labels (arrays, sorted), score (the largest containment, 1 with a phrase, 0 without any label), found (label, first_word and words of each block that meets a template, containment)."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be in 1..100")
    vocabulary = _Vocabulary.of(templates, phrases)
    counts = word_counts(df, text, vocabulary)
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    scanned = saved(_scanned(df, key, text, vocabulary, rank, percent).withColumn("_row", F.monotonically_increasing_id()))
    found = sized(saved(_joined(scanned, vocabulary, rank, percent)))
    none = F.array().cast("array<struct<label:string,first_word:bigint,words:bigint,containment:double>>")
    out = scanned.drop("blocks").join(found, "_row", "left").withColumn("found", F.coalesce("found", none))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.col("found").getField("label"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("found").getField("containment")), F.lit(0.0)))
    return out.select(F.col("_k").alias(key), "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"), labels.alias("labels"), score.alias("score"), "found")


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"('{p.label}', {quoted(words(p.text))})" for p in PHRASES)
    templates = ", ".join(f"('{t.label}', {step(t)}, {quoted(sorted(set(words(t.text))))})" for t in TEMPLATES)
    return rf"""
WITH p(label, ws) AS (VALUES {phrases}), t(label, size, ws) AS (VALUES {templates}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), p WHERE w[i + 1] = ws[1] AND w[i + 1:i + len(ws)] = ws
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id
), blocks AS (
  SELECT doc_id, size, list_distinct(w[b * size + 1:b * size + 2 * size]) AS ws FROM (SELECT doc_id, w, size, unnest(range(greatest(1, len(w)))) AS b FROM d, (SELECT DISTINCT size FROM t)) WHERE b = 0 OR (b + 1) * size < len(w)
), found AS (
  SELECT doc_id, label, len(list_intersect(blocks.ws, t.ws)) AS n, len(t.ws) AS size FROM blocks JOIN t USING (size) WHERE 100 * len(list_intersect(blocks.ws, t.ws)) >= {THRESHOLD_PERCENT} * len(t.ws)
), best AS (
  SELECT doc_id, max(n / size) AS score, list(DISTINCT label) AS labels FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(best.labels, []))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


OP13_SQL = _sql()
