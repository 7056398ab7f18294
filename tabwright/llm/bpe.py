"""Byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression. Every code point gets a symbol (its class and what the next
one or two code points are); a symbol is a transition function on eight states, and since functions compose
associatively, the state before each code point comes from a blocked scan over ids of functions. Slices between
boundaries are dictionary-encoded by Arrow, so pair merging runs once per distinct slice and is cached.

Nulls count as empty texts and encode to no ids. Texts of any length are worked on whole. Rows keep their other
columns; an output takes the place of a column of its name. Rows are encoded one by one, whatever their ids, so repeated
rows come out as often as they went in; an empty table gives an empty one. Of pairs of one rank the leftmost is merged
first, as the library does.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabwright.llm.common import CHUNK_BYTES, chunks, flat, read, replacing, strings, tidy

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The white space of \s, and the endings that the pattern splits off after an apostrophe.
SPACE_POINTS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: The rank of a pair that makes no token.
NONE = np.int32(2**31 - 1)

_INT = struct.Struct("<i").pack

LETTER, NUMBER, OTHER, ENDING1, ENDING2, INNER, PREFIX, LAST = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_PREFIX, ONE_MORE, TWO_MORE = range(8)


@cache
def classes() -> np.ndarray:
    """Of each code point: 0 letter, 1 number, 2 other, 3 white space."""
    table = np.full(0x110000, 2, np.uint8)
    category = unicodedata.category
    for point in range(0x110000):
        kind = category(chr(point))[0]
        if kind == "L":
            table[point] = 0
        elif kind == "N":
            table[point] = 1
    table[SPACE_POINTS] = 3
    return table


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The state after a code point, and whether a pre-token starts at it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if symbol in (LETTER, NUMBER, OTHER):
        own = symbol + IN_LETTERS
        return own, state not in (own, AFTER_PREFIX)
    if symbol in (ENDING1, ENDING2):
        if state in (IN_OTHERS, AFTER_PREFIX):
            return IN_OTHERS, False
        return (ONE_MORE if symbol == ENDING1 else TWO_MORE), True
    if symbol == INNER:
        return IN_SPACES, state != IN_SPACES
    return (AFTER_PREFIX if symbol == PREFIX else FRESH), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The monoid that the symbols generate (symbols 8 to 15: the same at a text's start).

    after[f, symbol] and compose[f, g] are ids of functions (f first), apply[f, state] a state,
    starts[symbol, state] whether a pre-token starts. Id 0 is the identity.
    """
    generators = [tuple(_step(s % 8, q if s < 8 else FRESH)[0] for q in range(8)) for s in range(16)]
    ids: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    functions = list(ids)
    after: list[list[int]] = []
    while len(after) < len(functions):
        f = functions[len(after)]
        row = []
        for g in generators:
            h = tuple(g[q] for q in f)
            if h not in ids:
                ids[h] = len(functions)
                functions.append(h)
            row.append(ids[h])
        after.append(row)
    compose = [[ids[tuple(g[q] for q in f)] for g in functions] for f in functions]
    starts = [[s >= 8 or _step(s, q)[1] for q in range(8)] for s in range(16)]
    return np.array(after, np.uint16), np.array(compose, np.uint16), np.array(functions, np.uint8), np.array(starts, bool)


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """points: code points of texts without gaps; first: whether each begins a text."""
    kind = classes()[points]
    n = len(points)
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    space = kind == 3
    next_space = np.ones(n, bool)
    next_space[:-1] = space[1:] | last[:-1]
    out = kind.copy()
    out[space] = np.where(next_space[space], INNER, np.where(points[space] == 32, PREFIX, LAST))
    for at in np.flatnonzero(points == 39):
        if not last[at]:
            one = chr(points[at + 1])
            if one in ENDINGS:
                out[at] = ENDING1
            elif not last[at + 1] and one + chr(points[at + 2]) in ENDINGS:
                out[at] = ENDING2
    return out + np.where(first, 8, 0).astype(np.uint8)


def _scan(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, by a blocked scan over function ids."""
    after, compose, apply, _ = automaton()
    n = len(symbols)
    width = max(16, int(n**0.5))
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    before = np.empty((width, blocks), np.uint16)
    f = np.zeros(blocks, np.uint16)
    for k in range(width):
        before[k] = f
        f = after[f, columns[k]]
    shift = 1  # f: each block's function; now those of all blocks up to it
    while shift < blocks:
        f = np.concatenate([f[:shift], compose[f[:-shift], f[shift:]]])
        shift *= 2
    entry = np.concatenate([[FRESH], apply[f[:-1], FRESH]]).astype(np.intp)
    return apply[before, entry[None, :]].T.reshape(-1)[:n]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start in UTF-8 texts that lie side by side."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets[:-1]] = True
    symbols = _symbols(points, begin[:-1][lead])
    return lead[automaton()[3][symbols, _scan(symbols)]]


class Tokenizer:
    """Encodes slices by ranks; decodes ids by the same table."""

    def __init__(self, path: str, most_cached: int = 200_000):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(self.ranks.values()) + 1
        table: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            table[rank] = token
        self.bytes = pa.array(table, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())
        #: What slices become: their ids as int32 bytes, which take a third of the room of lists.
        self.cached: dict[bytes, bytes] = {}
        self.most_cached = most_cached

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys left id * size + right id, and the rank of what each pair makes."""
        found = [(self.ranks[t[:i]] * self.size + self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        keys, ranks = np.array(sorted(found), np.int64).T
        return np.append(keys, np.int64(1 << 62)), np.append(ranks, NONE).astype(np.int32)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self.pairs
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.size + right)
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, ranks[at], NONE)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as int32 bytes) of each piece: from the cache, or else merged, all short new pieces at once."""
        out = [self.cached.get(p) for p in pieces]
        new = [i for i, got in enumerate(out) if got is None]
        if len(self.cached) + len(new) > self.most_cached:
            self.cached.clear()
        short: dict[int, list[int]] = {}
        for i in new:
            piece = pieces[i]
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = _INT(whole)
            elif len(piece) > 64:
                out[i] = np.array(self._merged_long(piece), np.int32).tobytes()
            else:
                short.setdefault(-(-len(piece) // 4), []).append(i)
        for rows in short.values():
            for i, ids in zip(rows, self._merged([pieces[i] for i in rows]), strict=True):
                out[i] = ids
        self.cached.update((pieces[i], out[i]) for i in new)
        return out

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """In each round, every piece that still has one makes its pair of lowest rank, the leftmost of ties."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        singles = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = singles[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            some = ids[done]
            data, ends = some[some >= 0].tobytes(), (4 * (some >= 0).sum(1)).cumsum().tolist()
            for row, a, b in zip(rows[done].tolist(), [0, *ends], ends):
                out[row] = data[a:b]
            go = ~done
            rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            if not len(rows):
                break
            every = np.arange(len(rows))
            ids[every, at] = best
            left = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, left + (left > at[:, None]), 1)
            left = left[:, :-1]
            ranks = np.take_along_axis(ranks, left + (left >= at[:, None]), 1)
            for shift in (-1, 0):
                some = np.flatnonzero((at + shift >= 0) & (at + shift < ranks.shape[1]))
                i = at[some] + shift
                ranks[some, i] = self._pair_ranks(ids[some, i], ids[some, i + 1])
        return out

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same merges from a heap: n log n for runs without a boundary."""
        ranks, n = self.ranks, len(piece)
        ends = list(range(1, n + 1))  # of the part that starts at i; 0 if merged away
        left, heap = list(range(-1, n - 1)), []

        def push(i: int) -> None:
            j = ends[i]
            if j < n and (rank := ranks.get(piece[i : ends[j]])) is not None:
                heapq.heappush(heap, (rank, i, ends[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                left[end] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """ids, the texts' offsets in them, and the pre-tokens' start bytes and id counts."""
        starts = pretokens(data, offsets)
        if not len(starts):
            return pa.array([], pa.int32()), np.zeros(len(offsets), np.int64), starts, starts
        ends = np.append(starts, len(data)).astype(np.int64)
        slices = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = slices.dictionary_encode()
        lists = self.pieces(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        values = np.frombuffer(b"".join(lists), np.int32)
        table = pa.LargeListArray.from_arrays(pa.array(np.append(0, sizes.cumsum())), pa.array(values))
        ids = table.take(coded.indices).flatten()
        counts = sizes[coded.indices.to_numpy()]
        summed = np.append(0, counts.cumsum())
        return ids, summed[np.searchsorted(starts, offsets)], starts, counts

    def token_ends(self, ids: pa.Array) -> np.ndarray:
        """End bytes of the tokens, counted over all ids."""
        return pc.binary_length(self.bytes.take(ids)).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()

    def decode(self, ids: pa.Array, offsets: np.ndarray) -> list[memoryview]:
        return _joined(self.bytes, ids, offsets)

    def decimal(self, ids: pa.Array, offsets: np.ndarray) -> list[memoryview]:
        """The decimal ids of each text, a comma after each."""
        return _joined(self.decimals, ids, offsets)


def _joined(table: pa.Array, ids: pa.Array, offsets: np.ndarray) -> list[memoryview]:
    taken = table.take(ids)
    if not len(taken):
        return [memoryview(b"")] * (len(offsets) - 1)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
    data, at = memoryview(taken.buffers()[2]), ends[offsets]
    return [data[a:b] for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker and rank file."""
    return Tokenizer(path)


def default_ranks() -> str:
    return public_tokenizers.path(RANKS)


def _appended(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    df = replacing(df, [f.name for f in fields])
    return df, T.StructType([*df.schema.fields, *fields])


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def encode(df: DataFrame, text: str = "text", ranks: str | None = None, ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """Adds ``ids`` (token ids) and ``offsets`` (the byte in the UTF-8 text at which each token ends)."""
    path = ranks or default_ranks()
    df, schema = _appended(df, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(offsets, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            column = strings(batch.column(text))
            for a, b in chunks(column, 2 * CHUNK_BYTES):
                got, at, _, _ = own.encode(*flat(column.slice(a, b - a)))
                ends = own.token_ends(got)
                base = np.append(0, ends)[at[:-1]]
                ends = ends - np.repeat(base, np.diff(at))
                lists = pa.array(at.astype(np.int32))
                yield _with(batch.slice(a, b - a), {ids: pa.ListArray.from_arrays(lists, got.cast(pa.int32())), offsets: pa.ListArray.from_arrays(lists, pa.array(ends, pa.int64()))})

    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, ids: str = "ids", ranks: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes of the ids (null ids: no bytes)."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            lists = batch.column(ids)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            texts = own.decode(lists.flatten(), np.append(0, sizes.cumsum()).astype(np.int64))
            yield _with(batch, {out: pa.array([bytes(x) for x in texts], pa.binary())})

    df, schema = _appended(df, [T.StructField(out, T.BinaryType())])
    return df.mapInArrow(tidy(run), schema)


def encode_digest(df: DataFrame, text: str = "text", ranks: str | None = None) -> DataFrame:
    """Encodes, then decodes the ids, and keeps counts and digests instead of the ids: for round-trip audits.

    Adds n_tokens long, ids_sha256 and decoded_sha256 (hex of the decimal ids joined by commas, and of the decoded bytes).
    """
    path = ranks or default_ranks()
    df, schema = _appended(df, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            column = strings(batch.column(text))
            for a, b in chunks(column, 2 * CHUNK_BYTES):
                ids, at, _, _ = own.encode(*flat(column.slice(a, b - a)))
                digests = [hashlib.sha256(x[:-1]).hexdigest() for x in own.decimal(ids, at)]
                decoded = [hashlib.sha256(x).hexdigest() for x in own.decode(ids, at)]
                yield _with(batch.slice(a, b - a), {"n_tokens": pa.array(np.diff(at), pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return df.mapInArrow(tidy(run), schema)


def op2_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    return encode_digest(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
