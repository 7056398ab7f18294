"""Edit-aware token counts.

Of each document a tree over its pre-tokens is kept: blocks of pieces (UTF-8 bytes and tokens of each) under sums of
bytes and tokens. An edit descends to the pieces it touches, takes in the pre-token three code points before it (as
far as the pattern looks ahead), cuts the changed stretch into pre-tokens anew until an old boundary after the edit is
a boundary again, encodes only that stretch, and updates the sums above its blocks. From a boundary on, pre-tokens
don't depend on what stands before, so the count is the one of encoding the whole new text.

``build_trees`` makes the trees of a table once, as columns (bytes and tokens of each pre-token) that are stored beside
the texts. ``edit_trees`` takes such a table and edits, encodes nothing but what they touch, and gives the next table
to store, for any number of batches. ``count_edited`` does both for a single batch. A block that grows past four times
its size has its tree laid out anew, so a place that is edited again and again stays cheap.

Edits are (at, drop, put): from code point ``at`` on, ``drop`` code points go and ``put`` comes; later edits of a
document see the text that earlier ones made. Places past the end count as the end; null fields as 0 or empty. Null
texts count as empty; null or empty edit lists change nothing. Texts may be of any length, one at a time is held. Rows are
edited one by one, so repeated rows and ids are edited alike. Outputs take the place of columns of their names, other
columns stay. Of an edit log, rows for unknown or null documents are ignored, and rows that tie in their order are
ordered by what they do. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.bpe import Tokenizer, default_ranks, pretokens, tokenizer
from tabwright.llm.common import CHUNK_BYTES, chunks, flat, read, replacing, strings, tidy

#: Pieces of a block when a tree is built; pieces after an edit with which a boundary is first looked for.
BLOCK, REACH = 64, 8
#: Pieces of a block beyond which its tree is laid out anew.
CROWDED = 4 * BLOCK
#: Code points that the pattern looks ahead, at most, with the one it looks from.
CONTEXT = 3
EDIT = "struct<at:int,drop:int,put:string>"


class Tree:
    """Sums of bytes and tokens over blocks of pieces. Node 1 is the root, nodes 2i and 2i + 1 stand under i."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray):
        n = max(1, -(-len(sizes) // BLOCK))
        self.leaves = 1 << (n - 1).bit_length()
        self.sizes = [sizes[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
        self.tokens = [tokens[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
        self.bytes_under, self.tokens_under = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i in range(n):
            self.bytes_under[self.leaves + i], self.tokens_under[self.leaves + i] = int(self.sizes[i].sum()), int(self.tokens[i].sum())
        for i in range(self.leaves - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.bytes_under[i] = self.bytes_under[2 * i] + self.bytes_under[2 * i + 1]
        self.tokens_under[i] = self.tokens_under[2 * i] + self.tokens_under[2 * i + 1]

    @property
    def n_bytes(self) -> int:
        return self.bytes_under[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens_under[1]

    def block_at(self, byte: int) -> tuple[int, int]:
        """The block that holds a byte (the last with bytes, for the end), and its first byte."""
        if byte >= self.n_bytes:
            byte = max(self.n_bytes - 1, 0)
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if byte >= start + self.bytes_under[node]:
                start += self.bytes_under[node]
                node += 1
        return min(node - self.leaves, len(self.sizes) - 1), start

    def replace(self, first: int, last: int, sizes: np.ndarray, tokens: np.ndarray) -> None:
        """Puts pieces in the place of those of the blocks first..last; the sums above follow. A tree with a crowded block is laid out anew."""
        share = -(-len(sizes) // (last - first + 1))
        if share > CROWDED:
            self.__init__(*(np.concatenate([*old[:first], new, *old[last + 1 :]]) for old, new in ((self.sizes, sizes), (self.tokens, tokens))))
            return
        for k, block in enumerate(range(first, last + 1)):
            self.sizes[block], self.tokens[block] = sizes[k * share : (k + 1) * share], tokens[k * share : (k + 1) * share]
            node = self.leaves + block
            self.bytes_under[node], self.tokens_under[node] = int(self.sizes[block].sum()), int(self.tokens[block].sum())
        low, high = (self.leaves + first) // 2, (self.leaves + last) // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2


class Document:
    """A text (UTF-8) with its tree."""

    def __init__(self, data: bytes, sizes: np.ndarray, tokens: np.ndarray):
        self.data, self.tree = data, Tree(sizes, tokens)

    def byte_of(self, point: int) -> int:
        """The byte at which a code point starts. ASCII texts need no search."""
        if point >= len(self.data):
            return len(self.data)
        view = np.frombuffer(self.data, np.uint8)
        head = view[: 4 * point + 4]
        starts = np.flatnonzero((head & 0xC0) != 0x80)
        return int(starts[point]) if point < len(starts) else len(self.data)

    def back(self, byte: int, points: int) -> int:
        while byte and points:
            byte -= 1
            points -= (self.data[byte] & 0xC0) != 0x80
        return byte

    def forth(self, byte: int, points: int) -> int:
        n = len(self.data)
        while byte < n and points:
            byte += 1
            while byte < n and (self.data[byte] & 0xC0) == 0x80:
                byte += 1
            points -= 1
        return byte


class Change:
    """One edit on its way: the old stretch, the new bytes, and the old boundaries after the edit."""

    def __init__(self, doc: Document, at: int, drop: int, put: str, reach: int = REACH):
        self.doc = doc
        self.start = doc.byte_of(max(at, 0))
        self.end = doc.forth(self.start, max(drop, 0))
        self.put = put.encode("utf-8", "surrogatepass")
        self.delta = len(self.put) - (self.end - self.start)
        self.stretch(reach)

    def stretch(self, reach: int) -> None:
        doc, tree = self.doc, self.doc.tree
        self.reach = reach
        self.first, self.base = tree.block_at(doc.back(self.start, CONTEXT))
        self.last, _ = tree.block_at(self.end)
        while True:
            sizes = np.concatenate(tree.sizes[self.first : self.last + 1])
            starts = self.base + np.append(0, sizes.cumsum())
            after = np.searchsorted(starts, self.end)
            if self.last + 1 >= len(tree.sizes) or len(starts) - after > reach:
                break
            self.last += 1
        self.sizes, self.starts = sizes, starts
        self.from_ = int(np.searchsorted(starts, doc.back(self.start, CONTEXT), side="right")) - 1
        self.to = min(int(after) + reach, len(starts) - 1)
        self.left, self.right = int(starts[self.from_]), int(starts[self.to])
        beyond = doc.forth(self.right, CONTEXT)
        self.text = doc.data[self.left : self.start] + self.put + doc.data[self.end : beyond]

    def settle(self, fresh: np.ndarray) -> bool:
        """fresh: new starts within ``text``. Whether an old boundary after the edit is one of them (or both texts end there)."""
        after = int(np.searchsorted(self.starts, self.end))
        old = self.starts[after : self.to + 1] + self.delta - self.left
        met = np.isin(old, fresh) | (old + self.left == len(self.doc.data) + self.delta)
        if not met.any():
            return False
        self.until = after + int(met.argmax())
        stop = int(old[self.until - after])
        self.cuts = np.append(fresh[fresh < stop], stop)
        return True

    def pieces(self) -> list[bytes]:
        return [self.text[a:b] for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist())]

    def done(self, tokens: np.ndarray) -> None:
        tree = self.doc.tree
        had = np.concatenate(tree.tokens[self.first : self.last + 1])
        sizes = np.concatenate([self.sizes[: self.from_], np.diff(self.cuts), self.sizes[self.until :]])
        tree.replace(self.first, self.last, sizes, np.concatenate([had[: self.from_], tokens, had[self.until :]]))
        self.doc.data = self.doc.data[: self.start] + self.put + self.doc.data[self.end :]


def apply_edits(own: Tokenizer, edits: list[tuple[Document, int, int, str]]) -> list[int]:
    """Applies one edit to each of several documents; what is looked at anew is cut and encoded for all of them at once. Returns the number of pieces encoded for each."""
    changes = [Change(doc, at, drop, put) for doc, at, drop, put in edits]
    open_ = changes
    while open_:
        offsets = np.append(0, np.cumsum([len(c.text) for c in open_])).astype(np.int64)
        starts = pretokens(np.frombuffer(b"".join(c.text for c in open_), np.uint8), offsets)
        at = np.searchsorted(starts, offsets)
        again = []
        for i, c in enumerate(open_):
            if not c.settle(starts[at[i] : at[i + 1]] - offsets[i]):
                c.stretch(4 * c.reach)
                again.append(c)
        open_ = again
    pieces = [c.pieces() for c in changes]
    counts = np.fromiter((len(x) // 4 for x in own.pieces([p for one in pieces for p in one])), np.int64)
    ends = np.cumsum([len(p) for p in pieces])
    for c, p, end in zip(changes, pieces, ends.tolist()):
        c.done(counts[end - len(p) : end])
    return [len(p) for p in pieces]


def documents(own: Tokenizer, column: pa.Array) -> list[Document]:
    data, offsets = flat(column)
    _, _, starts, counts = own.encode(data, offsets)
    sizes, at = np.diff(np.append(starts, len(data))), np.searchsorted(starts, offsets)
    whole = data.tobytes()
    return [Document(whole[offsets[i] : offsets[i + 1]], sizes[a:b], counts[a:b]) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))]


def stored(texts: pa.Array, sizes: pa.Array, tokens: pa.Array) -> list[Document]:
    """Documents from their texts and stored trees; nothing is encoded."""
    return [Document(data, np.array(a or [], np.int64), np.array(b or [], np.int64)) for data, a, b in zip(texts.cast(pa.binary()).to_pylist(), sizes.to_pylist(), tokens.to_pylist())]


def _apply_lists(own: Tokenizer, docs: list[Document], wanted: list[list | None]) -> list[int]:
    """Applies the k-th edits of all documents together, for k from the first on. Returns the number of pieces encoded for each."""
    encoded = [0] * len(docs)
    wanted = [one or [] for one in wanted]
    for k in range(max(map(len, wanted), default=0)):
        rows = [i for i, one in enumerate(wanted) if len(one) > k]
        todo = [(docs[i], e["at"] or 0, e["drop"] or 0, e["put"] or "") if (e := wanted[i][k]) else (docs[i], 0, 0, "") for i in rows]
        for i, n in zip(rows, apply_edits(own, todo)):
            encoded[i] += n
    return encoded


def _leaves(docs: list[Document]) -> list[pa.Array]:
    """Sizes and tokens of the documents' pieces, for storing."""
    return [pa.array([np.concatenate(x) for x in parts], pa.list_(pa.int32())) for parts in ([d.tree.sizes for d in docs], [d.tree.tokens for d in docs])]


TREE = [("sizes", T.ArrayType(T.IntegerType())), ("tokens", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType())]
COUNTED = [("n_pieces", T.LongType()), ("n_tokens", T.LongType()), ("n_tokens_edited", T.LongType()), ("pieces_encoded", T.LongType()), ("tree_tokens", T.ArrayType(T.LongType()))]


def _with(df: DataFrame, text: str, named: list[tuple[str, T.DataType]], make) -> DataFrame:
    """``df`` with columns that ``make(batch, texts)`` gives for a bounded part of a batch."""
    fields = [T.StructField(n, t) for n, t in named]
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column(text))
            for a, b in chunks(column, 2 * CHUNK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *make(part, column.slice(a, b - a))], names=[*(f.name for f in kept), *names])

    return df.mapInArrow(tidy(run), T.StructType([*kept, *fields]))


def build_trees(df: DataFrame, text: str = "text", ranks: str | None = None) -> DataFrame:
    """Adds sizes and tokens (bytes and tokens of each pre-token) and n_tokens, in the place of columns of these names."""
    path = ranks or default_ranks()

    def make(part: pa.RecordBatch, texts: pa.Array) -> list[pa.Array]:
        docs = documents(tokenizer(path), texts)
        return [*_leaves(docs), pa.array([d.tree.n_tokens for d in docs], pa.int64())]

    return _with(replacing(df, [n for n, _ in TREE]), text, TREE, make)


def edit_trees(trees: DataFrame, text: str = "text", edits: str = "edits", ranks: str | None = None) -> DataFrame:
    """A table of ``build_trees`` or of this function, with an edits column: the edited texts with their trees and n_tokens, and pieces_encoded. Only the stretches that edits touch are encoded."""
    path = ranks or default_ranks()

    def make(part: pa.RecordBatch, texts: pa.Array) -> list[pa.Array]:
        docs = stored(texts, part.column("sizes"), part.column("tokens"))
        encoded = _apply_lists(tokenizer(path), docs, part.column(edits).to_pylist())
        return [pa.array([d.data.decode("utf-8", "surrogatepass") for d in docs], pa.string()), *_leaves(docs), pa.array([d.tree.n_tokens for d in docs], pa.int64()), pa.array(encoded, pa.int64())]

    return _with(trees, text, [(text, T.StringType()), *TREE, ("pieces_encoded", T.LongType())], make)


def count_edited(df: DataFrame, text: str = "text", edits: str = "edits", ranks: str | None = None, edited: str | None = None) -> DataFrame:
    """Adds n_pieces and n_tokens of the text, n_tokens_edited after the edits, pieces_encoded for them, and tree_tokens (the tree's token sums after the edits, by node).

    ``edited`` names a column for the edited text, if it is wanted.
    """
    path = ranks or default_ranks()
    named = COUNTED + ([(edited, T.StringType())] if edited else [])

    def make(part: pa.RecordBatch, texts: pa.Array) -> list[pa.Array]:
        own = tokenizer(path)
        docs = documents(own, texts)
        before = [(sum(map(len, d.tree.sizes)), d.tree.n_tokens) for d in docs]
        encoded = _apply_lists(own, docs, part.column(edits).to_pylist())
        counts = [(p, n, d.tree.n_tokens, e) for (p, n), d, e in zip(before, docs, encoded)]
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)] + [pa.array([d.tree.tokens_under for d in docs], pa.list_(pa.int64()))]
        return columns + ([pa.array([d.data.decode("utf-8", "surrogatepass") for d in docs], pa.string())] if edited else [])

    return _with(replacing(df, [n for n, _ in named]), text, named, make)


def with_edit_log(df: DataFrame, log: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """``df`` with an ``edits`` column from a log of rows (key, order, at, drop, put). A document's edits are applied in one place."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "at", "drop", "put"))), lambda e: F.struct(e["at"].alias("at"), e["drop"].alias("drop"), e["put"].alias("put")))
    return df.join(log.groupBy(key).agg(listed.alias("edits")), key, "left")


def derived_edits(key: str = "doc_id", text: str = "text", n: int = 3):
    """``n`` edits of each document, from hashes of its key: at a place of its text a few code points go, and a few from elsewhere in it come."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size = F.char_length(whole)

    def one(k: int):
        h = [F.xxhash64(F.col(key), F.lit(4 * k + i)) for i in range(4)]
        put = F.substring(whole, (F.pmod(h[2], size + 1) + 1).cast("int"), F.pmod(h[3], F.lit(16)).cast("int"))
        return F.struct(F.pmod(h[0], size + 1).cast("int").alias("at"), F.pmod(h[1], F.lit(12)).cast("int").alias("drop"), put.alias("put"))

    return F.array(*[one(k) for k in range(n)])


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", derived_edits())
    return count_edited(docs).select("doc_id", "n_pieces", "n_tokens", "n_tokens_edited", "pieces_encoded")
