"""Line dedup by a segment-partition edit join.

Lines (texts split at ``\\n``, ASCII white space at both ends cut off) are the same if equal, and near if they are at
most so many edits apart as the shorter one's length allows (``bands``). For k edits a line is cut into k + 1
segments, k // 2 + 1 counted from its start and the others from its end; one part has fewer edits than segments, so
its segment i, for some i, is whole and no more than i places off in a line that is near. Segments of distinct lines
are indexed by (length class, segment, hash), and every line probes the places at which it may hold the segments of
lines up to k shorter. Lines that meet are compared where they meet, those of crowded keys in blocks that are dealt
out by key and block; a pair counts at the first segment it shares, and a task gives one row per line and block, never
one per pair. A key that is crowded by a passage which lines share, while they differ elsewhere, is refined: an edit
changes at most q of a line's substrings of q code points, so lines at most k edits apart share one of the k * q + 1
that come first in any common order. The order is by how rare substrings are among the lines of crowded keys, and lines
meet by key and substring where that halves the pairs at least. Pairs are verified by a banded bit-parallel edit distance: one word per number of edits holds the
diagonals that are alive, and all pairs of a batch step through their lines at once.

Lines are told apart by a 128-bit digest of their bytes; the hashes of segments only bring pairs together, which are then
compared character by character. A line is dropped if it, or a line near it, came earlier (by document id, then line number): a line near to several
is judged by the first places of all. Blank lines are never dropped, lines under the first band only as exact copies.
A text that loses no line stays as it was, byte for byte.

Null texts have no lines and stay null; empty texts have one blank line. A document is an id with a text: rows that
repeat an id with another text are documents of their own (ordered by a hash of the text), null ids come after all
others, and rows that repeat both are one document and share every decision. Texts and lines may be of any length.
Columns besides the key and the text, whatever their names, stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import CHUNK_BYTES, chunks, flat, mix, read, saved, sized, strings, tidy

#: Lines with fewer code points have no near lines.
MIN_CHARS = 32
#: Edits that are allowed from so many code points of the shorter line on: one only, or one in about twenty, at most five.
ONE_EDIT = ((MIN_CHARS, 1),)
BANDS = ((MIN_CHARS, 1), (40, 2), (60, 3), (80, 4), (100, 5))
#: Lines indexed by a crowded key that one block compares with the others.
BLOCK = 256
#: Code points of the substrings that refine crowded keys, at most, and buckets in which they are counted.
GRAM, GRAM_BUCKETS = 4, 1 << 16
#: Places of a line beyond which it is looked up apart from the others.
HOT = 1_000
#: Pairs, and code points of their lines, that are verified at a time.
PAIRS, PAIR_POINTS = 1 << 15, 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = mix(np.arange(1, 1 << 16, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STRIP = b" \t\n\x0b\x0c\r"
#: What tells lines apart: the halves of their digests.
IDS = ["hash", "hash2"]
_powers_kept: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, 0..n at least; those for usual chunks are kept."""
    if _powers_kept and len(_powers_kept[0]) > n:
        return _powers_kept
    size = max(n, CHUNK_BYTES) + 1
    made = []
    for factor in (_BASE, _INVERSE):
        x = np.full(size, factor, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if size == CHUNK_BYTES + 1:
        _powers_kept[:] = made
    return made


class _Hashes:
    """Hashes of any substrings of a row of characters, from prefix sums of a polynomial hash."""

    def __init__(self, characters: np.ndarray):
        n = len(characters)
        powers, self.inverse = _powers(n)
        values = _VALUES[characters] if not n or characters.dtype == np.uint8 or characters.max() < len(_VALUES) else mix(characters.astype(np.uint64) + np.uint64(1))
        # sum of value * base ** place; a difference is moved to a common place by the power that is missing
        self.sums = np.append(np.uint64(0), np.cumsum(values * powers[:n], dtype=np.uint64))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _BASE)


def _digests(lines: list[bytes]) -> np.ndarray:
    """(lines, 2) halves of 128-bit digests."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in lines]), np.int64).reshape(-1, 2)


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of texts that lie side by side: first and end byte of each stripped line, and the number of its text."""
    breaks = np.flatnonzero(data == 10)
    counts = np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=len(offsets) - 1) + 1
    last = np.cumsum(counts) - 1
    begin, end = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    inner = np.ones(len(begin), bool)
    inner[last - counts + 1] = False
    begin[last - counts + 1], begin[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[last] = False
    end[last], end[inner] = offsets[1:], breaks
    solid = np.flatnonzero(~_SPACE[data])
    low, high = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    has = high > low
    stop = begin.copy()
    begin[has], stop[has] = solid[low[has]], solid[high[has] - 1] + 1
    return begin, stop, np.repeat(np.arange(len(counts)), counts)


def _points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    if not len(data) or data.max() < 128:
        return data
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def _leads(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte (and before the end)."""
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


def _fold(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix(h * _BASE + p.astype(np.uint64))
    return h


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and _t, a hash of the text; key and _t together name a document."""
    return df.select(F.col(key).alias("_k"), F.col(text).alias("_text"), F.xxhash64(text).alias("_t"))


def _same(left: DataFrame, right: DataFrame):
    return left["_k"].eqNullSafe(right["_k2"]) & (left["_t"] == right["_t2"])


def _other(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("_k", "_k2").withColumnRenamed("_t", "_t2")


def _place():
    """Places in order: document (null ids last), then line."""
    return F.struct(F.col("_k").isNull().alias("none"), F.col("_k").alias("k"), F.col("_t").alias("t"), F.col("line").alias("line"))


def _line_rows(named: DataFrame) -> DataFrame:
    """_k, _t, line (number from 0), hash and hash2 (null for a blank line), size (code points)."""
    kind = named.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column("_text"))
            for a, b in chunks(column):
                data, offsets = flat(column.slice(a, b - a))
                begin, stop, owner = _split(data, offsets)
                leads = _leads(data)
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                take = lambda name: batch.column(name).slice(a, b - a).take(pa.array(owner))  # noqa: B023, E731
                raw, blank = data.tobytes(), stop == begin
                halves = _digests([raw[i:j] for i, j in zip(begin.tolist(), stop.tolist())])
                hashes = [pa.array(halves[:, h], mask=blank) for h in (0, 1)]
                yield pa.RecordBatch.from_arrays([take("_k"), take("_t"), pa.array(number, pa.int32()), *hashes, pa.array(leads[stop] - leads[begin], pa.int32())], names=["_k", "_t", "line", *IDS, "size"])

    return named.filter("_text IS NOT NULL").mapInArrow(tidy(run), f"_k {kind}, _t long, line int, hash long, hash2 long, size int")


def allowed(size, bands):
    """Edits that a pair may have whose shorter line has so many code points."""
    starts, edits = zip(*bands)
    return np.append(0, edits)[np.searchsorted(starts, size, side="right")]


def _length_class(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of the class of each size: eight classes from each power of two (8 at least) to the next."""
    step = np.left_shift(1, np.maximum(np.frexp(size.astype(np.float64))[1] - 4, 0)).astype(np.int64)
    first = size // step * step
    return first, first + step - 1


def _segments(first, last, bands) -> tuple:
    """Of a length class: segments counted from the start, from the end, and their width."""
    k = allowed(last, bands)
    return k // 2 + 1, (k + 1) // 2, first // (k + 1)


def _probes(hashes: _Hashes, begin: np.ndarray, stop: np.ndarray, first: np.ndarray, last: np.ndarray, bands, shifts: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, keys) of the places in lines at which they may hold segments of lines of a length class. shifts: "none" (segments of the lines' own, in order), "some" (the places but those) or "all"."""
    fore, back, width = _segments(first, last, bands)
    for side, count in ((0, fore), (1, back)):
        for i in range(int(count.max(initial=0))):
            for shift in range(-i, i + 1):
                if shifts == ("none" if shift else "some"):
                    continue
                left = begin + i * width + shift if side == 0 else stop - (i + 1) * width + shift
                some = np.flatnonzero((i < count) & (left >= begin) & (left + width <= stop))
                at = left[some]
                yield some, _fold(first[some], np.full(len(some), 64 * side + i), hashes(at, at + width[some]))


def _key_rows(named: DataFrame, places: DataFrame, bands) -> DataFrame:
    """hash, hash2, n_own, spots (the keys of the line's n_own segments, in order, then the other keys at which it looks) of the lines at the places (_k, _t, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column("_text"))
            lists = batch.column("_lines")
            for a, b in chunks(column):
                raw = []
                for data, numbers in zip(column.slice(a, b - a).cast(pa.binary()).to_pylist(), lists.slice(a, b - a).to_pylist()):
                    parts = data.split(b"\n")
                    raw += [parts[n].strip(_STRIP) for n in numbers]
                data = np.frombuffer(b"".join(raw), np.uint8)
                ends = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
                own = _digests(raw)
                at = _leads(data)[ends]
                i, j = at[:-1], at[1:]
                size, hashes = j - i, _Hashes(_points(data))
                first, last = _length_class(size)
                keys = [*_probes(hashes, i, j, first, last, bands, "none"), *_probes(hashes, i, j, first, last, bands, "some")]
                # lines up to k shorter are of the same class or of the one before
                low = np.maximum(size - allowed(size, bands), bands[0][0])
                other, end = _length_class(low)
                across = np.flatnonzero(other < first)
                keys += [(across[x], more) for x, more in _probes(hashes, i[across], j[across], other[across], end[across], bands, "all")]
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(allowed(last, bands) + 1, pa.int32()), _lists(keys, len(raw))], names=[*IDS, "n_own", "spots"])

    asked = saved(_other(places.groupBy("_k", "_t").agg(F.sort_array(F.collect_list("line")).alias("_lines"))))
    chosen = named.join(sized(asked), _same(named, asked)).select("_text", "_lines")
    return chosen.mapInArrow(tidy(run), "hash long, hash2 long, n_own int, spots array<long>")


def _lists(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    lines = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
    keys = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.uint64)
    order = np.argsort(lines, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.bincount(lines, minlength=n).cumsum()), pa.int32()), pa.array(keys[order].view(np.int64)))


def _shared(points: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many code points are the same from places x and y on (or back from them), at most ``most``."""
    out, open_, step = np.zeros(len(x), np.int64), np.arange(len(x)), np.arange(32)
    while len(open_):
        at = (out[open_, None] + step) * way
        same = (points[(x[open_, None] + at) % len(points)] == points[(y[open_, None] + at) % len(points)]) & (out[open_, None] + step < most[open_, None])
        run = np.where(same.all(1), 32, np.argmin(same, 1))
        out[open_] += run
        open_ = open_[run == 32]
    return out


def within(points: np.ndarray, at: np.ndarray, sizes: np.ndarray, short: np.ndarray, long: np.ndarray, most: int) -> np.ndarray:
    """Whether the edit distance of each pair of lines is at most ``most``.

    ``points`` holds the lines with ``most`` or more other values before and 64 and as many after each; line x begins at
    ``at[x]``, and ``short`` and ``long`` name the lines of the pairs. What pairs share at both ends is left out. Bit o
    of word d: the first i = j + o - most code points of the one become the first j of the other by d edits or fewer. A
    step reads code point j.
    """
    columns = 16 if 2 * most + 1 <= 16 else 64
    kind = np.uint16 if columns == 16 else np.uint64
    full = kind((1 << (2 * most + 1)) - 1)
    found = np.zeros(len(short), bool)
    which = np.flatnonzero(np.abs(sizes[long] - sizes[short]) <= most)
    x, y, m, n = at[short[which]], at[long[which]], sizes[short[which]], sizes[long[which]]
    head = _shared(points, x, y, np.minimum(m, n), 1)
    tail = _shared(points, x + m - 1, y + n - 1, np.minimum(m, n) - head, -1)
    x, y, m, ends = x + head - most, y + head, m - head - tail, n - head - tail
    goal = (kind(1) << (m - ends + most).astype(kind)).astype(kind)
    words = [np.full(len(which), sum(1 << (most + i) for i in range(d + 1)) & int(full), kind) for d in range(most + 1)]
    band = np.arange(columns)
    for j in range(int(ends.max(initial=-1)) + 1):
        over = ends == j
        if over.any():
            found[which[over]] = (words[most][over] & goal[over]) != 0
        if j % 8 == 0 or over.any():
            alive = (ends > j) & (words[most] != 0)
            if not alive.all():
                which, x, y, ends, goal = (v[alive] for v in (which, x, y, ends, goal))
                words = [w[alive] for w in words]
        if not len(which):
            break
        same = np.packbits(points[(x + j)[:, None] + band] == points[y + j][:, None], axis=1, bitorder="little").view(kind)[:, 0]
        before, now = words[0], words[0] & same
        words[0] = now
        for d in range(1, most + 1):
            own = words[d]
            now = (own & same) | before | (before >> kind(1)) | ((now << kind(1)) & full)
            before, words[d] = own, now
    return found


def _padded(said: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arguments points, at and sizes of ``within`` for lines."""
    data, offsets = flat(said)
    leads = _leads(data)[offsets]
    sizes = np.diff(leads)
    gap = 2 * most + 64
    at = leads[:-1] + gap * np.arange(len(sizes)) + most
    points = np.full(int(sizes.sum()) + gap * (len(sizes) + 1), 0xFFFFFFFF, np.uint32)
    points[np.arange(int(sizes.sum())) + np.repeat(at - leads[:-1], sizes)] = _points(data)
    return points, at, sizes


def _verified(said: pa.Array, sizes: np.ndarray, short: np.ndarray, long: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether each pair of lines is at most ``edits`` apart, a bounded number of code points at a time."""
    found = np.zeros(len(short), bool)
    for most in np.unique(edits).tolist():
        own = np.flatnonzero(edits == most)
        weight = np.cumsum(sizes[short[own]] + sizes[long[own]])
        for part in np.split(own, np.searchsorted(weight, np.arange(PAIR_POINTS, int(weight[-1]), PAIR_POINTS))):
            if len(part):
                lines, names = np.unique(np.concatenate([short[part], long[part]]), return_inverse=True)
                found[part] = within(*_padded(said.take(pa.array(lines)), most), names[: len(part)], names[len(part) :], most)
    return found


def _shares_before(short: str, long: str, segment: int, shape: tuple[int, int, int]) -> bool:
    """Whether the pair meets at a segment before this one, too."""
    fore, _, width = shape
    n = len(long)
    for s in range(segment):
        i = s if s < fore else s - fore
        at = i * width if s < fore else len(short) - (i + 1) * width
        part = short[at : at + width]
        base = i * width if s < fore else n - (i + 1) * width
        for left in range(base - i, base + i + 1):
            if left >= 0 and left + width <= n and long.startswith(part, left):
                return True
    return False


def _gram(bands) -> int:
    """Code points of the substrings that refine crowded keys: few enough that every line has one more than edits may change."""
    return max(1, min(GRAM, *(start // (k + 1) for start, k in bands)))


def _grams(said: pa.Array, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all substrings of q code points: the number of their line, their hash, and how often the line has had it before; by line and hash. And the sizes of the lines."""
    data, offsets = flat(said)
    ends = _leads(data)[offsets]
    sizes = np.diff(ends)
    many = np.maximum(sizes - q + 1, 0)
    line = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(line)) - np.repeat(np.cumsum(many) - many - ends[:-1], many)
    gram = _Hashes(_points(data))(at, at + q)
    order = np.lexsort((gram, line))
    line, gram = line[order], gram[order]
    n = np.arange(len(line))
    fresh = np.append(True, (line[1:] != line[:-1]) | (gram[1:] != gram[:-1]))[: len(n)]
    return line, gram, n - np.maximum.accumulate(np.where(fresh, n, 0)), sizes


def _gram_counts(said: DataFrame, q: int) -> np.ndarray:
    """How many substrings of the lines fall into each bucket: a table of GRAM_BUCKETS numbers, whatever the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAM_BUCKETS, np.int64)
        for batch in batches:
            column = strings(batch.column("said"))
            for a, b in chunks(column):
                total += np.bincount((_grams(column.slice(a, b - a), q)[1] % np.uint64(GRAM_BUCKETS)).astype(np.int64), minlength=GRAM_BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(GRAM_BUCKETS, np.int64)
    for bucket, n in said.select("said").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def _mark_rows(said: DataFrame, bands) -> DataFrame:
    """hash, hash2, marks (ascending): the rarest substrings of each line, one more than the edits it is allowed can change; those that repeat in a line are told apart."""
    q = _gram(bands)
    rare = _gram_counts(said, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column("said"))
            for a, b in chunks(column):
                line, gram, again, sizes = _grams(column.slice(a, b - a), q)
                order = np.lexsort((again, gram, rare[(gram % np.uint64(GRAM_BUCKETS)).astype(np.int64)], line))
                rank = np.arange(len(line)) - np.searchsorted(line, line)
                order = order[rank < allowed(sizes, bands)[line] * q + 1]
                marks = _fold(gram[order], again[order]).view(np.int64)
                order = line[order]
                ascending = np.lexsort((marks, order))
                ends = np.append(0, np.bincount(order, minlength=b - a).cumsum())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(marks[ascending]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in IDS), lists], names=[*IDS, "marks"])

    return said.select(*IDS, "said").mapInArrow(tidy(run), "hash long, hash2 long, marks array<long>")


def _first_met(marks: np.ndarray, mark: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each pair of rows shares no mark before the one it meets at."""
    out = np.ones(len(i), bool)
    for column in marks.T:
        open_ = np.flatnonzero(out & (column[i] < mark[i]))
        if not len(open_):
            break  # marks ascend
        out[open_] = ~(marks[j[open_]] == column[i[open_], None]).any(1)
    return out


def _compare(bands):
    """For mapInArrow over members that are sorted by spot, mark (null where the key isn't refined), block, and the indexed ones first: hash, hash2, place of the earliest first place of lines near it, n of them met here."""

    def pairs_of(rows: pa.Table, done: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of an indexed row and a later one of its spot and block; rows before ``done`` have met already."""
        spot, mark, block, segment = (rows[c].fill_null(-1).to_numpy() for c in ("spot", "mark", "block", "segment"))
        n = np.arange(len(spot))
        fresh = np.append(True, (spot[1:] != spot[:-1]) | (mark[1:] != mark[:-1]) | (block[1:] != block[:-1]))
        start = np.maximum.accumulate(np.where(fresh, n, 0))
        indexed = np.append(0, np.cumsum(segment >= 0))
        count = np.where(n >= done, indexed[n] - indexed[start], 0)
        ends = np.cumsum(count)
        low = 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
            own = count[low:high]
            second = np.repeat(n[low:high], own)
            yield np.repeat(start[low:high], own) + np.arange(len(second)) - np.repeat(np.cumsum(own) - own, own), second
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            done = 0 if kept is None else kept.num_rows
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            said = strings(rows["said"])
            sizes, halves = pc.utf8_length(said).to_numpy(), [rows[c].to_numpy() for c in IDS]
            order = np.lexsort(halves)
            hashes = np.empty(rows.num_rows, np.int64)  # numbers of the lines, in the order of their digests
            hashes[order] = np.cumsum(np.append(False, (np.diff(halves[0][order]) != 0) | (np.diff(halves[1][order]) != 0))[: len(order)])
            segment = rows["segment"].fill_null(-1).to_numpy()
            rank = np.empty(rows.num_rows, np.int64)
            rank[pc.sort_indices(rows, [("_k", "ascending"), ("_t", "ascending"), ("line", "ascending")], null_placement="at_end").to_numpy()] = np.arange(rows.num_rows)
            at_rank = np.argsort(rank)
            mark, lists = rows["mark"].fill_null(0).to_numpy(), rows["marks"].combine_chunks()
            counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            marks = np.full((rows.num_rows, int(counts.max(initial=0))), np.iinfo(np.int64).max)
            marks[np.arange(marks.shape[1]) < counts[:, None]] = lists.flatten().to_numpy()
            for i, j in pairs_of(rows, done):
                swap = (sizes[i] > sizes[j]) | ((sizes[i] == sizes[j]) & (hashes[i] > hashes[j]))
                # a longer line that only looks here is indexed in a block of its own, where the pair counts
                some = (hashes[i] != hashes[j]) & ~(swap & (segment[j] < 0))
                i, j, swap = i[some], j[some], swap[some]
                short, long = np.where(swap, j, i), np.where(swap, i, j)
                edits = allowed(sizes[short], bands)
                some = sizes[long] - sizes[short] <= edits
                i, j, short, long, edits = i[some], j[some], short[some], long[some], edits[some]
                some = _first_met(marks, mark, i, j)
                i, short, long, edits = i[some], short[some], long[some], edits[some]
                if not len(i):
                    continue
                some = np.flatnonzero(_verified(said, sizes, short, long, edits))
                if not len(some):
                    continue
                first, last = _length_class(sizes[i[some]])
                shapes = zip(*(np.broadcast_to(x, len(some)).tolist() for x in _segments(first, last, bands)))
                words = zip(said.take(pa.array(short[some])).to_pylist(), said.take(pa.array(long[some])).to_pylist(), segment[i[some]].tolist(), shapes)
                some = some[np.fromiter((not _shares_before(*w) for w in words), bool, len(some))]
                near, n = np.full(rows.num_rows, rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
                for a, b in ((short[some], long[some]), (long[some], short[some])):
                    np.minimum.at(near, a, rank[b])
                    np.add.at(n, a, 1)
                met = np.flatnonzero(n)
                place = rows.take(pa.array(at_rank[near[met]])).combine_chunks()
                columns = [*(pa.array(h[met]) for h in halves), *(place[c].combine_chunks() if isinstance(place[c], pa.ChunkedArray) else place[c] for c in ("_k", "_t", "line")), pa.array(n[met])]
                yield pa.RecordBatch.from_arrays(columns, names=[*IDS, "_k", "_t", "line", "n"])
            # the indexed rows of the last spot, mark and block may meet rows of the next batch
            spot, block = rows["spot"].to_numpy(), rows["block"].to_numpy()
            open_ = np.flatnonzero((spot == spot[-1]) & (mark == mark[-1]) & (block == block[-1]) & (segment >= 0)) if len(spot) else np.zeros(0, np.int64)
            kept = rows.take(pa.array(open_)).combine_chunks()

    return tidy(run)


def _texts(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, hash2, said (the stripped line) and place of lines; wanted: hash, hash2, _k, _t, line."""
    asked = saved(_other(wanted.groupBy("_k", "_t").agg(F.collect_list(F.struct("line", *IDS)).alias("_lines"))))
    texts = named.join(sized(asked), _same(named, asked)).select("_k", "_t", F.split("_text", "\n", -1).alias("_all"), F.explode("_lines").alias("_one"))
    said = F.btrim(F.get("_all", F.col("_one.line")), F.lit(" \t\n\x0b\x0c\r"))
    return texts.select(*[F.col("_one").getField(c).alias(c) for c in IDS], said.alias("said"), "_k", "_t", F.col("_one.line").alias("line")).dropDuplicates(IDS)


def _refined(members: DataFrame, said: DataFrame, bands) -> DataFrame:
    """Members with mark and marks, and as many blocks as their spot, or their spot and mark, needs: null where the spot stays as it is, else a row for each mark at which the line may meet another."""
    plain = members.withColumn("mark", F.lit(None).cast("long")).withColumn("marks", F.lit(None).cast("array<long>"))
    crowded = saved(members.filter("blocks > 1").drop("blocks"))
    if crowded.isEmpty():
        return plain
    marks = saved(_mark_rows(said.join(sized(saved(crowded.select(*IDS).distinct())), IDS, "left_semi"), bands))
    at_marks = crowded.join(sized(marks), IDS).withColumn("mark", F.explode("marks"))
    tally = [F.count(F.lit(1)).alias("n"), F.count("segment").alias("n_own")]
    cells = saved(at_marks.groupBy("spot", "mark").agg(*tally).filter("n > 1 AND n_own > 0"))
    fine = cells.groupBy("spot").agg(F.sum(F.col("n").cast("double") * F.col("n_own")).alias("fine"))
    spots = crowded.groupBy("spot").agg(*tally).join(fine, "spot", "left").filter("coalesce(fine, 0) * 2 <= cast(n AS double) * n_own")
    spots = sized(saved(spots.select("spot")))
    cells = cells.join(spots, "spot", "left_semi").select("spot", "mark", F.ceil(F.col("n_own") / BLOCK).cast("int").alias("blocks"))
    chosen = at_marks.join(spots, "spot", "left_semi").join(cells, ["spot", "mark"])
    return plain.join(spots, "spot", "left_anti").unionByName(chosen)


def near_lines(named: DataFrame, firsts: DataFrame, bands) -> DataFrame:
    """hash, hash2, near_first (the earliest first place of lines near it), n_links (how many other lines are near it)."""
    places = firsts.filter(F.col("size") >= bands[0][0]).select(*IDS, F.col("first.k").alias("_k"), F.col("first.t").alias("_t"), F.col("first.line").alias("line"))
    # keys are many times the lines: they are made twice instead of stored, and the first time go out as bare counts (indexed ones in the upper half)
    rows = _key_rows(named, places, bands).select(*IDS, "n_own", F.posexplode("spots").alias("at", "spot"))
    met = rows.groupBy("spot").agg(F.sum(F.when(F.col("at") < F.col("n_own"), (1 << 32) + 1).otherwise(1)).alias("c")).select("spot", F.shiftright("c", 32).alias("n_own"), F.col("c").bitwiseAND((1 << 32) - 1).alias("n"))
    met = sized(saved(met.filter("n > 1 AND n_own > 0").select("spot", F.ceil(F.col("n_own") / BLOCK).cast("int").alias("blocks"))))
    members = rows.join(met, "spot").groupBy("spot", *IDS).agg(F.min(F.when(F.col("at") < F.col("n_own"), F.col("at"))).alias("segment"), F.first("blocks").alias("blocks"))
    members = saved(members)
    said = saved(_texts(named, places.join(sized(saved(members.select(*IDS).distinct())), IDS, "left_semi")))
    members = _refined(members, said, bands)
    home = F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("segment", F.when(F.col("block") == home, F.col("segment")))
    dealt = dealt.join(said, IDS).select("spot", "mark", "marks", "block", "segment", *IDS, "said", "_k", "_t", "line")
    dealt = dealt.repartition("spot", "mark", "block").sortWithinPartitions("spot", "mark", "block", F.col("segment").asc_nulls_last())
    kind = named.schema["_k"].dataType.simpleString()
    ways = saved(dealt.mapInArrow(_compare(bands), f"hash long, hash2 long, _k {kind}, _t long, line int, n long"))
    return ways.groupBy(*IDS).agg(F.min(_place()).alias("near_first"), F.sum("n").alias("n_links"))


def _decided(named: DataFrame, bands) -> DataFrame:
    """One row per document with lines: _k, _t, n_lines, n_exact and n_near (dropped as copies and as near lines), n_links, dropped (line numbers), firsts (by line: the key of the document with the earliest line that is equal or near, its own if it stays)."""
    rows = saved(_line_rows(named))
    solid = rows.filter(F.col("hash").isNotNull())
    counted = saved(solid.groupBy(*IDS).agg(F.min(_place()).alias("first"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")))
    # lines that come once and have no near ones, most of all, are judged by that alone
    judged = counted.join(sized(saved(near_lines(named, counted, bands))), IDS, "left").filter("n > 1 OR near_first IS NOT NULL")
    judged = saved(judged.select(*IDS, "n", "first", F.when(F.col("near_first") < F.col("first"), F.col("near_first")).alias("near_first"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    # lines that are everywhere would crowd one task of a join by hash; there are few of them, and they go to the rows
    hot, others = sized(judged.filter(F.col("n") > HOT)), sized(judged.filter(F.col("n") <= HOT))
    placed = rows.select("_k", "_t", "line", *IDS)
    each = placed.join(hot, IDS).unionByName(placed.join(hot.select(*IDS), IDS, "left_anti").join(others, IDS, "left"))
    exact = F.col("first").isNotNull() & (_place() != F.col("first"))
    gone = exact | F.col("near_first").isNotNull()
    near_only = ~exact & F.col("near_first").isNotNull()
    to = F.when(F.col("near_first").isNotNull(), F.col("near_first.k")).when(F.col("first").isNotNull(), F.col("first.k")).otherwise(F.col("_k"))
    # rows that repeat a document brought its lines as often
    copies = F.count(F.lit(1)) / (F.max("line") + 1)
    once = lambda n: F.coalesce((n / copies).cast("long"), F.lit(0).cast("long"))
    return each.groupBy("_k", "_t").agg(
        (F.max("line") + 1).cast("long").alias("n_lines"),
        once(F.count(F.when(exact, 1))).alias("n_exact"),
        once(F.count(F.when(near_only, 1))).alias("n_near"),
        once(F.sum("n_links")).alias("n_links"),
        F.sort_array(F.array_distinct(F.collect_list(F.when(gone, F.col("line"))))).alias("dropped"),
        F.transform(F.sort_array(F.collect_set(F.struct(F.col("line"), to.alias("to")))), lambda x: x["to"]).alias("firsts"),
    )


def line_decisions(df: DataFrame, key: str = "doc_id", text: str = "text", bands=ONE_EDIT) -> DataFrame:
    """One row per document with lines: key, n_lines, n_exact, n_near, n_links, dropped (line numbers), firsts (by line: the key of the document with the earliest line that is equal or near)."""
    return _decided(_named(df, key, text), bands).drop("_t").withColumnRenamed("_k", key)


def _left(text: bytes, dropped: list[int] | None) -> bytes:
    if not dropped:
        return text
    parts = text.split(b"\n")
    keep = bytearray(b"\x01") * len(parts)
    for n in dropped:
        keep[n] = 0
    return b"\n".join(compress(parts, keep))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", drop_emptied: bool = False, bands=ONE_EDIT) -> DataFrame:
    """``df`` with repeated lines cut from the texts; columns as they were. ``drop_emptied``: without the documents that keep no line but blank ones."""
    cut = saved(_other(_decided(_named(df, key, text), bands).filter(F.size("dropped") > 0).select("_k", "_t", F.col("dropped").alias("__dropped"))))
    names, at = df.columns, df.columns.index(text)
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(key).alias("_k"), F.xxhash64(text).alias("_t"))
    found = own.join(sized(cut), _same(own, cut), "left").select(*[F.col("__row").getField(c).alias(c) for c in names], F.col("__dropped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists = batch.column(at).cast(pa.string()), batch.column(len(names))
            for a, b in chunks(strings(column)):
                texts = column.slice(a, b - a)
                new = [x if x is None else _left(x, n) for x, n in zip(texts.cast(pa.binary()).to_pylist(), lists.slice(a, b - a).to_pylist())]
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                columns[at] = pa.array(new, pa.binary()).cast(pa.string())
                out = pa.RecordBatch.from_arrays(columns, names=names)
                if drop_emptied:
                    emptied = [bool(n) and not x.strip(_STRIP) for x, n in zip(new, lists.slice(a, b - a).to_pylist())]
                    out = out.filter(pa.array([not e for e in emptied], pa.bool_()))
                yield out

    return found.mapInArrow(tidy(run), df.schema)


def op3_line_dedup(spark, sf_dir: str, bands=ONE_EDIT) -> DataFrame:
    """Counts, the documents that lines came from first, and the digest of the text that is left, per document."""
    docs = _named(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = saved(_other(_decided(docs, bands)))
    # only what is dropped goes to the texts, and only their digests come back
    cut = saved(found.filter(F.size("dropped") > 0).select("_k2", "_t2", "dropped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = strings(batch.column("_text")), batch.column("dropped")
            for a, b in chunks(texts):
                left = [hashlib.sha256(_left(x, n)).hexdigest() for x, n in zip(texts.slice(a, b - a).cast(pa.binary()).to_pylist(), lists.slice(a, b - a).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("_k").slice(a, b - a), batch.column("_t").slice(a, b - a), pa.array(left)], names=["_k", "_t", "text_sha256"])

    kind = docs.schema["_k"].dataType
    schema = T.StructType([T.StructField("_k", kind), T.StructField("_t", T.LongType()), T.StructField("text_sha256", T.StringType())])
    digests = docs.join(sized(cut), _same(docs, cut), "left").select("_k", "_t", "_text", "dropped").mapInArrow(tidy(run), schema)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return digests.join(found, _same(digests, found), "left").select(F.col("_k").alias("doc_id"), zero("n_lines"), zero("n_exact"), zero("n_near"), zero("n_links"), "firsts", "text_sha256")
