"""Similarity of many pairs of texts at a time: padded arrays of code points, and one array step for each character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of the arrays that are worked on at a time.
CELLS = 1 << 21
_PAD_X, _PAD_Y = 0xFFFFFFFE, 0xFFFFFFFF


def code_points(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, longest) code points, padded behind, and the texts' lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(sizes.max(initial=0))), pad, np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _portions(x: list[str], y: list[str]) -> Iterator[np.ndarray]:
    """Numbers of pairs of about the same length, so many that their arrays stay small."""
    longest = np.maximum(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y)))
    order = np.argsort(longest, kind="stable")
    at = 0
    while at < len(order):
        to = at + max(1, CELLS // max(1, int(longest[order[at]])))
        while to > at + 1 and int(longest[order[min(to, len(order)) - 1]]) * (min(to, len(order)) - at) > 2 * CELLS:
            to = at + (to - at) // 2
        yield order[at:to]
        at = to


def _exchanges(places: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exchanges that bring the first m places of each row into order when the first takes every smaller one as it comes, then the second, and so on (the surveyed rule)."""
    out = np.zeros(len(places), np.int64)
    inside = np.arange(places.shape[1]) < m[:, None]
    rows = np.where(inside, places, np.iinfo(np.int32).max)
    odd = np.flatnonzero((rows[:, 1:] < rows[:, :-1]).any(axis=1))
    rows = rows[odd]
    for i in range(int(m[odd].max(initial=0)) - 1):
        least = np.minimum.accumulate(rows[:, i:], axis=1)[:, :-1]
        later = rows[:, i + 1 :]
        out[odd] += (later < least).sum(axis=1)
        rows[:, i + 1 :] = np.maximum(least, later)
    return out


def jaro_winkler(x: list[str], y: list[str]) -> np.ndarray:
    """Jaro-Winkler of each pair; a match is the first free equal character within reach, and transpositions are exchanges, each counted whole."""
    out = np.zeros(len(x))
    for part in _portions(x, y):
        out[part] = _jaro_winkler([x[i] for i in part], [y[i] for i in part])
    return out


def _jaro_winkler(x: list[str], y: list[str]) -> np.ndarray:
    a, p = code_points(x, _PAD_X)
    b, q = code_points(y, _PAD_Y)
    n, rows = len(x), np.arange(len(x))
    if not a.shape[1] or not b.shape[1]:
        return (p == q).astype(float)
    reach = np.maximum(np.maximum(p, q) // 2 - 1, 0)
    free = np.ones(b.shape, bool)
    places, m = np.zeros(a.shape, np.int32), np.zeros(n, np.int64)
    columns = np.arange(b.shape[1])
    widest = int(reach.max(initial=0))
    for i in range(a.shape[1]):
        low, high = max(0, i - widest), i + widest + 1
        near = columns[low:high]
        if not len(near):
            break
        met = (b[:, low:high] == a[:, i : i + 1]) & free[:, low:high] & (np.abs(near - i) <= reach[:, None])
        first = met.argmax(axis=1)
        hit = np.flatnonzero(met[rows, first])
        place = first[hit] + low
        free[hit, place] = False
        places[hit, m[hit]] = place
        m[hit] += 1
    some = m > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(some, (m / p + m / q + (m - _exchanges(places, m)) / m) / 3, 0.0)
    head = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1)
    return np.where((p == 0) | (q == 0), (p == q).astype(float), np.where(some, jaro + prefix * 0.1 * (1 - jaro), 0.0))


def within_edits(x: list[str], y: list[str], most: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``."""
    out = np.zeros(len(x), bool)
    for part in _portions(x, y):
        out[part] = _within_edits([x[i] for i in part], [y[i] for i in part], most)
    return out


def _within_edits(x: list[str], y: list[str], most: int) -> np.ndarray:
    """Rows of the distance table one by one, and of each only the cells at most ``most`` off the diagonal."""
    a, p = code_points(x, _PAD_X)
    b, q = code_points(y, _PAD_Y)
    n, width = len(x), 2 * most + 1
    far = np.int32(most + 1)
    # cell o of row i is column i + o - most
    shift = np.full((n, most), _PAD_Y, np.uint32)
    b = np.concatenate([shift, b, np.full((n, a.shape[1] + most + 1), _PAD_Y, np.uint32)], axis=1)
    table = np.full((n, width), far, np.int32)
    table[:, most:] = np.minimum(np.arange(width - most), far)
    result = np.where(p == 0, np.take_along_axis(table, np.clip(q - p + most, 0, width - 1)[:, None], 1)[:, 0], far)
    for i in range(1, a.shape[1] + 1):
        other = b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i]
        now = table + other
        now[:, :-1] = np.minimum(now[:, :-1], table[:, 1:] + 1)
        # left of the table there is nothing but its first column
        if i <= most:
            now[:, : most - i] = far
            now[:, most - i] = i
        for o in range(1, width):
            np.minimum(now[:, o], now[:, o - 1] + 1, out=now[:, o])
        table = np.minimum(now, far)
        ends = np.flatnonzero(p == i)
        result[ends] = table[ends, np.clip(q[ends] - i + most, 0, width - 1)]
        if not (table <= most).any():
            break
    return (np.abs(p - q) <= most) & (result <= most)
