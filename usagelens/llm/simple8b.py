"""Simple-8b: integers packed into 64-bit words.

A word's top 4 bits select how many equally wide values its other 60 bits
hold. A value of 60 bits or more is an escape: a word with selector 14,
followed by the raw value. Values are coded in segments of ``SEGMENT``; each
segment starts a new word and its word offset is stored, so all segments are
packed and unpacked side by side with numpy.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
# values in a word and their width, by selector
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
            (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 14
SEGMENT = 128
_COUNT = np.array([n for n, _ in PACKINGS] + [1], np.int64)
_PAD = PACKINGS[0][0]


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < U(1 << 53):  # exact as doubles
        return np.frexp(values.astype(np.float64))[1].astype(np.int8)
    high, low = (values >> U(32)).astype(np.float64), (values & U(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.int8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): 64-bit words and the first word of each segment."""
    values = np.ascontiguousarray(values, np.uint64)
    n_seg = -(-len(values) // SEGMENT)
    if not n_seg:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    grid = np.zeros((n_seg, SEGMENT + _PAD), np.uint64)
    flat = np.zeros(n_seg * SEGMENT, np.uint64)
    flat[:len(values)] = values
    grid[:, :SEGMENT] = flat.reshape(n_seg, SEGMENT)
    bits = np.zeros(grid.shape, np.int8)
    bits[:, :SEGMENT] = _bit_lengths(flat).reshape(n_seg, SEGMENT)
    # selector at each position: the one that holds most values
    selector = np.full((n_seg, SEGMENT), ESCAPE, np.int8)
    widest = {1: bits}
    for s in range(len(PACKINGS) - 1, -1, -1):
        n, width = PACKINGS[s]
        if n not in widest:  # the maximum over n values from two overlapping shorter windows
            m = max(k for k in widest if k < n)
            while 2 * m < n:
                widest[2 * m] = _pair_max(widest[m], m)
                m *= 2
            widest[n] = _pair_max(widest[m], n - m)
        selector[widest[n][:, :SEGMENT] <= width] = s
    # follow the words of all segments side by side
    at, rows = np.zeros(n_seg, np.int64), np.arange(n_seg)
    seg_of, pos_of = [], []
    while len(rows):
        seg_of.append(rows)
        pos_of.append(at[rows])
        at[rows] += _COUNT[selector[rows, at[rows]]]
        rows = rows[at[rows] < SEGMENT]
    seg, pos = np.concatenate(seg_of), np.concatenate(pos_of)
    order = np.argsort(seg, kind="stable")  # positions already ascend
    seg, pos = seg[order], pos[order]
    sel = selector[seg, pos].astype(np.int64)
    size = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    cell, cells = seg * grid.shape[1] + pos, grid.reshape(-1)
    for s in np.unique(sel):
        pick = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[place[pick]] = U(ESCAPE) << U(60)
            words[place[pick] + 1] = cells[cell[pick]]
            continue
        n, width = PACKINGS[s]
        at = cell[pick]
        out = np.full(len(pick), U(int(s)) << U(60))
        for k in range(n):
            out |= cells[at + k] << U(k * width)
        words[place[pick]] = out
    first = np.searchsorted(seg, np.arange(n_seg))
    return words, place[first].astype(np.int32)


def _pair_max(window: np.ndarray, shift: int) -> np.ndarray:
    """Maximum of each window and the one ``shift`` further; behind the end
    the padding's zeros do not count."""
    out = window.copy()
    if shift < window.shape[1]:
        np.maximum(out[:, :-shift], window[:, shift:], out=out[:, :-shift])
    return out


def decode(words: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` values of ``encode``'s words."""
    words = np.ascontiguousarray(words, np.uint64)
    out = np.zeros((len(offsets), SEGMENT), np.uint64)
    if not len(offsets):
        return out.reshape(-1)[:count]
    sel = (words >> U(60)).astype(np.int64)
    # raw values behind an escape are no packed words; an escape may be told
    # apart from a raw value only from the segment's start on
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    n = _COUNT[np.minimum(sel, ESCAPE)].copy()
    n[raw] = 0
    before = np.cumsum(n) - n
    seg = np.zeros(len(words), np.int64)
    seg[offsets[1:]] = 1
    seg = np.cumsum(seg)
    local = before - before[offsets][seg]
    for s in np.unique(sel[~raw]):
        pick = np.flatnonzero((sel == s) & ~raw)
        if s == ESCAPE:
            out[seg[pick], local[pick]] = words[pick + 1]
            continue
        width = PACKINGS[s][1]
        mask = U((1 << width) - 1)
        for k in range(PACKINGS[s][0]):
            inside = local[pick] + k < SEGMENT
            p = pick[inside]
            out[seg[p], local[p] + k] = (words[p] >> U(k * width)) & mask
    return out.reshape(-1)[:count]
