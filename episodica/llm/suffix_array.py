"""Suffix arrays by induced sorting, vectorised by buckets.

Suffixes are classified as smaller (S) or larger (L) than their successor. The leftmost S ones (LMS) sort all others:
scanning the buckets of first symbols upwards induces the L suffixes, scanning downwards the S ones; each bucket
is handled in waves, one array operation for all its suffixes. LMS substrings are sorted by such an inducing and named, and where
names repeat they are sorted recursively: pairs of neighbouring names are named anew, which doubles the length each time. (A second
induced pass over the names would have about as many buckets as names, each of one or two suffixes, so
that nothing would be left to vectorise.)
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the unique least."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    ahead = differs[np.searchsorted(differs, np.arange(n - 1))]
    return np.append(t[ahead] < t[ahead + 1], True)


def _deal(queues: list, t: np.ndarray, p: np.ndarray) -> None:
    """Append p, in order, to the queues of their symbols."""
    if len(p):
        symbol = t[p]
        order = np.argsort(symbol, kind="stable")
        cut = np.flatnonzero(np.diff(symbol[order])) + 1
        for part in np.split(p[order], cut):
            queues[t[part[0]]].append(part)


def _joined(parts: list) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes that the given order of LMS suffixes (by first symbol at least) induces."""
    seeds: list = [[] for _ in range(symbols)]
    _deal(seeds, t, lms)
    queues: list = [[] for _ in range(symbols)]
    larger = []
    for c in range(symbols):
        waves, now = [], _joined(queues[c])
        while len(now):
            waves.append(now)
            p = now[now > 0] - 1
            p = p[~is_s[p]]
            same = t[p] == c
            _deal(queues, t, p[~same])
            now = p[same]
        larger.append(_joined(waves))
        own = _joined(seeds[c])
        _deal(queues, t, own[own > 0] - 1)
    queues = [[] for _ in range(symbols)]
    queues[t[-1]].append(np.array([len(t) - 1]))
    smaller: list = [None] * symbols
    for c in range(symbols - 1, -1, -1):
        waves, now = [], _joined(queues[c])
        while len(now):
            waves.append(now)
            p = now[now > 0] - 1
            p = p[is_s[p]]
            same = t[p] == c
            _deal(queues, t, p[~same])
            now = p[same]
        smaller[c] = _joined(waves)[::-1]
        own = larger[c][::-1]
        p = own[own > 0] - 1
        _deal(queues, t, p[is_s[p]])
    return _joined([x for c in range(symbols) for x in (larger[c], smaller[c])])


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring (by place in lms); equal substrings share one."""
    length = np.diff(np.append(lms, len(t) - 1)) + 1
    place = np.zeros(len(t), np.int64)
    place[lms] = np.arange(len(lms))
    a, b = order[:-1], order[1:]
    la, lb = length[place[a]], length[place[b]]
    same = la == lb
    k, live = 0, np.flatnonzero(same)
    while len(live):
        alike = t[a[live] + k] == t[b[live] + k]
        same[live[~alike]] = False
        k += 1
        live = live[alike]
        live = live[la[live] > k]
    rank = np.zeros(len(lms), np.int64)
    rank[place[order]] = np.concatenate(([0], np.cumsum(~same)))
    return rank


def suffix_array(t: np.ndarray, symbols: int, depth: int | None = None) -> np.ndarray:
    """Suffixes of t (its last symbol the unique least) in order, ties beyond `depth` symbols in any order."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    is_s = classify(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    marked = np.zeros(len(t), bool)
    marked[lms] = True
    order = induce(t, is_s, lms, symbols)
    order = order[marked[order]]
    rank, reach = _names(t, lms, order), 1
    while len(lms) > 1 and rank.max() + 1 < len(lms) and (depth is None or reach < depth):
        after = np.full(len(rank), -1, np.int64)
        after[:-reach] = rank[reach:]
        pair = rank * (len(rank) + 1) + after + 1
        by = np.argsort(pair, kind="stable")
        rank = np.empty_like(rank)
        rank[by] = np.concatenate(([0], np.cumsum(np.diff(pair[by]) != 0)))
        reach *= 2
    return induce(t, is_s, lms[np.argsort(rank, kind="stable")], symbols)


def common_prefixes(t: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each suffix given, in text order, its common prefix with the one before it in `suffixes`, up to `most`.

    The first has 0. Read as [rank] -> length by common_prefixes(...)[suffixes].
    """
    before = np.full(len(t), -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    live = np.flatnonzero(before >= 0)
    out = np.zeros(len(t), np.int64)
    padded = np.concatenate([t, np.full(4, -1, t.dtype)]).astype(np.int16)
    four = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 4)).view("<u8").ravel()
    k = 0
    while len(live) and k < most:
        inside = (live + k < len(t)) & (before[live] + k < len(t))
        live = live[inside]
        alike = four[live + k] == four[before[live] + k]
        left = live[~alike]
        out[left] = k
        for j in range(4):  # where the four differ
            left = left[(left + k + j < len(t)) & (before[left] + k + j < len(t))]
            left = left[t[left + k + j] == t[before[left] + k + j]]
            out[left] = k + j + 1
        live = live[alike]
        k += 4
        out[live] = k
    return np.minimum(out, most)
