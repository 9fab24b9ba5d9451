"""Suffix order, longest common prefixes and longest previous factors of chosen starts in a byte array."""

import numpy as np

from wayfind.llm.common import by_value

by_value(__name__)


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int, first=None):
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes (by ``first`` before that), and each one's
    common prefix with the one before it, at most ``depth`` (0 where ``first`` differs). ``data`` has ``depth`` bytes
    at least after each start."""
    n, words = len(starts), (depth + 7) // 8
    padded = np.r_[data, np.zeros(8 * words, np.uint8)]
    eight = np.zeros(len(data), np.uint64)  # eight bytes from each place, big-endian
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(data)].astype(np.uint64)
    rest = depth - 8 * (words - 1)
    keep = np.uint64(((1 << (8 * rest)) - 1) << (64 - 8 * rest))
    at = [starts + 8 * k for k in range(words)]
    word = lambda k, order: eight[np.minimum(at[k][order], len(data) - 1)] & (keep if k == words - 1 else np.uint64(0xFFFFFFFFFFFFFFFF))
    group = np.zeros(n, np.int64) if first is None else np.unique(first, return_inverse=True)[1].astype(np.int64)
    order = np.arange(n)
    every = np.arange(n)
    rank = group
    common = np.zeros(n, np.int64)
    # One word after another; only suffixes that still tie are sorted again.
    open_ = every
    for k in range(words):
        if not len(open_):
            break
        w = word(k, order[open_])
        again = np.lexsort((w, rank[open_]))
        order[open_] = order[open_][again]
        w, r = w[again], rank[open_][again]
        same = np.r_[False, (r[1:] == r[:-1]) & (np.diff(open_) == 1)]
        equal = same & np.r_[False, w[1:] == w[:-1]]
        differ = np.flatnonzero(same & ~equal)
        x = w[differ] ^ w[differ - 1]
        lead = np.zeros(len(x), np.int64)
        for b in range(8):
            lead += (x >> np.uint64(56 - 8 * b)) == 0
        common[open_[differ]] = 8 * k + lead
        common[open_[equal]] = min(8 * (k + 1), depth)
        run = np.cumsum(~equal)
        rank[open_] = open_[np.flatnonzero(~equal)][run - 1]
        tied = equal | np.r_[equal[1:], False]
        open_ = open_[tied]
    return order, common


def nearest_smaller(position: np.ndarray, common: np.ndarray, tie=None):
    """Of each rank the nearest rank before it with a smaller position (-1: none), and the common prefix with it.
    Pointers jump over ranks that are larger than the one they start from, all ranks at once."""
    n = len(position)
    prev, least = np.arange(n) - 1, common.copy()
    active = np.flatnonzero(prev >= 0)
    active = active[position[prev[active]] >= position[active]]
    while len(active):
        p = prev[active]
        to, low = prev[p].copy(), np.minimum(least[active], least[p])
        prev[active], least[active] = to, low
        active = active[to >= 0]
        active = active[position[prev[active]] >= position[active]]
    least[prev < 0] = 0
    return prev, least


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, position: np.ndarray, depth: int, first=None) -> np.ndarray:
    """For each start the length, at most ``depth``, of the longest prefix of its suffix that a start with a smaller
    position has too: the larger common prefix with the previous and the next smaller position in suffix order.
    ``first``: suffixes meet only where it is equal."""
    order, common = suffix_order(data, starts, depth, first)
    pos = position[order]
    _, before = nearest_smaller(pos, common)
    flipped = np.r_[0, common[1:][::-1]] if len(common) else common
    _, after = nearest_smaller(pos[::-1], flipped)
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out
