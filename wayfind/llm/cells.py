"""Content-defined cells: a way to bring equal byte strings together without moving every suffix.

Every string of ``size`` bytes holds ``size - K + 1`` K-grams; the one with the smallest hash (the leftmost of
equals) is its anchor. The anchor depends on the string's bytes alone, so equal strings have equal anchors at equal
offsets. The starts of one text fall into runs with the same anchor: a cell is such a run, about ``(size - K + 2) / 2``
starts. Two equal strings always lie in cells whose anchors have the same hash.
"""

import numpy as np

from wayfind.llm.common import by_value

by_value(__name__)

K = 32  # bytes of an anchor; half of it goes into the hash by doubling, so a power of two
POS = 23  # bits of a position in a chunk
CHUNK = 1 << 19  # bytes that are hashed at once, which bounds a task's memory

_rng = np.random.RandomState(20240)
BYTE = _rng.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + _rng.randint(0, 4, 256).astype(np.uint64)
MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    """A bijection of 64-bit integers that spreads each bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hash(values, size):
    """Hash of every run of ``size`` values (a polynomial modulo 2**64, by doubling): len - size + 1 hashes."""
    done, whole, power, total = 1, values, MULT, None  # whole: hash of runs of `done` values
    left, taken = size, 0
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = whole[taken : len(values) - size + 1 + taken]
                total = part.copy() if total is None else total * power + part
                taken += done
            left >>= 1
            if left:
                whole = whole[: len(whole) - done] * power + whole[done:]
                power, done = power * power, done * 2
    return total


def sliding_min(keys, width):
    """Minimum of every run of ``width`` keys."""
    done, best = 1, keys
    while done * 2 <= width:
        best = np.minimum(best[: len(best) - done], best[done:])
        done *= 2
    n = len(keys) - width + 1
    return np.minimum(best[:n], best[width - done : width - done + n]) if done < width else best


def powers(n):
    """MULT ** i and its inverse for i < n."""
    inverse = np.uint64(pow(int(MULT), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, MULT)]), np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse)])


def cells(data, ends, size, tables):
    """Cells of the texts in ``data`` (uint8), which end at ``ends``: arrays of first start, number of starts, anchor's
    hash and content's hash (over the cell's bytes and the anchor's place in it)."""
    n = len(data)
    if n < size or n < K:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    up, down = tables
    with np.errstate(over="ignore"):
        code = BYTE[data]
        anchor = mix(gram_hash(code, K))
        key = (anchor >> np.uint64(POS) << np.uint64(POS)) | np.arange(len(anchor), dtype=np.uint64)
        at = (sliding_min(key, size - K + 1) & np.uint64((1 << POS) - 1)).astype(np.int64)  # of each start
        good = np.ones(len(at) + 1, bool)
        good[-1] = False
        for e in ends:  # the starts from which a string would run over a text's end
            good[max(0, e - size + 1) : min(e, len(at))] = False
        edge = np.flatnonzero((np.diff(at, prepend=-1) != 0) | ~good[:-1] | ~np.r_[False, good[:-2]])
        edge = edge[good[edge]]
        if not len(edge):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        bad = np.flatnonzero(~good)
        stop = np.minimum(np.r_[edge[1:], len(at)], bad[np.searchsorted(bad, edge)])
        total = np.r_[np.uint64(0), np.cumsum(code * up[:n])]
        content = (total[stop + size - 1] - total[edge]) * down[edge]
        content = mix(content ^ ((at[edge] - edge).astype(np.uint64) << np.uint64(20)) ^ (stop - edge).astype(np.uint64))
    return edge, stop - edge, anchor[at[edge]], content
