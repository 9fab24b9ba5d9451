"""Bit-sliced comparison of 64-bit fingerprints.

Bits are stored vertically: plane b holds bit b of 64 fingerprints in each word. The distances of one fingerprint to all
others grow in carry-save counters, one word operation for 64 of them, and a comparison ends as soon as every distance is
over the radius.
"""

import numpy as np

from wayfind.llm.common import by_value
from wayfind.llm.components import forest

by_value(__name__)

SMALL = 64  # members of a group that are compared by distance in the group


def fingerprints(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``size`` hashes: a bit is set if it is set in over half of them."""
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        size = size[full]
        begin = np.cumsum(size) - size
        # Up to 255 hashes add up in bytes, eight of which are a word.
        parts = -(-size // 255)
        first = np.cumsum(parts) - parts
        at = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bytes_ = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8)
        count = np.add.reduceat(bytes_, first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * count > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 in each word."""
    n = (len(prints) + 63) // 64 * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, n: int, one: int, radius: int) -> np.ndarray:
    """Indexes of the n fingerprints that differ from ``one`` in at most radius bits."""
    width = (radius + 1).bit_length()
    counter = [np.zeros(planes.shape[1], np.uint64) for _ in range(width)]
    over = np.zeros(planes.shape[1], np.uint64)  # distances that passed the counters' range
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        carry = planes[b] ^ ones if one >> b & 1 else planes[b]
        for i in range(width):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if b % 8 == 7:
            more = over | above(counter, radius)
            if (more == ones).all():
                return np.zeros(0, np.int64)
    near = ~(over | above(counter, radius))
    return np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[:n])


def above(counter, radius):
    """Which of the vertical counters hold more than radius."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same = same & counter[i]
        else:
            more, same = more | (same & counter[i]), same & ~counter[i]
    return more


def linked(prints: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of indexes that join all linked fingerprints of a large bucket: a spanning forest of the links. Blocks of
    the others are compared with one fingerprint at a time."""
    edges, block = [], 1 << 16
    for at in range(0, len(prints), block):
        part = prints[at : at + block]
        planes = planes_of(part)
        for i in range(at + len(part) - 1):
            j = within(planes, len(part), int(prints[i]), radius) + at
            j = j[j > i]
            if len(j):
                edges.append(np.stack([np.full(len(j), i), j], 1))
        edges = [forest(np.concatenate(edges))] if edges else []
    return edges[0] if edges else np.zeros((0, 2), np.int64)


def linked_in_small(prints: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of indexes that are linked and lie in one bucket, for many small buckets one after another; ``end`` is the
    end of each fingerprint's bucket. Members k places apart are compared together, as planes of their differences."""
    edges = []
    here, k = np.arange(len(prints)), 1
    while True:
        here = here[here + k < end[here]]
        if not len(here):
            return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        i = here[within(planes_of(prints[here] ^ prints[here + k]), len(here), 0, radius)]
        edges.append(np.stack([i, i + k], 1))
        k += 1
