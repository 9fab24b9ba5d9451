"""Byte-level BPE encoding and decoding with two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary gives each pre-token one slot, which holds a token and its id; a
comparison with that token tells whether the pre-token is it. Tier two, for the others: bytes in a linked list, with the merges that are
possible in a heap by (rank, place); an entry that a merge has outdated is skipped. That is O(n log n) for a pre-token
of any length. Pre-tokens already met are remembered, up to a fixed number of them, which changes no result.

The vocabulary is a parameter (lines of base64 token and rank) and is read by each task; it is bounded and small.

Null texts are empty: no ids. Texts of any length are encoded whole, special tokens' strings as ordinary text. doc_id is
passed through; repeated rows get a row each; other columns are ignored; an empty table gives an empty result.
"""

import base64
import hashlib
import struct
import sys
import types
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import by_value, table, trimmed
from wayfind.llm.cells import mix

by_value(__name__)

REMEMBERED = 250_000


class PerfectHash:
    """A minimal perfect hash of 64-bit key hashes: in each level the keys that are alone in their slot take it, the
    others go to the next level; a slot's number is the count of taken slots before it."""

    def __init__(self, hashes: np.ndarray, room: float = 1.5):
        self.levels, self.n, base = [], len(hashes), 0
        while len(hashes):
            size = max(64, int(len(hashes) * room))
            slot = self.slots(hashes, len(self.levels), size)
            taken = np.bincount(slot, minlength=size) == 1
            self.levels.append((size, taken, base + np.cumsum(taken) - taken))
            base += int(taken.sum())
            hashes = hashes[~taken[slot]]

    @staticmethod
    def slots(hashes, level, size):
        with np.errstate(over="ignore"):
            return (mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Number from 0 to n - 1 of each key; of a foreign key any such number, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (size, taken, number) in enumerate(self.levels):
            slot = self.slots(hashes[open_], level, size)
            hit = taken[slot]
            out[open_[hit]] = number[slot[hit]]
            open_ = open_[~hit]
        return out


class BPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        keys = list(self.ranks)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        self.hash = PerfectHash(hashes)
        self.slots: list = [(b"", b"")] * len(keys)  # by the hash's number: the token, and its packed id
        for k, i in zip(keys, self.hash(hashes).tolist(), strict=True):
            self.slots[i] = k, struct.pack("<I", self.ranks[k])
        self.known: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0: none does
        before = list(range(-1, n))  # begin of the part before the one that begins here
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue
            end[i], end[j] = e, 0
            before[e] = i
            if e < n and (r := ranks.get(piece[i : end[e]])) is not None:
                heappush(heap, (r, i, end[e]))
            p = before[i]
            if p >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def looked_up(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that aren't remembered."""
        raw = [p.encode() for p in pieces]
        slots = self.hash(np.array([xxhash.xxh64_intdigest(b) for b in raw], np.uint64)).tolist()
        out = {}
        for p, b, s in zip(pieces, raw, slots, strict=True):
            token, packed = self.slots[s]  # -1 is the last slot, whose token differs too
            out[p] = packed if token == b else struct.pack(f"<{len(ids := self.merged(b))}I", *ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        used = set().union(*split)
        known = self.known
        new = self.looked_up(list(used.difference(known)))
        if len(known) < REMEMBERED:
            known.update(new)
        elif new:
            known = {p: known[p] for p in used.intersection(known)} | new
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> BPE:
    """The process's encoder: what one task remembers, later tasks of the worker find."""
    home = sys.modules.setdefault("_wayfind_encoders", types.ModuleType("_wayfind_encoders")).__dict__
    if (path, pattern) not in home:
        home[path, pattern] = BPE(path, pattern)
    return home[path, pattern]


COLUMNS = "doc_id long, ids binary, decoded binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def coded(path, pattern, whole):
    def run(batches):
        bpe = encoder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                texts = [bpe.decode(i) for i in ids]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                nulls = pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()) if whole else nulls, pa.array(texts, pa.binary()) if whole else nulls, pa.array([len(i) // 4 for i in ids], pa.int64()), sha(ids), sha(texts)], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, whole: bool = True) -> DataFrame:
    """COLUMNS of each document (doc_id, text): ids (little-endian unsigned 32-bit integers), decoded bytes, their count
    and digests. ids and decoded are null unless ``whole``. path: the rank file, where each executor can open it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(coded(path, pattern, whole)), COLUMNS)


def op8_byte_bpe(spark, sf_dir, docs=None):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, whole=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
