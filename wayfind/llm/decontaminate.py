"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Texts and items are their lower-cased words (ASCII letters and digits, and everything beyond ASCII). A window with as
many words as an item (the whole text if that has fewer) is compared with it by weighted shingles: shingles of five words,
or of all if there are fewer, weighted by how often they occur; the similarity is the sum of the smaller weights over
the sum of the larger ones.

A window without a shingle of an item has a similarity of zero, so only the stretches around shared shingles are
windowed, at every word. Each window's 64-bit fingerprint comes from running sums of its shingles' bits. Eight blocks of
eight bits index the items' fingerprints of that length: a fingerprint within ``radius`` bits is within radius // 8 of
the item in some block, so each block's value has a list of the items that are so near, and the eight lists miss none.
Of these candidates those within the radius are verified exactly, by counts that follow the window from word to word. The
radius is wide: at a similarity of 0.8 the distance is about 10 with a deviation of 3.

Documents stay where they are: there is no shuffle, and a document's size or a hot item moves nothing. The benchmark
is read in blocks whose size is checked, each sent to all tasks: one block up to ``most`` bytes, more passes beyond.

Null texts are empty, and items without words match nothing. Rows of the result are in documents' own ids: repeated rows
give repeated results, null ids stay null. Other columns are ignored; empty tables give an empty result.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.cells import mix
from wayfind.llm.common import by_value, drop, save, table, trimmed
from wayfind.llm.license_scan import WORDS

by_value(__name__)

SHINGLE, LEAST, RADIUS, MOST = 5, 0.8, 20, 8 << 20
PAIRS = 1 << 21  # pairs of windows and items that are compared at once
STEP = 1 << 16  # windows whose fingerprints are made at once
COLUMNS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def shingles(words: list[bytes], k: int) -> list[bytes]:
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def similarities(pieces: list[bytes], starts: list[int], n: int, own: Counter):
    """(start, similarity) of the windows of n pieces at ``starts``, which rise, to an item's weighted shingles."""
    whole = sum(own.values())
    held, both, low, high = Counter(), 0, 0, 0  # of the window from low to high
    for i in starts:
        if i >= high:
            held, both, low, high = Counter(), 0, i, i
        for p in pieces[high : i + n]:
            if p in own:
                held[p] += 1
                both += held[p] <= own[p]
        for p in pieces[low:i]:
            if p in own:
                both -= held[p] <= own[p]
                held[p] -= 1
        low, high = i, i + n
        yield i, both / (n + whole - both)


def fingerprints(pieces: list[bytes], n: int, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of n pieces at ``starts``: a bit is set if it is in over half of the hashes. Running sums
    are kept for eight bits at a time, and for STEP windows."""
    h = np.array([xxhash.xxh64_intdigest(p) for p in pieces], np.uint64).view(np.uint8).reshape(-1, 8)
    out = np.empty((len(starts), 8), np.uint8)
    for at in range(0, len(starts), STEP):
        own = starts[at : at + STEP]
        low = int(own[0])
        part = h[low : int(own[-1]) + n]
        for b in range(8):
            sums = np.zeros((len(part) + 1, 8), np.int32)
            np.cumsum(np.unpackbits(part[:, b : b + 1], axis=1, bitorder="little"), axis=0, out=sums[1:])
            out[at : at + STEP, b] = np.packbits(2 * (sums[own - low + n] - sums[own - low]) > n, axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


class Index:
    """Items by number of words: shingles, fingerprints and their blocks."""

    def __init__(self, items: list[tuple[int, str]], radius: int):
        self.radius, self.vocabulary = radius, {}
        self.items, keys = [], {}
        value = np.arange(256, dtype=np.uint8)
        for item, text in items:
            words = words_of((text or "").encode())
            if not words:
                continue
            k = min(SHINGLE, len(words))
            pieces = shingles(words, k)
            n = len(self.items)
            self.items.append((item, len(words), Counter(pieces), fingerprints(pieces, len(pieces), np.zeros(1, np.int64))[0]))
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            for key in set(self.keys(ids, k).tolist()):
                keys.setdefault((k, key), set()).add(n)
        self.sizes = sorted({k for k, _ in keys})
        self.by_key = {k: {key: tuple(v) for (size, key), v in keys.items() if size == k} for k in self.sizes}
        self.sorted = {k: np.array(sorted(self.by_key[k]), np.uint64) for k in self.sizes}
        self.of_length: dict[int, list[int]] = {}
        for n, (_, size, _, _) in enumerate(self.items):
            self.of_length.setdefault(size, []).append(n)
        self.near = {}  # by length: for each of 8 blocks where the list of each value begins, and the lists on end
        for size, own in self.of_length.items():
            prints = np.array([self.items[n][3] for n in own], np.uint64)
            blocks = prints.view(np.uint8).reshape(-1, 8)
            lists = [np.nonzero(np.bitwise_count(value[:, None] ^ blocks[None, :, b]) <= radius // 8) for b in range(8)]
            self.near[size] = prints, [(np.searchsorted(v, np.arange(257)), n.astype(np.int32)) for v, n in lists]

    @staticmethod
    def keys(ids: np.ndarray, k: int) -> np.ndarray:
        """A key for each run of k word ids."""
        out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = mix(out + ids[i : i + len(out)].astype(np.uint64) + np.uint64(1))
        return out

    def candidates(self, length: int, prints: np.ndarray):
        """(window, item's number among those of the length) of all pairs within the radius, by the blocks' lists. So many
        windows go at once that the lists of a block hold PAIRS pairs at most, or those of one window."""
        own, lists = self.near[length]
        blocks = prints.view(np.uint8).reshape(-1, 8)
        pairs, step = [], max(1, PAIRS // max(1, len(own)))
        for at in range(0, len(prints), step):
            for b, (begin, items) in enumerate(lists):
                value = blocks[at : at + step, b]
                first, n = begin[value], begin[value.astype(np.int64) + 1] - begin[value]
                window = at + np.repeat(np.arange(len(value)), n)
                item = items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
                near = np.bitwise_count(prints[window] ^ own[item]) <= self.radius
                pairs.append(window[near] * len(own) + item[near])
        return np.divmod(np.unique(np.concatenate(pairs)), len(own))

    def search(self, words: list[bytes], hits: dict[int, list[int]], least: float):
        """(item, similarity, first word, words) of a text: hits are places of shingles by item number."""
        lengths: dict[int, list[int]] = {}
        for n, places in hits.items():
            lengths.setdefault(self.items[n][1], []).extend(places)
        best: dict[int, tuple] = {}
        for length, places in lengths.items():
            size = min(length, len(words))
            k = min(SHINGLE, length)
            if size < k:
                continue
            # A window with a shingle begins at most size - k words before it.
            at = np.array(places, np.int64)
            step = np.zeros(len(words) + 2, np.int64)
            np.add.at(step, np.clip(at - (size - k), 0, len(words) - size), 1)
            np.add.at(step, np.clip(at, 0, len(words) - size) + 1, -1)
            starts = np.flatnonzero(np.cumsum(step) > 0)
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
                low, high = int(group[0]), int(group[-1]) + size
                pieces, n_pieces = shingles(words[low:high], k), size - k + 1
                for part in np.split(group - low, range(STEP, len(group), STEP)):
                    window, item = self.candidates(length, fingerprints(pieces, n_pieces, part))
                    for j in np.unique(item).tolist():
                        n = self.of_length[length][j]
                        for i, s in similarities(pieces, part[window[item == j]].tolist(), n_pieces, self.items[n][2]):
                            if s >= least and (n not in best or s > best[n][1]):
                                best[n] = (self.items[n][0], s, low + i, size)
        return [best[n] for n in sorted(best)]

    def scan(self, texts: list[bytes], least: float):
        """(text's number, item, similarity, first word, words)."""
        split = [words_of(t) for t in texts]
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for words in split for w in words], np.int64)
        begin = np.cumsum([0, *map(len, split)])
        hits: dict[int, dict[int, list[int]]] = {}
        known = np.flatnonzero(ids >= 0)
        for k in self.sizes:
            run = known[: max(0, len(known) - k + 1)]
            run = run[known[k - 1 :][: len(run)] == run + k - 1] if len(run) else run  # k known words on end
            if not len(run):
                continue
            key = np.zeros(len(run), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(k):
                    key = mix(key + ids[run + i].astype(np.uint64) + np.uint64(1))
            found = self.sorted[k][np.minimum(np.searchsorted(self.sorted[k], key), len(self.sorted[k]) - 1)] == key
            run, key = run[found], key[found]
            text = np.searchsorted(begin, run, side="right") - 1
            inside = run + k <= begin[text + 1]
            for t, p, x in zip(text[inside].tolist(), (run - begin[text])[inside].tolist(), key[inside].tolist(), strict=True):
                for n in self.by_key[k][x]:
                    hits.setdefault(t, {}).setdefault(n, []).append(p)
        for t in sorted(hits):
            for row in self.search(split[t], hits[t], least):
                yield t, *row


def scanned(items, radius, least):
    def run(batches):
        index = Index(items.value, radius)
        for b in batches:
            out, ids = [], b.column(0).to_pylist()
            at, size = 0, 0
            texts: list[bytes] = []
            for i, t in enumerate(b.column(1)):
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1])
                if size > 1 << 20 or i == b.num_rows - 1:
                    out += [(ids[at + n], *row) for n, *row in index.scan(texts, least)]
                    at, size, texts = i + 1, 0, []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def block_count(items: DataFrame, most: int) -> int:
    """How many blocks of about ``most`` bytes the items (item_id, text) make."""
    return -(-items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0] // most)


def blocks_of(items: DataFrame, n: int):
    """Broadcasts of the items, one block after another."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")))


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """COLUMNS: a row for each document (doc_id, text) and item (item_id, text) where a window reaches ``least``, with
    the most similar window (the first of equals)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks_of(items, block_count(items, most)):
        found = rows.mapInArrow(trimmed(scanned(block, radius, least)), COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], COLUMNS)


def clean_documents(docs: DataFrame, items: DataFrame, least: float = LEAST, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """The documents without a window of any item, with their columns, without a shuffle. Each block of items is a pass over the
    documents that are left, so no task holds more than one block; between passes these are written to the shared folder."""

    def kept(block):
        def run(batches):
            index = Index(block.value, radius)
            for b in batches:
                texts = [(t or "").encode() for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                keep = np.ones(b.num_rows, bool)
                for at in range(0, b.num_rows, 200):
                    for n, *_ in index.scan(texts[at : at + 200], least):
                        keep[at + n] = False
                yield b.filter(pa.array(keep))

        return run

    n, left, own = block_count(items, most), docs, None
    for k, block in enumerate(blocks_of(items, n)):
        left = left.mapInArrow(trimmed(kept(block)), docs.schema)
        if k < n - 1:
            left = save(left, "clean")
            drop(own)
            block.destroy()
            own = left
    return left


def op3_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Exact similarities of all windows around shared shingles, without fingerprints.
OP3_SQL = rf"""
with w as (select r, id, kind, regexp_extract_all(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from (
  select row_number() over () as r, doc_id as id, 'doc' as kind, text as t from documents union all select row_number() over (), item_id, 'item', text from benchmark)),
items as (select r, id, ws, len(ws) as n, least({SHINGLE}, len(ws)) as k from w where kind = 'item' and len(ws) > 0),
owned as (select r, array_to_string(list_slice(ws, p + 1, p + k), ' ') as s, count(*) as c from (select r, ws, k, unnest(range(n - k + 1)) as p from items) group by 1, 2),
docs as (select r, id, ws, len(ws) as n from w where kind = 'doc' and len(ws) > 0),
shingled as (select r, n, k, p, array_to_string(list_slice(ws, p + 1, p + k), ' ') as s from (select docs.r, ws, n, k, unnest(range(n - k + 1)) as p from docs, (select distinct k from items) where n >= k)),
hits as (select d.r as doc, i.r as item, d.p, d.s, o.c, least(i.n, d.n) as size, i.k, i.n as whole, d.n from shingled d join owned o on o.s = d.s join items i on i.r = o.r and i.k = d.k),
starts as (select distinct doc, item, size, k, whole, unnest(range(greatest(0, least(p - (size - k), n - size)), least(p, n - size) + 1)) as a from hits),
shared as (select x.doc, x.item, x.a, x.size, x.k, x.whole, h.s, least(count(*), any_value(h.c)) as c from starts x join hits h on h.doc = x.doc and h.item = x.item and h.p between x.a and x.a + x.size - x.k group by all),
sums as (select doc, item, a, size, sum(c) / cast(any_value((size - k + 1) + (whole - k + 1)) - sum(c) as double) as similarity from shared group by doc, item, a, size)
select docs.id as doc_id, items.id as item_id, similarity, cast(a as bigint) as first_word, cast(size as bigint) as n_words
from sums join docs on docs.r = doc join items on items.r = item where similarity >= {LEAST}
qualify row_number() over (partition by doc, item order by similarity desc, a) = 1
"""
