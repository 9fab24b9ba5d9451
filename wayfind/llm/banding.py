"""MinHash banding: classes of near-equal units of text (paragraphs, or whole texts), verified exactly.

A unit is a list of words; its MinHash comes from its five-word shingles. Bands are tuned for recall: the longest rows
that, within a number of hash functions, still find a pair at the threshold with the wanted probability.

1. Each task sends, for each band of each different unit it holds, a cell (band key, unit's hash, fingerprint, place), packed
   by bucket of the key. Equal units of a task go once.
2. Where a key holds several units, these are asked for by document and come back, with their exact shingle sets, under
   the key. A key with more than ``block`` units is cut into blocks, each of which meets the first one.
3. Each group computes exact Jaccard similarities and gives a spanning forest of its links. Connected components of the
   links, and equal units, are the classes.
4. In a key that has been cut, blocks other than the first have not met each other. Units of one component need not. So
   those outside the key's largest component meet all of the key's units in a second round, block by block: a large group of
   copies costs as many comparisons as it has units, and no pair of different components is left out.
5. Every occurrence whose class has another one gets a row; the first of a class (smallest doc_id, then place) is kept,
   the others are removals. Counts and first places are aggregated before they are joined, and adaptive execution splits
   the joins where a class holds a large part of all rows.

With a ``radius``, units also have SimHash fingerprints, of their different shingles, and only pairs within the radius are
verified (bits.py): in a key's group by bit planes, in many small groups at once by lag.

Equality of units is that of 128-bit hashes; within a key, and as vertices, of 64 bits.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.bits import SMALL, fingerprints, linked_in_small, planes_of, within
from wayfind.llm.cells import mix
from wayfind.llm.common import (
    DOC_BLOBS,
    LOWER,
    NO_ID,
    buckets_for,
    by_value,
    doc_key,
    each_bucket,
    groups,
    hold,
    keyed_rows,
    numbered,
    pack,
    pack_docs,
    pack_with,
    partitions,
    sorted_by_bucket,
    spread,
    texts_of,
    trimmed,
    unpack,
    unpack_all,
    unpack_docs,
    unpack_with,
)
from wayfind.llm.components import components, forest

by_value(__name__)

SHINGLE, THRESHOLD, RECALL, HASHES, BLOCK = 5, 0.8, 0.995, 48, 4000
PART = 31  # a place in a text is below 2 ** 31, as texts are; the part of a document stands above it
STEP = 1 << 20  # bytes of text that are hashed at once
FLUSH = 1 << 18  # cells that a task holds before it deals them out
ASK, LATER = 0, 1
ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
ASKED_SQL = "kind int, bucket int, blob binary"
ROWS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
ROWS_SQL = "bucket int, blob binary"
CELLS = ("<u8", "<u8", "<u8", "<i8", "<i8")  # band key, unit's hash, fingerprint, doc_id, place
SETS = ("<u8", "<u8", "<u8", "<u4")  # key, unit's hash, fingerprint, shingles


def tune_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, and for these the fewest bands, with which a pair at the threshold shares a band
    with a probability of ``recall``."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return hashes, 1


def whole(text: bytes):
    """A whole text as its only paragraph, number 0, with words or without."""
    yield 0, 0, text.translate(LOWER).split()


def name_of(words: list[bytes]) -> tuple[int, int]:
    """128-bit hash of a paragraph."""
    h = xxhash.xxh3_128_intdigest(b" ".join(words))
    return h >> 64, h & (1 << 64) - 1


def shingle_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, one paragraph after another, and each one's number of them."""
    flat = [w for ws in words for w in ws]
    known = {w: xxhash.xxh64_intdigest(w) for w in set(flat)}
    h = np.array([known[w] for w in flat], np.uint64)
    size = np.array([len(ws) for ws in words], np.int64)
    n = np.maximum(size - SHINGLE + 1, 1)
    begin = np.cumsum(size) - size
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    last = np.repeat(begin + size, n)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            inside = at + k < last
            out = np.where(inside, mix(out + h[np.minimum(at + k, len(h) - 1)] + np.uint64(k)), out)
    return out, n


def band_keys(shingles: np.ndarray, n: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys by paragraph and band."""
    factors = mix(np.arange(1, 2 * bands * rows + 1).astype(np.uint64))
    begin = np.cumsum(n) - n
    keys = np.zeros((len(n), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            for r in range(rows):
                k = 2 * (b * rows + r)
                least = np.minimum.reduceat(shingles * (factors[k] | np.uint64(1)) + factors[k + 1], begin)
                keys[:, b] = mix(keys[:, b] + least + np.uint64(b))
    return keys


def deal(key, arrays, ids):
    bucket = spread(key, ids)
    order = np.argsort(bucket, kind="stable")
    return [(int(k), pack(*(a[order[s]] for a in arrays))) for k, s in groups(bucket[order])]


def prints_of(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of units, of their different shingles."""
    unit = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        key = shingles + mix(unit.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[order[1:][key[order][1:] == key[order][:-1]]] = False
    return fingerprints(shingles[new], np.bincount(unit[new], minlength=len(n)))


def cells(cut, bands, rows, ids, radius):
    """mapInArrow function: cells of the different units of a task, by band key. Fingerprints are 0 without a radius."""

    def run(batches):
        held, count, size = [], 0, 0
        seen: set = set()
        new: list = []  # (doc_id, place, name, words)

        def hashed():
            shingles, n = shingle_hashes([w for *_, w in new])
            keys = band_keys(shingles, n, bands, rows)
            prints = np.zeros(len(n), np.uint64) if radius is None else prints_of(shingles, n)
            doc, place, name = (np.array([x[k] for x in new], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.uint64)))
            held.append((keys.ravel(), *(np.repeat(a, bands) for a in (name, prints, doc, place))))
            new.clear()

        def flush():
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            seen.clear()
            return keyed_rows(ROWS, deal(arrays[0], arrays, ids))

        for d, part, t in texts_of(batches):
            for i, _, words in cut(t):
                name = name_of(words)
                if words and name not in seen:
                    seen.add(name)
                    new.append((d, (part << PART) + i, name[0], words))
                    size += 7 * len(words)
            if size > STEP:
                count += bands * len(new)
                hashed()
                size = 0
            if count > FLUSH:
                yield flush()
                count = 0
        if new:
            hashed()
        if held:
            yield flush()

    return run


def near_in_keys(prints: np.ndarray, size: np.ndarray, radius: int, block: int) -> np.ndarray:
    """Which fingerprints, of groups of these sizes one after another, have another one of their group within the radius.
    All of groups over ``block``, which are compared when they have been cut."""
    end = np.cumsum(size)
    near = np.repeat(size > block, size)
    small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    if len(small):
        last = np.searchsorted(small, np.repeat(end, size)[small])
        near[small[linked_in_small(prints[small], last, radius)].ravel()] = True
    for g in np.flatnonzero((size > SMALL) & (size <= block)).tolist():
        own, found = prints[end[g] - size[g] : end[g]], near[end[g] - size[g] : end[g]]
        planes = planes_of(own)
        for i in range(len(own)):
            if not found[i] and len(j := within(planes, len(own), int(own[i]), radius)) > 1:
                found[j] = True
    return near


def colliding(ids, block, radius):
    """mapInArrow function over all cells of some keys: ASK rows by document of those whose key holds several units (and, with
    a radius, one within it), and LATER rows by key of the keys that are cut."""

    def run(batches):
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if not blobs:
            return
        key, name, fp, doc, place = unpack_all(blobs, *CELLS)
        blobs.clear()
        order = np.lexsort((place, doc, name, key))
        key, name, fp, doc, place = (a[order] for a in (key, name, fp, doc, place))
        first = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
        key, name, fp, doc, place = (a[first] for a in (key, name, fp, doc, place))
        sizes = lambda: np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
        if radius is not None:
            near = near_in_keys(fp, sizes(), radius, block)
            key, name, fp, doc, place = (a[near] for a in (key, name, fp, doc, place))
            if not len(key):
                return
        size = sizes()
        begin = np.cumsum(size) - size
        with np.errstate(over="ignore"):  # keys of several bands with the same units are one group, named by these
            key = np.repeat(mix(np.add.reduceat(mix(name), begin)), size)
        rank = np.arange(len(key)) - np.repeat(begin, size)
        size = np.repeat(size, size)
        several, many = (size > 1) & (size <= block), np.flatnonzero(size > block)
        arrays, rows = [a[several] for a in (key, name, fp, doc, place)], []
        if len(many):  # members of the first block go to the group of every other block, and others to that of their own
            rows = [(LATER, k, blob) for k, blob in deal(key[many], [a[many] for a in (key, name, fp, doc, place)], ids)]
            own, n = rank[many] // block, -(-size[many] // block)
            times = np.where(own == 0, n - 1, 1)
            at = np.repeat(many, times)
            other = np.where(np.repeat(own, times) == 0, np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1, np.repeat(own, times))
            with np.errstate(over="ignore"):
                sub = mix(mix(key[at]) + other.astype(np.uint64))
            arrays = [np.r_[a, b] for a, b in zip(arrays, (sub, name[at], fp[at], doc[at], place[at]), strict=True)]
        rows += [(ASK, k, blob) for k, blob in deal(doc_key(arrays[3], arrays[4] >> PART), arrays, ids)]
        for at in range(0, len(rows), 2000):
            yield keyed_rows(ASKED, rows[at : at + 2000])

    return run


MEMBERS = "key long, name long, fp long, doc long, place long"


def members(batches):
    """mapInArrow function: LATER rows as MEMBERS."""
    for b in batches:
        for blob in b.column(0).to_pylist():
            arrays = unpack(blob, *CELLS)
            for at in range(0, len(arrays[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 20_000].view(np.int64)) for a in arrays], [c.split()[0] for c in MEMBERS.split(", ")])


def asked_again(ids):
    """mapInArrow function: MEMBERS as packed rows by document."""

    def run(batches):
        held, count = [], 0

        def flush():
            arrays = [np.concatenate(x).view(k) for x, k in zip(zip(*held, strict=True), CELLS, strict=True)]
            held.clear()
            return keyed_rows(ROWS, deal(doc_key(arrays[3], arrays[4] >> PART), arrays, ids))

        for b in batches:
            if b.num_rows:
                held.append([np.asarray(c) for c in b.columns])
                count += b.num_rows
            if count > FLUSH:
                yield flush()
                count = 0
        if held:
            yield flush()

    return run


def second_round(later: DataFrame, joined: DataFrame, block: int) -> DataFrame:
    """MEMBERS of the groups in which what has not met in a cut key meets: units outside the key's largest component with all of
    its units, in blocks."""
    cells = later.select("blob").mapInArrow(members, MEMBERS)
    own = hold(cells.join(joined, cells.name == F.col("vertex"), "left").select(*cells.columns, F.coalesce("component", "name").alias("component")))
    sizes = own.groupBy("key", "component").count()
    keys = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.sum("count").alias("n"), F.max("count").alias("most")).filter("n > most")
    blocks = keys.select("key", "largest", F.ceil(F.col("n") / block).alias("n_all"), F.ceil((F.col("n") - F.col("most")) / block).alias("n_rest"))
    rows = own.join(blocks, "key")
    place = lambda n, salt: F.pmod(F.xxhash64("name", F.lit(salt)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    all_ = rows.select("*", every("n_rest").alias("rest"), place(F.col("n_all"), 1).alias("all"))
    rest = rows.filter("component <> largest").select("*", place(F.col("n_rest"), 2).alias("rest"), every("n_all").alias("all"))
    return all_.unionByName(rest).select(F.xxhash64("key", "rest", "all").alias("key"), "name", "fp", "doc", "place")


def sets(cut, ids):
    """Cogrouped function of a bucket's documents and asked paragraphs: exact shingle sets, by key."""

    def run(key_, docs, asked):
        blobs = asked.column("blob").to_pylist()
        if not blobs:
            return pa.Table.from_batches([keyed_rows(ROWS, [])])
        key, name, fp, doc, place = unpack_all(blobs, *CELLS)
        blobs.clear()
        order = np.lexsort((name, key))
        key, name, fp, doc, place = (a[order] for a in (key, name, fp, doc, place))
        first = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
        key, name, fp, doc, place = (a[first] for a in (key, name, fp, doc, place))
        wanted: dict[tuple, set] = {}
        for d, x in set(zip(doc.tolist(), place.tolist(), strict=True)):
            wanted.setdefault((d, x >> PART), set()).add(x)
        own: dict[tuple, np.ndarray] = {}
        for d, p, t in unpack_docs(docs.column("blob").to_pylist()):
            if mine := wanted.pop((d, p), None):
                own.update(((d, (p << PART) + i), np.unique(shingle_hashes([words])[0])) for i, _, words in cut(t) if (p << PART) + i in mine)
        bucket = spread(key, ids)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for k, s in groups(bucket[order]):
            mine = order[s]
            parts = [own[x] for x in zip(doc[mine].tolist(), place[mine].tolist(), strict=True)]
            rows.append((int(k), pack_with(b"".join(p.tobytes() for p in parts), key[mine], name[mine], fp[mine], np.array([len(p) for p in parts], np.uint32))))
        return pa.Table.from_batches([keyed_rows(ROWS, rows)])

    return run


def links_of(flat: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of indexes that join all sets linked in a group; the sets lie one after another in ``flat``."""
    names, code = np.unique(flat, return_inverse=True)
    begin = np.cumsum(size) - size
    edges, mark = [], np.zeros(len(names), np.int64)
    root = np.arange(len(size))
    for i in range(len(size) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1  # what is joined already needs no link
        if not len(rest):
            continue
        mine = code[begin[i] : begin[i] + size[i]]
        mark[mine] = 1
        n = size[rest]
        if 2 * len(rest) > len(size) - i:
            both = np.add.reduceat(mark[code[begin[i + 1] :]], begin[i + 1 :] - begin[i + 1])[rest - i - 1]
        else:
            start = np.cumsum(n) - n
            both = np.add.reduceat(mark[code[np.arange(n.sum()) + np.repeat(begin[rest] - start, n)]], start)
        mark[mine] = 0
        j = rest[both >= threshold * (size[i] + n - both) - 1e-9]
        if len(j):
            edges.append(np.stack([np.full(len(j), i), j], 1))
            root[np.isin(root, root[j])] = root[i]
        if len(edges) > 64:
            edges = [forest(np.concatenate(edges))]
    return forest(np.concatenate(edges)) if edges else np.zeros((0, 2), np.int64)


def shared_of(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements the sets i and j of each pair have in common; the sets lie in ``flat``."""
    out = []
    step = max(1, (1 << 21) // max(1, int(size.max()) * 2)) if len(i) else 1
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        set_, pair = np.stack([a, b], 1).ravel(), np.repeat(np.arange(len(a)), 2)
        n = size[set_]
        element = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[set_], n)
        pair = np.repeat(pair, n)
        with np.errstate(over="ignore"):
            key = flat[element] + mix(pair.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        twice = key[order][1:] == key[order][:-1]
        out.append(np.bincount(pair[order[1:][twice]], minlength=len(a)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def near_links(prints: np.ndarray, end: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, radius: int, threshold: float) -> np.ndarray:
    """Pairs of indexes that join all linked sets of each group: within the radius, and with the exact similarity. ``end``
    is the end of each set's group. Members k places apart are compared together; a pair that is joined needs no look.
    In large groups, planes of all fingerprints are compared with one at a time."""
    n = np.arange(len(prints))
    begins = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else n
    members = end[begins] - begins
    edges, root = [], n.copy()
    similar = lambda i, j: (lambda both: both >= threshold * (size[i] + size[j] - both) - 1e-9)(shared_of(flat, begin, size, i, j))
    here, k = np.flatnonzero(np.repeat(members <= SMALL, members)), 1
    while len(here := here[here + k < end[here]]):
        i = here[root[here] != root[here + k]]
        if len(i):
            i = i[within(planes_of(prints[i] ^ prints[i + k]), len(i), 0, radius)]
            i = i[similar(i, i + k)]
        if len(i):
            edges = [forest(np.concatenate([*edges, np.stack([i, i + k], 1)]))]
            root = n.copy()
            root[edges[0][:, 0]] = edges[0][:, 1]
        k += 1
    for a, m in zip(begins[members > SMALL].tolist(), members[members > SMALL].tolist(), strict=True):
        planes, one = planes_of(prints[a : a + m]), root[a : a + m]
        for i in range(m - 1):
            if (one[i + 1 :] == one[i]).all():
                continue
            j = within(planes, m, int(prints[a + i]), radius)
            j = j[(j > i) & (one[j] != one[i])]
            j = j[similar(np.full(len(j), a + i), a + j)]
            if len(j):
                edges.append(np.stack([np.full(len(j), a + i), a + j], 1))
                one[np.isin(one, one[j])] = one[i]
    return forest(np.concatenate(edges)) if edges else np.zeros((0, 2), np.int64)


def verified(threshold, radius):
    """mapInArrow function over all sets of some keys: links (a, b) between units' hashes."""

    def run(batches):
        parts = [unpack_with(x, *SETS) for b in batches for x in b.column(1).to_pylist()]
        if not parts:
            return
        key, name, fp, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        data = np.concatenate([np.frombuffer(p[4].tobytes(), np.uint64) for p in parts])
        parts.clear()
        n = n.astype(np.int64)
        begin = np.cumsum(n) - n
        order = np.lexsort((name, key))
        out = []
        if radius is not None:
            key, name = key[order], name[order]
            end = np.searchsorted(key, key, side="right")
            out.append(name[near_links(fp[order], end, data, begin[order], n[order], radius, threshold)])
        else:
            for _, s in groups(key[order]):
                own = order[s]
                if len(own) > 1:
                    flat = np.concatenate([data[begin[i] : begin[i] + n[i]] for i in own])
                    out.append(name[own][links_of(flat, n[own], threshold)])
        pairs = forest(np.concatenate(out).view(np.int64)) if out else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


OCCURRENCES = "p1 long, p2 long, doc_id long, place long, line long, n_words long"


def occurrences(cut):
    """mapInArrow function: OCCURRENCES of the units that ``cut`` gives."""

    def run(batches):
        rows = []

        def batch():
            names = (np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in (0, 1))
            out = pa.RecordBatch.from_arrays([*map(pa.array, names), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(2, 6))], [c.split()[0] for c in OCCURRENCES.split(", ")])
            rows.clear()
            return out

        for d, part, t in texts_of(batches):
            for i, line, words in cut(t):
                rows.append((*name_of(words), d, (part << PART) + i, line, len(words)))
            if len(rows) > 20_000:
                yield batch()
        if rows:
            yield batch()

    return run


def clean(c):
    """A doc_id without the stand-in for null."""
    return F.nullif(F.col(c), F.lit(NO_ID))


def repeats(docs: DataFrame, cut, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK, radius: int | None = None) -> DataFrame:
    """(doc_id, part, number, paragraph, n_words, first_doc_id, first_part, first_number, n_members, kept) of each unit whose
    class has more than one occurrence. Documents: (doc_id, text). cut: a function that gives a text's units, (number, line,
    words) each; paragraph is the line."""
    spark = docs.sparkSession
    p = partitions(spark)
    bands, per_band = tune_bands(threshold, recall, hashes)
    rows = numbered(docs)
    ids = buckets_for(rows)
    asked = hold(sorted_by_bucket(rows.mapInArrow(trimmed(cells(cut, bands, per_band, ids, radius)), ROWS_SQL)).mapInArrow(trimmed(each_bucket(colliding(ids, block, radius))), ASKED_SQL))
    packed = rows.mapInArrow(trimmed(pack_docs(ids)), DOC_BLOBS).repartition(p, "bucket").groupBy("bucket")

    def links(asked):
        found = packed.cogroup(asked.repartition(p, "bucket").groupBy("bucket")).applyInArrow(sets(cut, ids), ROWS_SQL)
        return sorted_by_bucket(found).mapInArrow(trimmed(each_bucket(verified(threshold, radius))), "a long, b long")

    joined = components(links(asked.filter(F.col("kind") == ASK).select("bucket", "blob")))
    later = asked.filter(F.col("kind") == LATER)
    if later.limit(1).count():
        more = links(second_round(later, joined, block).mapInArrow(trimmed(asked_again(ids)), ROWS_SQL))
        joined = components(more.unionByName(joined.select(F.col("vertex").alias("a"), F.col("component").alias("b"))))
    root = joined.unionByName(joined.select(F.col("component").alias("vertex"), "component").distinct())
    all_ = hold(rows.mapInArrow(trimmed(occurrences(cut)), OCCURRENCES))
    all_.count()  # else several stages that run together would each make what they don't find yet
    names = all_.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))
    classes = hold(names.join(root, names.p1 == F.col("vertex"), "left").filter("n > 1 or component is not null").select("p1", "p2", "n", "first", F.coalesce("component", "p1").alias("c1"), F.when(F.col("component").isNull(), F.col("p2")).otherwise(0).alias("c2")))
    whole = classes.groupBy("c1", "c2").agg(F.sum("n").alias("n_members"), F.min("first").alias("first"))
    # The keys are written anew, so that both sides are exchanged and a hot class can be split.
    whole = whole.select(*[F.col(c).bitwiseXOR(F.lit(0).cast("long")).alias(c) for c in ("c1", "c2")], "n_members", "first")
    each = classes.drop("n", "first").join(whole, ["c1", "c2"]).select("p1", "p2", "n_members", "first")
    number = lambda c: F.col(c).bitwiseAND((1 << PART) - 1)
    return all_.join(each, ["p1", "p2"]).select(
        clean("doc_id").alias("doc_id"), F.shiftright("place", PART).alias("part"), number("place").alias("number"), F.col("line").alias("paragraph"), "n_words",
        clean("first.doc_id").alias("first_doc_id"), F.shiftright("first.place", PART).alias("first_part"), number("first.place").alias("first_number"),
        F.col("n_members"), (F.struct("doc_id", "place") == F.struct("first.doc_id", "first.place")).alias("kept"),
    )
