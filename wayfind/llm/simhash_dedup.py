"""SimHash near-dedup with bit-sliced comparison.

Each text gets a 64-bit fingerprint from its word shingles. Fingerprints within ``radius`` bits are linked, and linked
documents form classes. Equal fingerprints go as one before any comparison, and are the vertices of the links; only a class
that is complete takes the smallest doc_id of its documents. Distances come from
bit planes and carry-save counters (bits.py).

near_duplicates() links by fingerprints alone, for a small radius. Candidates: the 64 bits are cut into ``radius + 4`` blocks;
two fingerprints within the radius agree in 4 blocks at least, so each fingerprint goes under one key for each choice of 4
blocks, and none is missed. A bucket of equal keys compares all its fingerprints and gives no pairs but the edges of a
spanning forest. A bucket of more than ``block`` different fingerprints is cut into blocks, and each pair of blocks is a
bucket of its own, in tasks of their own; identical texts never add to a bucket.

one_of_each() removes near copies by exact similarity. At a Jaccard similarity of 0.8 fingerprints of different texts differ
in about 10 bits with a deviation of 3, for which no choice of blocks is selective. There, MinHash bands give the
candidates, bit-sliced comparison leaves those within a wide radius, and the exact Jaccard similarity decides (banding.py).

Null texts are empty: no words, fingerprint zero, linked like any other. A null doc_id counts as the smallest and stays
null. Repeated ids keep a row each. Other columns are ignored; an empty table gives an empty result. Texts of any length
are hashed whole.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import banding
from wayfind.llm.bits import SMALL, fingerprints, linked, linked_in_small
from wayfind.llm.common import LOWER, NO_ID, by_value, hold, partitions, several_texts, shorter, table, trimmed, unused
from wayfind.llm.components import components

by_value(__name__)

SEED = 42
BLOCK = 1 << 14  # different fingerprints of a bucket that are compared in one task
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: bytes, n: int):
    """XXH64 of each run of n words, as a list; of all words if there are fewer."""
    words = text.translate(LOWER).split()
    if len(words) < n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest = xxhash.xxh64_intdigest
    if n == 3:
        return [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]  # noqa: B905
    return [digest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)]


def printed(hashes: list[list[int]]) -> np.ndarray:
    return fingerprints(np.array([x for h in hashes for x in h], np.uint64), np.array([len(h) for h in hashes], np.int64))


def print_texts(n):
    """mapInArrow function: (doc_id, fingerprint)."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.large_binary())
            held, rows, done = [], 0, []
            for t in texts:
                held.append(shingle_hashes(t.as_py(), n))
                rows += len(held[-1])
                if rows > 100_000:
                    done.append(printed(held))
                    held, rows = [], 0
            done.append(printed(held))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(done).view(np.int64))], schema=PRINTS)

    return run


def keyed(radius, shared=4):
    """For each choice of ``shared`` of radius + shared blocks a mask of its bits."""
    edges = np.linspace(0, 64, radius + shared + 1).astype(int)
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]  # noqa: B905
    return [sum(c) for c in combinations(masks, shared)]


def compare(radius):
    """mapInArrow function over (tab, key, sub, fp) sorted by the first three, which name a bucket: edges (a, b) between
    fingerprints."""

    def run(batches):
        rest = None
        for b in batches:
            now = np.stack([np.asarray(c, np.int64) for c in b.columns], 1)
            if rest is not None:
                now = np.concatenate([rest, now])
            if not len(now):
                continue
            last = len(now) - 1
            while last and (now[last - 1, :3] == now[-1, :3]).all():
                last -= 1
            rest = now[last:]
            yield from solve(now[:last])
        if rest is not None:
            yield from solve(rest)

    def solve(rows):
        if len(rows) < 2:
            return
        new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(rows)])
        prints = np.ascontiguousarray(rows[:, 3])
        values, out = prints.view(np.uint64), []
        small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
        if len(small):
            last = np.searchsorted(small, (begin + size)[np.cumsum(new) - 1][small])
            out.append(prints[small][linked_in_small(values[small], last, radius)])
        out += [prints[a : a + n][linked(values[a : a + n], radius)] for a, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True)]
        pairs = np.concatenate([x.reshape(-1, 2) for x in out]) if out else np.zeros((0, 2), np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def prints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of documents (doc_id, text); fp holds the bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(trimmed(print_texts(words)), "doc_id long, fp long")


def cut_up(cells: DataFrame, block: int) -> DataFrame:
    """Cells (tab, key, fp) with the bucket's part, sub: 0, or in a bucket of more than ``block`` a number of each pair of
    its blocks that the cell is in."""
    many = hold(cells.groupBy("tab", "key").count().filter(F.col("count") > block))
    if not many.limit(1).count():
        return cells.select("tab", "key", F.lit(0).cast("long").alias("sub"), "fp")
    n = F.ceil(F.col("count") / block)
    own = F.pmod(F.xxhash64("fp"), n)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda other: F.least(own, other) * n + F.greatest(own, other) + 1)
    both = cells.join(many, ["tab", "key"], "left")
    return both.select("tab", "key", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("sub"), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) of each document; component_id is the smallest doc_id that links can reach."""
    found = hold(prints(docs, words))
    distinct = hold(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("unnamed")))
    masks = keyed(radius)
    cells = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("tab"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks)])).alias("k"), "fp").select("k.tab", "k.key", "fp")
    bucket = ["tab", "key", "sub"]
    edges = cut_up(cells, block).repartition(partitions(docs.sparkSession), *bucket).sortWithinPartitions(*bucket).mapInArrow(compare(radius), "a long, b long")
    classes = distinct.join(components(edges), distinct.fp == F.col("vertex"), "left").select("fp", F.coalesce("component", "fp").alias("class"), "least", "unnamed")
    first = classes.groupBy("class").agg(F.when(~F.max("unnamed"), F.min("least")).alias("component_id"))
    # The key is written anew, so that both sides of the join below are exchanged and a hot fingerprint can be split.
    named = classes.select(F.col("fp").bitwiseXOR(F.lit(0).cast("long")).alias("fp"), "class").join(first, "class").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def copies(docs: DataFrame, threshold: float = 0.8, radius: int = 24, recall: float = 0.9999, hashes: int = 72, block: int = banding.BLOCK) -> DataFrame:
    """Classes of whole texts (doc_id, text) by five-word shingles, as banding.repeats() gives them. radius: bits within which
    pairs are verified; of pairs at 0.8 about one in a million differs in more."""
    return banding.repeats(docs, banding.whole, threshold, recall, hashes, block, radius)


def one_of_each(docs: DataFrame, threshold: float = 0.8, **more) -> DataFrame:
    """Documents with their columns: of each class of near copies the one with the smallest doc_id stays (of several texts with
    that doc_id the one that numbered() puts first). Texts without words are copies of each other. Rows without a doc_id
    all stay, as nothing tells them apart, and their copies with one go; of other rows that agree in doc_id and text one
    stays. More arguments are those of copies()."""
    digest, part = unused(docs, "digest"), unused(docs, "part")
    gone = copies(docs, threshold, **more).filter("not kept and doc_id is not null").select("doc_id", F.col("part").alias(part)).distinct()
    known, rest = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    if not known.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return known.join(shorter(gone.drop(part)), "doc_id", "left_anti").select(docs.columns).unionByName(rest)
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = several_texts(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text")))
    known = known.withColumn(digest, F.md5(text))
    if parts is None:
        known = known.withColumn(part, F.lit(0).cast("long"))
    else:
        known = known.join(shorter(parts.select("doc_id", F.col("digest").alias(digest), F.col("part").alias(part))), ["doc_id", digest], "left").withColumn(part, F.coalesce(part, F.lit(0)))
    stay = known.join(shorter(gone), ["doc_id", part], "left_anti").dropDuplicates(["doc_id", digest])
    return stay.select(docs.columns).unionByName(rest)


def op7_simhash_near_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
