"""Substring dedup by paragraph MinHash banding.

A paragraph is a line of ``least`` words or more, lower-cased (A-Z), its words split at white space. Paragraphs that share
a band meet, are compared by the exact Jaccard similarity of their five-word shingles, and form classes (banding.py).

Longer passages inside lines that differ, or that run over several short lines, are found by windows: WINDOW words at
places that the words themselves decide, over the whole text without regard to lines, so that any PASSAGE words that two
texts share hold an equal window. Windows are matched by equality alone: neighbours overlap, and bands would link them as
near copies of each other. A line of fewer than ``least`` words is no paragraph of its own, but its words are in the
windows. Windows are for passages that texts share: one that occurs in a single document only is no copy, while paragraphs
are compared within a document too. Windows go in blocks, as packed arrays: each block asks buckets once for each different window it holds, a bucket
adds up what all blocks hold and answers each of them, and a block gives a row for each of its windows that has copies. So
a window that a third of all texts share is a short entry of each block. A window's name has 96 bits.

Null texts have no paragraphs. A null doc_id comes first and stays null. Different texts with one doc_id are told apart by
``part``; rows that agree in both are one document. Other columns are ignored; empty tables give an empty result. Texts of
any length are treated whole.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import banding
from wayfind.llm.banding import BLOCK, HASHES, PART, RECALL, THRESHOLD, clean
from wayfind.llm.cells import gram_hash, mix, sliding_min
from wayfind.llm.common import (
    LOWER,
    bucket_ids,
    by_bucket,
    by_value,
    edges,
    framed,
    hold,
    keyed_rows,
    numbered,
    partitions,
    planes,
    table,
    texts_of,
    trimmed,
    unframed,
    unplanes,
)

by_value(__name__)

LEAST = 20
PASSAGE, WINDOW = 50, 25  # a passage of so many words is found by windows of so many
STEP = 1 << 20  # bytes of text whose windows are found at once
HELD = 1 << 19  # windows of a block
BUCKET = 1 << 20  # windows that a bucket should get
TEXTS, ANSWERS = 0, 1
ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
ROWS_SQL = "bucket int, block long, kind int, blob binary"


def paragraphs(least: int):
    """Of a text the (number, line, words) of each paragraph; a number is its first word's place in the text."""

    def cut(text: bytes):
        at = 0
        for i, line in enumerate(text.translate(LOWER).split(b"\n")):
            words = line.split()
            if len(words) >= least:
                yield at, i, words
            at += len(words)

    return cut


def anchors(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words at which windows begin, of texts that end at ``ends``: those with the least hash of five words in a run of
    PASSAGE - WINDOW + 1 places. Any PASSAGE words hold a whole window whose place depends on them alone."""
    run = PASSAGE - WINDOW + 1
    if len(h) < PASSAGE:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        five = mix(gram_hash(h, 5))[: len(h) - WINDOW + 1]
    least = sliding_min(five, run)  # of the run from each place
    begin = np.arange(len(least))
    whole = begin + PASSAGE <= ends[np.searchsorted(ends, begin, side="right")]
    # A place is an anchor where the least hash of a run that holds it is its own.
    most = ~sliding_min(np.r_[np.full(run - 1, ~np.uint64(0)), np.where(whole, ~least, ~np.uint64(0)), np.full(run - 1, ~np.uint64(0))], run)
    return np.flatnonzero(most == five)


def windows_of(rows):
    """Of (doc_id, part, text) rows the windows: name (64 and 32 bits), doc_id, place (part and first word), line."""
    hashes, meta, ends, at = [], [], [], 0
    for d, part, text in rows:
        here, known = 0, {}
        for i, line in enumerate(text.translate(LOWER).split(b"\n")):
            if words := line.split():
                known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
                hashes += map(known.__getitem__, words)
                meta.append((at + here, i, d, (part << PART) + here))
                here += len(words)
        if here:
            at += here
            ends.append(at)
    h = np.array(hashes, np.uint64)
    place = anchors(h, np.array(ends, np.int64))
    meta = np.array(meta, np.int64).reshape(-1, 4)
    begin, line, doc, first = meta[np.searchsorted(meta[:, 0], place, side="right") - 1].T
    with np.errstate(over="ignore"):
        name, more = (mix(gram_hash(x, WINDOW)[place]) if len(place) else place.astype(np.uint64) for x in (h, mix(h)))
    return name, (more >> np.uint64(32)).astype(np.uint32), doc, first + place - begin, line.astype(np.uint32)


KINDS = ("<u8", "<u4", "<i8", "<i8", "<u4")


def blocks(batches):
    """mapInArrow function over texts: a row (block, n, blob) for each block of windows."""
    block, parts, held = TaskContext.get().partitionId() << 32, [], 0

    def flush():
        nonlocal block
        arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        block += 1
        order = np.lexsort((arrays[3], arrays[2], arrays[1], arrays[0]))  # by name, the first of equals first
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(order)]), pa.array([framed(planes(np.diff(arrays[0][order], prepend=np.uint64(0))), *(planes(a[order]) for a in arrays[1:]))], pa.binary())], ["block", "n", "blob"])

    rows, size = [], 0
    for row in texts_of(batches):
        rows.append(row)
        size += len(row[2])
        if size > STEP:
            parts.append(windows_of(rows))
            held += len(parts[-1][0])
            rows, size = [], 0
        if held > HELD:
            yield flush()
            held = 0
    if rows:
        parts.append(windows_of(rows))
    if any(len(p[0]) for p in parts):
        yield flush()


def unblock(blob: bytes):
    """A block's windows in the order of their names, and where each different name begins."""
    name, *rest = (unplanes(x, k) for x, k in zip(unframed(blob), KINDS, strict=True))
    name = np.cumsum(name, dtype=np.uint64)
    new = np.r_[True, (name[1:] != name[:-1]) | (rest[0][1:] != rest[0][:-1])]
    return name, *rest, np.flatnonzero(new)


def ask(ids):
    """mapInArrow function over blocks: of each different window its name, its number, its first place and how far the last
    document with it is from the first, by bucket."""

    def run(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name, more, doc, place, _, first = unblock(blob.as_py())
                last = np.r_[first[1:], len(name)] - 1
                with np.errstate(over="ignore"):
                    apart = doc[last] - doc[first], (place[last] >> PART) - (place[first] >> PART)
                count = (last - first + 1).astype(np.uint32)
                name, more, doc, place = name[first], more[first], doc[first], place[first]
                e, rows = edges(name, len(ids)), []
                for k in np.flatnonzero(np.diff(e)).tolist():
                    s = slice(e[k], e[k + 1])
                    rows.append((int(ids[k]), block, ANSWERS, framed(np.int64(k).tobytes(), planes(np.diff(name[s], prepend=np.uint64(0))), *(planes(a[s]) for a in (more, count, doc, place, *apart)))))
                yield keyed_rows(ROWS, rows)

    return run


def add_up(rows):
    """Of one bucket's questions the answers: of each asked window the number in all blocks, and the first place; 1 and none if
    one document has them all."""
    heads, parts = [], []
    for _, _, _, blob in rows:
        head, name, *rest = unframed(blob)
        heads.append(head)
        parts.append([np.cumsum(unplanes(name, "<u8"), dtype=np.uint64), *(unplanes(x, k) for x, k in zip(rest, ("<u4", "<u4", "<i8", "<i8", "<i8", "<i8"), strict=True))])
    name, more, count, doc, place, far, parts_far = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, doc, more, name))
    new = np.r_[True, (name[order][1:] != name[order][:-1]) | (more[order][1:] != more[order][:-1])]
    first = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    total = np.add.reduceat(count[order].astype(np.int64), first)
    with np.errstate(over="ignore"):
        last = np.maximum.reduceat((doc + far)[order], first), np.maximum.reduceat(((place >> PART) + parts_far)[order], first)
    doc, place = doc[order][first], place[order][first]
    total[(last[0] == doc) & (last[1] == place >> PART)] = 1
    out, at = [], 0
    for (bucket, block, kind, _), head, p in zip(rows, heads, parts, strict=True):
        own = of[at : at + len(p[0])]
        at += len(own)
        many = own[total[own] > 1]
        out.append((bucket, block, kind, framed(head, planes(total[own]), planes(doc[many]), planes(place[many]))))
    return out


FOUND = "doc_id long, place long, line long, first_doc_id long, first_place long, n_members long"


def answered(rows):
    """Of a block and the answers to it FOUND of each window with copies."""
    name, _, doc, place, line, first = next(unblock(blob) for _, kind, blob in rows if kind == TEXTS)
    answers = sorted((int(np.frombuffer(x[0], np.int64)[0]), x[1:]) for x in (unframed(blob) for _, kind, blob in rows if kind == ANSWERS))
    total, at, to = (np.concatenate([unplanes(x[k], "<i8") for _, x in answers]) for k in range(3))
    many = total > 1
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(name)]))
    own = many[of]
    answer = (np.cumsum(many) - 1)[of[own]]
    columns = doc[own], place[own], line[own].astype(np.int64), at[answer], to[answer], total[of[own]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])


def found(batches):
    """mapInArrow function over blocks and answers, (block, kind, blob) sorted by block: FOUND."""
    held: list = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield answered(held)
                held = []
            held.append(row)
    if held:
        yield answered(held)


def windows(docs: DataFrame) -> DataFrame:
    """The columns of banding.repeats() of each window of WINDOW words that several documents (doc_id, text) have. paragraph is
    the line in which it begins."""
    p = partitions(docs.sparkSession)
    held = hold(numbered(docs).mapInArrow(trimmed(blocks), "block long, n long, blob binary"))
    n = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ids = bucket_ids(p, p * max(1, -(-int(n) // (p * BUCKET))))
    dealt = lambda df, key: df.repartition(p, key).sortWithinPartitions(key)
    asked = dealt(held.select("block", "blob").mapInArrow(trimmed(ask(ids)), ROWS_SQL), "bucket")
    answers = asked.mapInArrow(trimmed(by_bucket(add_up, ROWS)), ROWS_SQL).select("block", "kind", "blob")
    rows = dealt(held.select("block", F.lit(TEXTS).alias("kind"), "blob").unionByName(answers), "block").mapInArrow(trimmed(found), FOUND)
    part, number = (lambda c: F.shiftright(c, PART)), (lambda c: F.col(c).bitwiseAND((1 << PART) - 1))
    return rows.select(
        clean("doc_id").alias("doc_id"), part("place").alias("part"), number("place").alias("number"), F.col("line").alias("paragraph"), F.lit(WINDOW).cast("long").alias("n_words"),
        clean("first_doc_id").alias("first_doc_id"), part("first_place").alias("first_part"), number("first_place").alias("first_number"),
        "n_members", (F.struct("doc_id", "place") == F.struct("first_doc_id", "first_place")).alias("kept"),
    )


def repeats(docs: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """What banding.repeats() gives of the paragraphs of documents (doc_id, text)."""
    return banding.repeats(docs, paragraphs(least), threshold, recall, hashes, block)


def op9_paragraph_dedup(spark, sf_dir):
    """Paragraphs and windows with copies: number is the place of the first word in the text."""
    docs = table(spark, sf_dir, "documents")
    kind = lambda df, name: df.select("doc_id", F.lit(name).alias("kind"), "paragraph", F.col("number").alias("first_word"), "n_words", "first_doc_id", F.col("first_number").alias("first_first_word"), "n_members", "kept")
    return kind(repeats(docs), "paragraph").unionByName(kind(windows(docs), "window"))
