"""Suffix-array dedup: remove every byte that lies in a string of ``size`` bytes which also starts earlier.

Earlier means a smaller doc_id, or the same document and a smaller offset. Longest-previous-factor arrays decide: in
suffix order, the previous and the next smaller position give the longest earlier match of each start.

One suffix array of the whole corpus would move every suffix. Instead:

1. Each task cuts its texts into content-defined cells (cells.py). Equal strings lie in cells with equal anchors, so
   cells are dealt by their anchors; those of one task with equal contents go as one. Of cells with equal contents all
   but the earliest are earlier matches in whole. An anchor with one content needs no more.
2. Where an anchor has several contents (edges of passages, edited copies), the earliest cell of each content is
   fetched as a window of its bytes, and the windows of an anchor are put in suffix order; starts whose longest
   previous factor reaches ``size`` go too.
3. An anchor with very many contents (a passage in a third of all texts, each in its own surroundings) would be one
   large group. Its starts are decided by their longest previous factors in each bucket of documents first; those that
   remain, one of each string and bucket, go to sub-groups by their strings' hashes, and are decided there in the same way.

Equality of whole cells is that of two 64-bit hashes, of the anchor and of the content; all other removals are by compared
bytes.

Each document takes its starts back, merges them to spans and drops the spans. Nothing is dropped, capped or sampled.

Null texts are empty. Texts shorter than ``size`` lose nothing. A null doc_id comes first and stays null. Different
texts with one doc_id are documents in text order; rows that agree in both are one document, so they don't match each
other and each gets the same result. Other columns are ignored. Empty tables give empty results.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import cells as C
from wayfind.llm.common import (
    DOC_BLOBS,
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
    shorter,
    sorted_by_bucket,
    spread,
    texts_of,
    trimmed,
    unpack_all,
    unpack_docs,
    unpack_with,
    unused,
)
from wayfind.llm.suffix import longest_previous_factors

by_value(__name__)

SPAN, WINDOW, START, CELL = 0, 1, 2, 3
PART = 31  # an offset in a text is below 2 ** 31, as texts are; the part of a document stands above it
FLUSH = 1 << 17  # cells that a task holds before it deals them out
ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
ROWS_SQL = "kind int, bucket int, blob binary"
CELLS = ("<u8", "<u8", "<i8", "<i8", "<u4")  # anchor, content, doc_id, offset, starts (0: the anchor is hot)
SPANS = ("<i8", "<i8", "<u4")  # doc_id, offset, starts
ASKED = ("<u8", "<i8", "<i8", "<u4")  # anchor, doc_id, offset, starts


def chunks(rows, size):
    """Texts joined up to CHUNK bytes: data, ends, and of each piece its doc_id and the offset of its first byte. A long
    text comes in pieces that overlap by size - 1 bytes, so each of its starts is whole in one piece."""
    buf, meta, held = [], [], 0
    for d, part, t in rows:
        if len(t) < size:
            continue
        at = 0
        while True:
            piece = t[at : at + C.CHUNK]
            buf.append(piece)
            meta.append((d, (part << PART) + at))
            held += len(piece)
            if held >= C.CHUNK:
                yield np.frombuffer(b"".join(buf), np.uint8), np.cumsum([len(b) for b in buf]), np.array(meta, np.int64)
                buf, meta, held = [], [], 0
            if at + C.CHUNK >= len(t):
                break
            at += C.CHUNK - size + 1
    if buf:
        yield np.frombuffer(b"".join(buf), np.uint8), np.cumsum([len(b) for b in buf]), np.array(meta, np.int64)


def merged(doc, lo, n):
    """Runs of starts sorted and joined where one ends at the next one's begin."""
    if not len(doc):
        return doc, lo, n
    order = np.lexsort((lo, doc))
    doc, lo, n = doc[order], lo[order], n[order].astype(np.int64)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + n[:-1])]
    last = np.r_[np.flatnonzero(new)[1:], len(doc)] - 1
    return doc[new], lo[new], (lo[last] + n[last] - lo[new]).astype(np.uint32)


def to_docs(kind, arrays, ids):
    """dealt() of arrays that end with doc_id, offset and a number, by document."""
    return dealt(kind, doc_key(arrays[-3], arrays[-2] >> PART), arrays, ids)


def dealt(kind, key, arrays, ids):
    """Rows (kind, bucket, blob) of the arrays, by bucket of key."""
    bucket = spread(key, ids)
    order = np.argsort(bucket, kind="stable")
    arrays = [a[order] for a in arrays]
    return [(kind, int(k), pack(*(a[s] for a in arrays))) for k, s in groups(bucket[order])]


def cut(size, ids, hot):
    """mapInArrow function: CELL rows by anchor; SPAN and START rows by document for what is settled in the task."""

    def run(batches):
        tables = C.powers(2 * C.CHUNK + size)
        held, count, known = [], 0, np.zeros(0, np.uint64)

        def flush():
            nonlocal known
            h, c, doc, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((lo, doc, c, h))
            h, c, doc, lo, n = h[order], c[order], doc[order], lo[order], n[order].astype(np.uint32)
            new_h = np.r_[True, h[1:] != h[:-1]]
            new = new_h | np.r_[True, c[1:] != c[:-1]]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = ~new & ((doc != doc[lead]) | (lo != lo[lead]))
            rows = to_docs(SPAN, merged(doc[later], lo[later], n[later]), ids)
            h, c, doc, lo, n, new_h = h[new], c[new], doc[new], lo[new], n[new], new_h[new]
            group = np.cumsum(new_h) - 1
            many = np.bincount(group, minlength=1)[group] > hot
            fresh = np.setdiff1d(h[many], known)
            known = np.union1d(known, fresh)
            many |= np.isin(h, known)
            rows += to_docs(START, (h[many], doc[many], lo[many], n[many]), ids)
            z = np.zeros(len(fresh), np.int64)
            h, c = np.r_[h[~many], fresh], np.r_[c[~many], z.astype(np.uint64)]
            rows += dealt(CELL, h, (h, c, np.r_[doc[~many], z], np.r_[lo[~many], z], np.r_[n[~many], z].astype(np.uint32)), ids)
            return keyed_rows(ROWS, rows)

        for data, ends, meta in chunks(texts_of(batches), size):
            e, n, h, c = C.cells(data, ends, size, tables)
            piece = np.searchsorted(ends, e, side="right")
            held.append((h, c, meta[piece, 0], meta[piece, 1] + e - np.r_[0, ends[:-1]][piece], n))
            count += len(e)
            if count >= FLUSH:
                yield flush()
                count = 0
        if held:
            yield flush()

    return run


def settle(ids, hot):
    """mapInArrow function over all cells of some anchors: SPAN rows of later equal cells, WINDOW or START rows (by
    document) of the earliest cells where an anchor has several contents."""

    def run(batches):
        blobs = []
        for b in batches:
            mine = np.array(b.column(0)) == CELL
            if not mine.all():
                yield b.filter(pa.array(~mine))
            blobs += b.filter(pa.array(mine)).column(2).to_pylist()
        if not blobs:
            return
        h, c, doc, lo, n = unpack_all(blobs, *CELLS)
        blobs.clear()
        flagged = np.unique(h[n == 0])
        real = n > 0
        h, c, doc, lo, n = h[real], c[real], doc[real], lo[real], n[real]
        if not len(h):
            return
        order = np.lexsort((lo, doc, c, h))
        h, c, doc, lo, n = h[order], c[order], doc[order], lo[order], n[order]
        new_h = np.r_[True, h[1:] != h[:-1]]
        new = new_h | np.r_[True, c[1:] != c[:-1]]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = ~new & ((doc != doc[lead]) | (lo != lo[lead]))
        rows = to_docs(SPAN, merged(doc[later], lo[later], n[later]), ids)
        h, doc, lo, n, new_h = h[new], doc[new], lo[new], n[new], new_h[new]
        group = np.cumsum(new_h) - 1
        contents = np.bincount(group)[group]
        single = np.isin(h, flagged) | (contents > hot)
        asked = ~single & (contents > 1)
        rows += to_docs(START, (h[single], doc[single], lo[single], n[single]), ids)
        rows += to_docs(WINDOW, (h[asked], doc[asked], lo[asked], n[asked]), ids)
        for at in range(0, len(rows), 2000):
            yield keyed_rows(ROWS, rows[at : at + 2000])

    return run


def decided(h, doc, lo, n, data, size):
    """Of windows (anchor, doc_id, offset, starts, bytes on end) some whole anchors at a time, about 262,000 starts: the bytes, and
    of each start its place in them, doc_id, offset and whether its longest previous factor reaches ``size``."""
    width = n.astype(np.int64) + size - 1
    begin = np.cumsum(width) - width
    order = np.lexsort((lo, doc, h))
    total = np.cumsum(n[order].astype(np.int64))
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 18))))
        while end < len(order) and h[order[end]] == h[order[end - 1]]:
            end += 1
        own = order[at:end]
        m = n[own].astype(np.int64)
        off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        one = np.concatenate([data[begin[i] : begin[i] + width[i]] for i in own])
        start = np.repeat(np.cumsum(width[own]) - width[own], m) + off
        d, o, g = np.repeat(doc[own], m), np.repeat(lo[own], m) + off, np.repeat(h[own], m)
        place = np.empty(len(d), np.int64)
        by = np.lexsort((o, d))
        place[by] = np.cumsum(np.r_[False, (d[by][1:] != d[by][:-1]) | (o[by][1:] != o[by][:-1])])
        yield one, start, d, o, longest_previous_factors(one, start, place, size, g) >= size
        at = end


def fetch(size, ids):
    """Cogrouped function of a bucket's documents and asked cells: WINDOW rows (with bytes) by anchor. Of hot anchors, the starts
    that are the first of their string in the bucket go as windows of their own, by the string's hash; the others as
    SPAN rows."""

    def run(key, docs, asked):
        kinds = asked.column("kind").to_pylist()
        blobs = asked.column("blob").to_pylist()
        rows, texts = [], {}
        if blobs:
            texts = {(d, part): t for d, part, t in unpack_docs(docs.column("blob").to_pylist())}
        for kind in (WINDOW, START):
            h, doc, lo, n = unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == kind], *ASKED)
            bytes_ = [texts[d, a >> PART][a & ((1 << PART) - 1) :][: m + size - 1] for d, a, m in zip(doc.tolist(), lo.tolist(), n.tolist(), strict=True)]
            if kind == WINDOW and len(h):
                bucket = spread(h, ids)
                order = np.argsort(bucket, kind="stable")
                for k, s in groups(bucket[order]):
                    own = order[s]
                    rows.append((WINDOW, int(k), pack_with(b"".join(bytes_[i] for i in own), h[own], doc[own], lo[own], n[own])))
            if kind == START and len(h):
                for one, start, d, o, gone in decided(h, doc, lo, n, np.frombuffer(b"".join(bytes_), np.uint8), size):
                    rows += to_docs(SPAN, merged(d[gone], o[gone], np.ones(gone.sum(), np.uint32)), ids)
                    start, d, o = start[~gone], d[~gone], o[~gone]
                    with np.errstate(over="ignore"):
                        string = C.mix(C.gram_hash(C.BYTE[one], size))[start]
                    bucket = spread(string, ids)
                    order = np.argsort(bucket, kind="stable")
                    for k, s in groups(bucket[order]):
                        own = order[s]
                        text = one[start[own][:, None] + np.arange(size)].tobytes()
                        rows.append((WINDOW, int(k), pack_with(text, string[own], d[own], o[own], np.ones(len(own), np.uint32))))
        return pa.Table.from_batches([keyed_rows(ROWS, rows)])

    return run


def resolve(size, ids):
    """mapInArrow function over all windows of some anchors and of some strings: SPAN rows."""

    def run(batches):
        windows = []
        for b in batches:
            for kind, bucket, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == SPAN:
                    yield keyed_rows(ROWS, [(kind, bucket, blob)])
                else:
                    windows.append(blob)
        if not windows:
            return
        parts = [unpack_with(b, *ASKED) for b in windows]
        h, doc, lo, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        data = np.concatenate([p[4] for p in parts])
        parts.clear()
        spans = [merged(d[gone], o[gone], np.ones(gone.sum(), np.uint32)) for _, _, d, o, gone in decided(h, doc, lo, n, data, size)]
        yield keyed_rows(ROWS, to_docs(SPAN, merged(*(np.concatenate(x) for x in zip(*spans, strict=True))), ids))

    return run


RESULT = "doc_id long, part long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_sha256 string, spans binary, kept binary"


def apply_spans(size, keep_bytes):
    """Cogrouped function of a bucket's documents and spans: a row for each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text_sha256", pa.string()), ("spans", pa.binary()), ("kept", pa.binary())])

    def run(key, docs, spans):
        doc, lo, n = merged(*unpack_all(spans.column("blob").to_pylist(), *SPANS))
        part, lo = lo >> PART, lo & ((1 << PART) - 1)
        of = {}
        for i, k in enumerate(zip(doc.tolist(), part.tolist(), strict=True)):
            of.setdefault(k, []).append(i)
        rows = []
        for d, p, t in unpack_docs(docs.column("blob").to_pylist()):
            runs, removed, kept, at = [], 0, [], 0
            for i in of.get((d, p), ()):
                a, b = int(lo[i]), int(lo[i]) + int(n[i]) + size - 1
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            for a, b in runs:
                kept.append(t[at:a])
                removed, at = removed + b - a, b
            kept = b"".join([*kept, t[at:]])
            rows.append((None if d == NO_ID else d, p, len(t), removed, len(runs), hashlib.sha256(kept).hexdigest(), hashlib.sha256(t).hexdigest() if keep_bytes else None, np.array(runs, "<i8").tobytes() if keep_bytes else None, kept if keep_bytes else None))
        return pa.Table.from_batches([keyed_rows(schema, rows)])

    return run


def dedup(docs: DataFrame, size: int = 100, hot: int = 4096, hot_in_task: int = 64, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, part, n_bytes, n_removed, n_spans, kept_sha256, text_sha256, spans, kept) of each document of ``docs`` (doc_id,
    text). text_sha256, spans (pairs of little-endian int64: first byte, byte after the last) and kept (the bytes that
    stay) are null unless keep_bytes. ``hot``, ``hot_in_task``: numbers of different contents from which an anchor's starts are
    dealt one by one; they change the work's distribution, not the result. size: at least 32."""
    if size < C.K:
        raise ValueError(f"size must be at least {C.K}")
    spark = docs.sparkSession
    p = partitions(spark)
    rows = numbered(docs)
    ids = buckets_for(rows)
    found = hold(sorted_by_bucket(rows.mapInArrow(trimmed(cut(size, ids, hot_in_task)), ROWS_SQL)).mapInArrow(trimmed(each_bucket(settle(ids, hot))), ROWS_SQL))
    packed = rows.mapInArrow(trimmed(pack_docs(ids)), DOC_BLOBS).repartition(p, "bucket").groupBy("bucket")
    asked = found.filter(F.col("kind") != SPAN).repartition(p, "bucket").groupBy("bucket")
    windows = packed.cogroup(asked).applyInArrow(fetch(size, ids), ROWS_SQL)
    more = sorted_by_bucket(windows).mapInArrow(trimmed(each_bucket(resolve(size, ids))), ROWS_SQL)
    spans = found.filter(F.col("kind") == SPAN).unionByName(more).repartition(p, "bucket").groupBy("bucket")
    return packed.cogroup(spans).applyInArrow(apply_spans(size, keep_bytes), RESULT)


def without_spans(text: str, spans: str, cut: str):
    """mapInArrow function: rows with their spans cut out of text; ``cut`` tells whether there were any."""

    def run(batches):
        for b in batches:
            texts, own = b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index(spans)).to_pylist()
            for i, s in enumerate(own):
                if s is not None:
                    raw, kept, at = texts[i].encode(), [], 0
                    for x, y in np.frombuffer(s, "<i8").reshape(-1, 2).tolist():
                        kept.append(raw[at:x])
                        at = y
                    texts[i] = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            flag = pa.array([s is not None for s in own], pa.bool_())
            yield b.drop_columns([spans, text]).append_column(text, pa.array(texts, pa.string())).append_column(cut, flag)

    return run


def deduped_documents(docs: DataFrame, size: int = 100) -> DataFrame:
    """``docs`` without the removed bytes, with the same columns: text loses them (and what is left of characters that a
    cut splits), n_chars is counted again where there is such a column. Documents that lose all their text go; those
    that had none stay as they are. Columns may have any names."""
    from pyspark.sql import types as T

    id_, sha, runs, cut = (unused(docs, x) for x in ("id", "sha", "spans", "cut"))
    spans = dedup(docs, size, keep_bytes=True).filter("n_removed > 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.col("text_sha256").alias(sha), F.col("spans").alias(runs)).distinct()
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(sha, F.sha2("text", 256))
    joined = keyed.join(shorter(spans), [id_, sha], "left").select(*docs.columns, runs)
    flag = [T.StructField("text", T.StringType()), T.StructField(cut, T.BooleanType())]
    out = joined.mapInArrow(without_spans("text", runs, cut), T.StructType([*(f for f in docs.schema if f.name != "text"), *flag])).filter((~F.col(cut)) | (F.col("text") != ""))
    return out.select(*[F.length("text").cast(f.dataType).alias(f.name) if f.name == "n_chars" else F.col(f.name) for f in docs.schema])


def op10_suffix_dedup(spark, sf_dir):
    from wayfind.llm.common import table

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: For distinct doc_ids. Strings of 100 bytes are told by 64-bit hashes.
OP10_SQL = """
with d as (
  select doc_id, coalesce(doc_id, -9223372036854775808) as id, hex(encode(coalesce(text, ''))) as x from documents
), s as (
  select id, i, hash(substr(x, cast(2 * i + 1 as bigint), 200)) as h from (select id, x, unnest(range(0, cast(length(x) / 2 as bigint) - 99)) as i from d where length(x) >= 200)
), gone as (
  select id, i from (select id, i, row_number() over (partition by h order by id, i) as n from s) where n > 1
), runs as (
  select id, min(i) as a, max(i) + 100 as b from (
    select id, i, sum(fresh) over (partition by id order by i) as run from (
      select id, i, case when i <= lag(i) over (partition by id order by i) + 100 then 0 else 1 end as fresh from gone))
  group by id, run
), cut as (
  select d.id, a, b, substr(x, 2 * coalesce(lag(b) over (partition by d.id order by a), 0) + 1, 2 * (a - coalesce(lag(b) over (partition by d.id order by a), 0))) as before, x from d join runs on runs.id = d.id
), kept as (
  select id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(before, '' order by a) || substr(any_value(x), 2 * max(b) + 1) as x from cut group by id
)
select doc_id, cast(length(d.x) / 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(kept.x, d.x))) as kept_sha256
from d left join kept on kept.id = d.id
"""
