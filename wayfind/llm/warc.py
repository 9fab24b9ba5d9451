"""Deterministic sharded WARC writer, and a reader.

Records are range-partitioned and sorted by page_id and digest. Each range is a shard; a shard's file is closed when its
compressed size reaches a limit. Headers and digests are made anew from the payload, with a fixed date and record ids that
follow from page_id and digest, and each record is a gzip member of its own, so equal input gives equal bytes. Ranges come
from exact quantiles of a histogram of page_id, not from a random sample; an id with more rows than a range should have (such
as null) is cut by digest.

Of equal payloads of ``least`` bytes or more, the record with the smallest page_id is the response and the others refer to it.
Digests are counted with partial aggregation, and only digests that occur twice are joined back, so a payload that a
third of all pages share is a skewed join of short rows, which adaptive execution splits.

Commit: a task writes each file under a temporary name of its own and renames it when it is complete; attempts of one
task give the same bytes, so whichever renames last does no harm. Each write has a folder of its own, and the rows about its
files become a numbered manifest by one rename. Readers open only what the latest manifest names, so until then they see the
write before; the one before that is deleted. Paths are in a folder that driver and executors share, opened by pyarrow's
file systems.

Null html is an empty payload. A null page_id comes first and is written as an empty field. Rows that share a page_id
are records in the order of their digests. Control characters and spaces of a url are percent-encoded. Other columns are
ignored. An empty table gives a manifest without files. A payload of any length is one record.
"""

import gzip
import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import NO_ID, bucket_ids, by_value, fs_delete, fs_of, hold, partitions, shared, table

by_value(__name__)

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, first_page long, last_page long, n_records long, n_bytes long, sha256 string"
FILES_REST = [c.split()[0] for c in FILES.split(", ")][1:]
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def encoded(url: str) -> str:
    """A url without what would end its header line."""
    return "" if url is None else re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page, url, digest, payload, size, refers_to):
    """A record's bytes, compressed."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}/{digest}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {encoded(url)}"] * bool(url) + [f"X-Page-ID: {'' if page == NO_ID else page}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}')}>", f"X-Refers-To-Page: {'' if refers_to == NO_ID else refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def writer(folder, roll, numbers):
    """mapInArrow function over (shard, page_id, digest, is_page, url, html, first) sorted in this order, where the row
    of a digest's verdict comes before its pages: writes a shard's files and gives their FILES rows."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, temp, shard, number, rows = None, "", "", None, 0, []
        verdict, first, last, count, size, sha = None, 0, 0, 0, 0, None

        def close():
            out.close()
            fs.move(temp, f"{root}/{name}")
            rows.append((name, first, last, count, size, sha.hexdigest()))

        for part in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            for s, page, digest, is_page, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if not is_page:
                    verdict = [page, digest, refers_to, False]
                    continue
                known = verdict and verdict[:2] == [page, digest]
                target = verdict[2] if known and (verdict[2] != page or verdict[3]) else None
                if known:
                    verdict[3] = True
                payload = (html or "").encode()
                if out is None or s != shard or size >= roll:
                    if out is not None:
                        close()
                    number = number + 1 if s == shard else 0
                    shard, name = s, f"shard-{numbers[s]:06d}-{number:05d}.warc.gz"
                    temp = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
                    out, first, count, size, sha = fs.open_output_stream(temp, compression=None), page, 0, 0, hashlib.sha256()
                data = record(page, url, digest, payload, len(payload), target)
                out.write(data)
                sha.update(data)
                last, count, size = page, count + 1, size + len(data)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], [c.split()[0] for c in FILES.split(", ")])

    return run


def parse(stream):
    """(headers, block) of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(": ")
            headers[key.rstrip(":")] = value
        yield headers, stream.read(int(headers["Content-Length"]))


def reader(folder):
    """mapInArrow function over (file, n_records, n_bytes, sha256): RECORDS, after every digest has been verified."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for b in batches:
            for name, count, size, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, seen, digest = [], 0, hashlib.sha256()
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    source = Counted(raw, digest)
                    for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=source))):
                        seen += 1
                        own = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        revisit = h["WARC-Type"] == "revisit"
                        if hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"].removeprefix("sha256:") or not revisit and (hashlib.sha256(payload).hexdigest() != own or len(payload) != length):
                            raise ValueError(f"{name}: a digest or length is wrong in {h['WARC-Record-ID']}")
                        number = lambda x: int(x) if x else None
                        rows.append((number(h["X-Page-ID"]), length, own, h["WARC-Type"], number(h["X-Refers-To-Page"]) if revisit else None, h.get("WARC-Target-URI"), name))
                        if len(rows) == 1000:
                            yield batch(rows)
                            rows = []
                if (seen, source.size, digest.hexdigest()) != (count, size, sha):
                    raise ValueError(f"{name} isn't what the manifest says")
                yield batch(rows)

    return run


class Counted(io.RawIOBase):
    """A stream that hashes and counts what is read."""

    def __init__(self, raw, digest):
        self.raw_, self.digest, self.size = raw, digest, 0

    def readable(self):
        return True

    def read(self, n=-1):
        data = self.raw_.read(n if n is not None and n >= 0 else None)
        self.digest.update(data)
        self.size += len(data)
        return data

    def readinto(self, buffer):
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def ranges(ids: DataFrame, n: int) -> list[tuple[int, str]]:
    """Bounds (page_id, digest) that cut rows (page_id, digest) into about n ranges with about as many rows each. They come
    from exact counts of equal intervals; an interval with more rows than a range should have is cut again, down to pairs
    of ids, and these, like the rows without an id, into equal parts of the digests."""
    nulls = ids.filter(F.col("page_id") == NO_ID).count()
    ids = ids.filter(F.col("page_id") != NO_ID).select(F.shiftright("page_id", 1).alias("page_id"))  # differences fit a long
    low, high, rows = ids.agg(F.min("page_id"), F.max("page_id"), F.count("page_id")).first()
    most, open_, done = -(-(rows + nulls) // n), [(low, high + 1)] if rows else [], []
    digests = lambda c: [f"{0xFFFFFFFF * i // parts:08x}" for i in range(1, parts)] if (parts := -(-c // max(1, most))) > 1 else []
    while open_:
        parts = max(2, max(4096, 8 * n) // len(open_))
        open_.sort()
        counts = ids.select(begin_of(open_, parts).alias("k")).filter(F.col("k") != NO_ID).groupBy("k").count().collect()
        more = []
        for k, c in counts:
            a, b = open_[bisect(open_, (k, high + 1)) - 1]
            width = -(-(b - a) // parts)
            if c > most and width > 1:
                more.append((k, min(k + width, b)))
            else:
                done.append((k, c))
        open_ = more
    bounds, held = [(NO_ID, d) for d in digests(nulls)], nulls
    for k, c in sorted(done):
        if held and held + c > most:
            bounds.append((2 * k, ""))
            held = 0
        held += c
        if c > most:
            bounds += [(2 * k, d) for d in digests(c)] + [(2 * k + 1, d) for d in ["", *digests(c)]]
    return bounds


def begin_of(intervals: list[tuple[int, int]], parts: int):
    """Column: the begin of the part in which page_id lies, of these intervals in order, each cut into equal parts; else NO_ID."""
    a, b = (np.array(x, np.int64) for x in zip(*intervals, strict=True))
    width = -(-(b - a) // parts)

    @F.pandas_udf("long")
    def of(page: pd.Series) -> pd.Series:
        page = page.to_numpy()
        i = np.maximum(np.searchsorted(a, page, side="right") - 1, 0)
        inside = (page >= a[i]) & (page < b[i])
        return pd.Series(np.where(inside, a[i] + (page - a[i]) // width[i] * width[i], NO_ID))

    return of("page_id")


def range_of(bounds: list[tuple[int, str]], names: list[int]):
    """Column function: names[i] of the i-th range, in which (page_id, digest) lies."""
    pages = np.array([p for p, _ in bounds], np.int64)
    cut = {p: np.array([d for q, d in bounds if q == p]) for p in {q for q, d in bounds if d}}
    name = np.array(names, np.int32)

    @F.pandas_udf("int")
    def of(page: pd.Series, digest: pd.Series) -> pd.Series:
        page = page.to_numpy()
        at = np.searchsorted(pages, page, side="right")
        for p, digests in cut.items():
            own = page == p
            at[own] = np.searchsorted(pages, p) + np.searchsorted(digests, digest.to_numpy(dtype=str)[own], side="right")
        return pd.Series(name[at])

    return of("page_id", "digest")


def manifests(spark, folder: str) -> list[str]:
    fs, root = fs_of(spark, folder)
    return sorted(n for s in fs.listStatus(root) if (n := s.getPath().getName()).startswith("manifest-") and not n.endswith(".tmp")) if fs.exists(root) else []


def write(pages: DataFrame, folder: str, least: int = 100, roll: int = 256 << 20, shards: int | None = None) -> str:
    """Write pages (page_id, url, html) as WARC files to ``folder``, a URI that executors share; gives the manifest's
    path. roll: compressed bytes at which a file is closed."""
    spark = pages.sparkSession
    n = shards or partitions(spark)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), url.alias("url"), F.col("html"))
    short = hold(rows.select("page_id", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("size")))
    long_ = short.filter(F.col("size") >= least)
    again = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    verdicts = long_.join(again, "digest").select("page_id", "digest", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
    both = verdicts.unionByName(rows.select("page_id", "digest", F.lit(True).alias("is_page"), "url", "html", F.lit(None).cast("long").alias("first")))
    bounds = ranges(short, n)
    ids = bucket_ids(n, len(bounds) + 1).reshape(n, -1).T.ravel().tolist()  # ranges go round the partitions
    fs, root = fs_of(spark, folder)
    fs.mkdirs(root)
    before = manifests(spark, folder)
    number = int(before[-1].split("-")[1]) + 1 if before else 0
    own = f"{number:08d}-{uuid.uuid4().hex}"
    fs.mkdirs(fs_of(spark, f"{folder}/files-{own}")[1])
    dealt = both.select(range_of(bounds, ids[: len(bounds) + 1]).alias("shard"), "*").repartition(n, "shard").sortWithinPartitions("shard", "page_id", "digest", "is_page")
    files = dealt.mapInArrow(writer(f"{folder}/files-{own}", roll, {k: i for i, k in enumerate(ids)}), FILES)
    temp, final = f"{folder}/manifest-{own}.tmp", f"{folder}/manifest-{own}"
    files.select(F.concat(F.lit(f"files-{own}/"), "file").alias("file"), *FILES_REST).repartition(max(1, n // 64)).sortWithinPartitions("file").write.json(temp)
    if not fs.rename(fs_of(spark, temp)[1], fs_of(spark, final)[1]):
        raise OSError(f"{final} can't be committed")
    for old in before[:-1]:
        fs_delete(spark, f"{folder}/{old}")
        fs_delete(spark, f"{folder}/{old.replace('manifest-', 'files-', 1)}")
    return final


def read(spark, folder: str) -> DataFrame:
    """RECORDS of the archives in ``folder`` that its latest manifest names; wrong digests, lengths or counts raise."""
    files = spark.read.schema(FILES).json(f"{folder}/{manifests(spark, folder)[-1]}").select("file", "n_records", "n_bytes", "sha256")
    return files.repartition(partitions(spark), "file").mapInArrow(reader(folder), RECORDS)


def op6_warc(spark, sf_dir):
    folder = shared(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Without repeated page_ids, which are told apart by their place among equal payloads.
OP6_SQL = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from p
), f as (
  select *, min(page_id) over (partition by payload_digest) as first, row_number() over (partition by payload_digest order by page_id) as n from d
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and n > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and n > 1 then first end as refers_to
from f
"""
