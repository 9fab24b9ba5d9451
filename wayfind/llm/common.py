"""What the operators share: reading tables, tables in the cluster's shared folder, texts and packed rows.

Functions of this subpackage that run on executors travel by value, so executors need not have the package installed.
"""

import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = b" \t\n\r\x0b\x0c"  # fixed values: the white space that ends a word
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only
NO_ID = -(1 << 63)  # stands for a null doc_id, which therefore comes first


def by_value(name: str) -> None:
    """Ship the functions of a module to executors with each job."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Rows of long texts go to Python in batches of ``most`` at most, which bounds what a task holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, most)


def trim() -> None:
    """Give a worker's freed memory back to the machine, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def trimmed(run):
    """A mapInArrow function that trims at its end."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a local session
    gets a temporary folder, and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='wayfind-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lost executor costs no more than the reread part."""
    path = shared(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wayfind_path = path
    return out


def hold(df: DataFrame) -> DataFrame:
    """``df``, whose partitions executors keep on disk for its several readers; what is lost with one is made again.
    Held until release(), or spark.catalog.clearCache()."""
    held.append(df.persist(StorageLevel.DISK_ONLY))
    return df


held: list[DataFrame] = []


def release() -> None:
    """Let go of all that hold() keeps, when what reads it has been written."""
    while held:
        held.pop().unpersist()


def drop(df: DataFrame | None) -> None:
    """Delete a table that save() made and nothing reads any more."""
    if df is not None and hasattr(df, "_wayfind_path"):
        fs_delete(df.sparkSession, df._wayfind_path)


def fs_of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fs_delete(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as a column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shorter(df: DataFrame) -> DataFrame:
    """The shorter side of a join with whole texts: a hash table in each partition, so the texts needn't be sorted. It grows
    with the corpus, so it isn't broadcast at any size."""
    return df.hint("shuffle_hash")


def several_texts(docs: DataFrame) -> DataFrame | None:
    """(doc_id, digest, part) of the texts of each doc_id that has several different ones: part counts them in the order of
    their digests. None if no doc_id has. Documents: (doc_id, text) without nulls. A doc_id with very many texts, such as
    that of all nulls, is counted in 4,096 parts."""
    short = docs.select("doc_id", F.md5("text").alias("digest")).distinct()
    if not short.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return None
    many = short.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    texts = short.join(many, "doc_id", "left_semi").withColumn("head", F.substring("digest", 1, 3))
    before = Window.partitionBy("doc_id").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = texts.groupBy("doc_id", "head").count().select("doc_id", "head", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = texts.withColumn("inside", F.row_number().over(Window.partitionBy("doc_id", "head").orderBy("digest")) - 1)
    return inside.join(heads, ["doc_id", "head"]).select("doc_id", "digest", (F.col("before") + F.col("inside")).cast("long").alias("part"))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id long, part long, text string) of documents: null texts are empty, null ids are NO_ID. part is 0, but counts
    the different texts of a doc_id that has several (in the order of their digests); rows that agree in both are one
    document. Only then are texts joined with anything."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = several_texts(rows)
    if parts is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("part"), "text")
    joined = rows.withColumn("digest", F.md5("text")).join(shorter(parts), ["doc_id", "digest"], "left")
    return joined.select("doc_id", F.coalesce("part", F.lit(0)).cast("long").alias("part"), "text")


def doc_key(doc: np.ndarray, part: np.ndarray) -> np.ndarray:
    """What documents are dealt by: ids with several texts, such as null, are spread."""
    with np.errstate(over="ignore"):
        return doc.astype(np.uint64) + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(arrays[0]).to_bytes(8, "little") + raw)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k in kinds:
        size = np.dtype(k).itemsize * n
        out.append(np.frombuffer(raw, k, n, at))
        at += size
    return out


def unpack_all(blobs, *kinds: str) -> list[np.ndarray]:
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def pack_with(data: bytes, *arrays: np.ndarray) -> bytes:
    """Arrays of one length, and bytes behind them."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(arrays[0]).to_bytes(8, "little") + raw + data)


def unpack_with(blob: bytes, *kinds: str) -> list:
    """What pack_with() packed: the arrays, then the bytes as uint8."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += np.dtype(k).itemsize * n
    return [*out, np.frombuffer(raw, np.uint8, -1, at)]


def groups(keys: np.ndarray):
    """(key, slice) of each run of equal keys in a sorted array."""
    if len(keys):
        edge = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield keys[a], slice(a, b)


def bucket_ids(n: int, of: int | None = None) -> np.ndarray:
    """``of`` different ints (n without it), of which repartition(n, column) puts equally many in each of n partitions,
    one partition after another: buckets and partitions agree."""
    each = -(-(of or n) // n)

    def placed(k: np.ndarray) -> np.ndarray:  # Spark's hash of an int: 32-bit Murmur3 with seed 42
        word = lambda x: x & np.uint64(0xFFFFFFFF)
        turn = lambda x, r: word(x << np.uint64(r)) | word(x) >> np.uint64(32 - r)
        times = lambda x, m: word(x * np.uint64(m))
        h = word(times(turn(np.uint64(42) ^ times(turn(times(k, 0xCC9E2D51), 15), 0x1B873593), 13), 5) + np.uint64(0xE6546B64)) ^ np.uint64(4)
        h = times(h ^ h >> np.uint64(16), 0x85EBCA6B)
        h = times(h ^ h >> np.uint64(13), 0xC2B2AE35)
        h ^= h >> np.uint64(16)
        return h.astype(np.uint32).view(np.int32).astype(np.int64) % n

    # Of each partition the first ints that are put there.
    tried = 16 * n + 8 * n * each
    while True:
        where = placed(np.arange(tried, dtype=np.uint64))
        order = np.argsort(where, kind="stable")
        begin = np.searchsorted(where[order], np.arange(n + 1))
        if (np.diff(begin) >= each).all():
            return order[begin[:-1, None] + np.arange(each)].ravel().astype(np.int32)
        tried *= 2


def spread(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bucket, one of ``ids``, of each 64-bit key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ids[((x ^ (x >> np.uint64(32))) % np.uint64(len(ids))).astype(np.int64)]


def texts_of(batches):
    """(doc_id, part, text bytes) of each row of the batches."""
    for b in batches:
        ids, parts, texts = (b.column(b.schema.get_field_index(k)) for k in ("doc_id", "part", "text"))
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        for i in range(b.num_rows):
            yield ids[i].as_py(), parts[i].as_py(), texts[i].as_py()


DOC_BLOBS = "bucket int, blob binary"


def pack_docs(ids: np.ndarray, most: int = 8 << 20):
    """mapInArrow function: documents as compressed blobs by bucket of doc_key()."""

    def run(batches):
        held, size = [], 0

        def flush():
            held.sort(key=lambda x: x[:2])
            buckets = spread(doc_key(np.array([d for d, _, _ in held], np.int64), np.array([p for _, p, _ in held], np.int64)), ids)
            order, rows = np.argsort(buckets, kind="stable"), []
            for k, s in groups(buckets[order]):
                own = [held[i] for i in order[s]]
                head = np.array([[d, p, len(t)] for d, p, t in own], np.int64)
                raw = len(own).to_bytes(8, "little") + head.tobytes() + b"".join(t for _, _, t in own)
                rows.append((int(k), zstandard.ZstdCompressor(level=3).compress(raw)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["bucket", "blob"])

        for row in texts_of(batches):
            held.append(row)
            size += len(row[2])
            if size >= most:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def unpack_docs(blobs):
    """(doc_id, part, text) of each document in the blobs."""
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        head, at = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n
        for d, p, size in head.tolist():
            yield d, p, raw[at : at + size]
            at += size


def keyed_rows(schema: pa.Schema, rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def planes(a: np.ndarray) -> bytes:
    """An array's first bytes, its second ones and so on, each compressed by itself: small numbers take little."""
    rows = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    parts = [zstandard.ZstdCompressor(level=3).compress(r.tobytes()) for r in rows]
    return framed(*parts)


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    rows = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in unframed(raw)]
    return np.ascontiguousarray(np.stack(rows, 1)).reshape(-1).view(kind)


def framed(*parts: bytes) -> bytes:
    """Byte strings on end, with their lengths."""
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def unframed(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at, out = 4 * (n + 1), []
    for size in np.frombuffer(raw, np.uint32, n, 4).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """0 to n - 1, which rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def edges(name: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n buckets begins in sorted hashes, and the end."""
    return np.searchsorted(bucket_of(name, n), np.arange(n + 1))


def by_bucket(answer, schema):
    """mapInArrow function over rows sorted by their first column: ``answer`` gets the rows of one bucket at a time."""

    def run(batches):
        now, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != now and held:
                    yield keyed_rows(schema, answer(held))
                    held = []
                now = row[0]
                held.append(row)
        if held:
            yield keyed_rows(schema, answer(held))

    return run


BUCKET_BYTES = 8 << 20  # of text for each bucket


def buckets_for(rows: DataFrame) -> np.ndarray:
    """Bucket numbers for documents (text): as many in each partition as the bytes of all texts ask for."""
    p = partitions(rows.sparkSession)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return bucket_ids(p, p * max(1, -(-int(size) // (p * BUCKET_BYTES))))


def sorted_by_bucket(df: DataFrame) -> DataFrame:
    """Rows (bucket, ...) by partition, one bucket after another."""
    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def each_bucket(run):
    """mapInArrow function over rows sorted by bucket: ``run`` gets the batches of one bucket at a time."""

    def whole(batches):
        now, held = None, []
        for b in batches:
            bucket = np.asarray(b.column(b.schema.get_field_index("bucket")))
            for k, s in groups(bucket):
                if k != now and held:
                    yield from run(iter(held))
                    held = []
                now = k
                held.append(b.slice(s.start, s.stop - s.start))
        if held:
            yield from run(iter(held))

    return whole
