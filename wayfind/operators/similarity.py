"""Cosine links between vectors: of a stated query set with all rows, and how many each row has with all others."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 16 << 20
CELLS = 1 << 20  # pairs that a task compares at a time: a few arrays of 8 MB
SIDE = 512  # vectors of either block that are compared at a time where only counts are kept: arrays of 2 MB, for the cache
BLOCK, BLOCKS = 32_768, 16  # vectors in a block, about; blocks at least, so that small tables too are dealt among tasks


def tiles(n: int, m: int, most: int, widest: int | None = None):
    """Slices of ``n`` rows and ``m`` columns that have ``most`` cells and ``widest`` columns at most."""
    wide = max(1, min(m, most, widest or m))
    high = max(1, most // wide)
    return [(slice(i, i + high), slice(j, j + wide)) for i in range(0, n, high) for j in range(0, m, wide)]


def links(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(a, b, score) for queries (vec_id, embedding) and other vectors with a cosine of ``least`` or more, rounded to six
    digits. Queries go to the tasks in blocks of a checked size, and a task compares CELLS pairs at a time."""
    spark = vectors.sparkSession
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-n * max(width, 1) * 8 // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)
        rows = part.select("vec_id", "embedding").filter("embedding is not null").collect()
        found = vectors.filter("embedding is not null").select("vec_id", "embedding").mapInArrow(compared(spark.sparkContext.broadcast([(r.vec_id, np.array(r.embedding, np.float64)) for r in rows]), least), "a long, b long, score double")
        out = found if out is None else out.unionByName(found)
    return out


def compared(block, least):
    def run(batches):
        ids = np.array([i for i, _ in block.value], np.int64)
        q = np.stack([v for _, v in block.value]) if len(ids) else None
        for b in batches:
            own = np.array(b.column(0))
            if not len(ids) or not len(own):
                continue
            v = np.stack([np.asarray(x.values, np.float64) for x in b.column(1)])
            for rows, columns in tiles(len(ids), len(own), CELLS):
                norm = np.linalg.norm(q[rows], axis=1)[:, None] * np.linalg.norm(v[columns], axis=1)[None, :]
                with np.errstate(invalid="ignore", divide="ignore"):
                    cos = np.round(q[rows] @ v[columns].T / norm, 6)
                i, j = np.nonzero((cos >= least) & (ids[rows, None] != own[None, columns]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows][i]), pa.array(own[columns][j]), pa.array(cos[i, j])], ["a", "b", "score"])

    return run


def link_counts(vectors: DataFrame, least: float) -> DataFrame:
    """(vec_id, links): with how many others each of the vectors (vec_id, embedding) has a cosine of ``least`` or more, rounded to
    six digits; vectors without any are left out. Each is compared with each. Vectors are dealt among blocks, a block goes to each of its
    pairs with the blocks, and a task compares one pair of blocks at a time, so no task or driver holds more than two of them."""
    own = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    blocks = max(BLOCKS, -(-own.count() // BLOCK))
    kind = "<f4" if own.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    dealt = own.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding")
    sent = dealt.mapInArrow(packed(kind), "block int, ids binary, data binary").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = sent.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "ids", "data")
    found = pairs.repartition(8 * blocks, "a", "b").groupBy("a", "b").applyInArrow(counted(kind, least), "vec_id long, links long")
    return found.groupBy("vec_id").agg(F.sum("links").alias("links"))


def packed(kind: str):
    """Of each batch of (block, vec_id, embedding) a row (block, ids, data) for each block."""

    def run(batches):
        for b in batches:
            block, ids = np.asarray(b.column(0)), np.asarray(b.column(1), np.int64)
            m = np.stack([np.asarray(x.values, kind) for x in b.column(2)]) if len(ids) else None
            out = [(c, ids[block == c].tobytes(), m[block == c].tobytes()) for c in np.unique(block).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["block", "ids", "data"])

    return run


def counted(kind: str, least: float):
    def run(key, rows):
        a, b = (k.as_py() for k in key)
        block = np.asarray(rows["block"])

        def vectors(k):
            """Ids of a block, and its vectors with length one; those without a length become NaN, which links to nothing."""
            own = rows.filter(pa.array(block == k))
            ids = [np.frombuffer(x.as_py(), np.int64) for x in own["ids"]]
            if not ids:
                return np.zeros(0, np.int64), None
            m = np.concatenate([np.frombuffer(x.as_py(), kind).reshape(len(i), -1) for i, x in zip(ids, own["data"], strict=True)]).astype(np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.concatenate(ids), m / np.linalg.norm(m, axis=1, keepdims=True)

        ids, q = vectors(a)
        own, v = vectors(b) if a != b else (ids, q)
        left, right = np.zeros(len(ids), np.int64), np.zeros(len(own), np.int64)
        for r, c in tiles(len(ids), len(own), SIDE * SIDE, SIDE) if len(ids) and len(own) else []:
            with np.errstate(invalid="ignore"):
                cos = q[r] @ v[c].T
                i, j = np.nonzero(cos >= least - 1e-6)  # few; rounding decides among these
            is_link = (np.round(cos[i, j], 6) >= least) & (ids[r][i] != own[c][j])
            left[r] += np.bincount(i[is_link], minlength=len(ids[r]))
            right[c] += np.bincount(j[is_link], minlength=len(own[c]))
        ids, n = (np.concatenate([ids, own]), np.concatenate([left, right])) if a != b else (ids, left)
        return pa.table({"vec_id": pa.array(ids[n > 0]), "links": pa.array(n[n > 0])})

    return run
