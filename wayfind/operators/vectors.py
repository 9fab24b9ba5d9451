"""Nearest vectors by cosine: an index of coarse cells and product-quantized codes, exact re-ranking, and an exact mode.

The index is fitted on the SAMPLE vectors whose ids have the smallest hashes, whatever the number of rows; every row is indexed. A
vector of length one goes to its nearest cell, and what is left of it is cut into pieces, each of which is told by one byte. Codes of a
cell are packed, up to PACK vectors in a row, so a large cell is many rows. A query goes to its ``probes`` nearest cells, and
queries of a cell are packed too; packs meet by an equality join on the cell. Each meeting keeps a query's ``rerank`` best by the
codes' distances, the best of all of these are compared exactly, and the first ``k`` by similarity and id are the answer.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators.similarity import tiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE, PACK, QUERIES = 20_000, 4096, 256
CELLS = 1 << 20  # pairs of a query and a vector that a task compares at a time: a few arrays of 8 MB
BLOCK_BYTES = 16 << 20  # of queries that one exact pass compares with all vectors


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None, :]


def centres_of(rows: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds, from rows spread over the sample."""
    n = min(n, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.bincount(own, minlength=n)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


@dataclass
class Codebook:
    """cells: their centres; books: for each piece of a vector its 256 centres at most."""

    cells: np.ndarray
    books: list[np.ndarray]

    def pieces(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.array_split(rows, len(self.books), axis=1)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of vectors of length one."""
        cell = nearest(rows, self.cells).argmin(1)
        left = rows - self.cells[cell]
        return cell, np.stack([nearest(p, b).argmin(1).astype(np.uint8) for p, b in zip(self.pieces(left), self.books, strict=True)], 1)

    def similar(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the vectors that codes of a cell stand for."""
        out = np.repeat((queries @ self.cells[cell])[:, None], len(codes), 1)
        for k, (q, b) in enumerate(zip(self.pieces(queries), self.books, strict=True)):
            out += (q @ b.T)[:, codes[:, k]]
        return out


def fit(vectors: DataFrame, cells: int = 64, pieces: int = 16, sample: int = SAMPLE) -> Codebook:
    """The index's centres, from ``sample`` of the vectors (vec_id, embedding)."""
    rows = vectors.filter("embedding is not null").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        raise ValueError("there are no vectors")
    m = unit(np.array([r.embedding for r in rows], np.float64))
    centres = centres_of(m, cells)
    left = m - centres[nearest(m, centres).argmin(1)]
    return Codebook(centres, [centres_of(p, 256) for p in np.array_split(left, min(pieces, m.shape[1]), axis=1)])


def rows_of(batch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(0), np.int64), np.stack([np.asarray(x.values, np.float64) for x in batch.column(1)]) if batch.num_rows else np.zeros((0, 0))


def packs(cell: np.ndarray, ids: np.ndarray, data: np.ndarray, most: int, kind: str):
    """(cell, ids, data) rows of up to ``most`` members of a cell."""
    order = np.argsort(cell, kind="stable")
    out = []
    for c in np.unique(cell).tolist():
        own = order[np.searchsorted(cell[order], c) : np.searchsorted(cell[order], c, side="right")]
        out += [(c, ids[own[a : a + most]].tobytes(), np.ascontiguousarray(data[own[a : a + most]].astype(kind)).tobytes()) for a in range(0, len(own), most)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["cell", "ids", "data"])


PACKS = "cell int, ids binary, data binary"


def index(vectors: DataFrame, book: Codebook) -> DataFrame:
    """PACKS of the codes of all vectors (vec_id, embedding)."""

    def run(batches):
        for b in batches:
            ids, m = rows_of(b)
            if len(ids):
                cell, codes = book.encode(unit(m))
                yield packs(cell, ids, codes, PACK, "u1")

    return vectors.filter("embedding is not null").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, PACKS)


def search(codes: DataFrame, vectors: DataFrame, queries: DataFrame, book: Codebook, k: int = 10, probes: int = 16, rerank: int = 100) -> DataFrame:
    """(query, vec_id, score, rank): for each of the queries (vec_id, embedding) the first ``k`` other vectors that the index finds.
    codes: what index() gives, from storage. Scores are exact, rounded to six digits."""

    def probed(batches):
        for b in batches:
            ids, m = rows_of(b)
            if len(ids):
                m = unit(m)
                near = np.argsort(nearest(m, book.cells), 1, kind="stable")[:, :probes]
                yield packs(near.ravel(), np.repeat(ids, near.shape[1]), np.repeat(m, near.shape[1], 0), QUERIES, "<f4")

    def met(batches):
        """A pair of packs at a time, and of it as many queries as CELLS allow: a batch may hold many pairs."""
        for b in batches:
            for at in range(b.num_rows):
                cell, qids, qdata, ids, data = (c[at].as_py() for c in b.columns)
                q, v = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                asked, codes = np.frombuffer(qdata, "<f4").reshape(len(q), -1).astype(np.float64), np.frombuffer(data, np.uint8).reshape(len(v), -1)
                for rows, _ in tiles(len(q), len(v), max(CELLS, len(v))):
                    near = book.similar(asked[rows], cell, codes)
                    best = np.argsort(-near, 1, kind="stable")[:, : rerank + 1]
                    out = np.repeat(q[rows], best.shape[1]), v[best].ravel(), np.take_along_axis(near, best, 1).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query", "vec_id", "near"])

    asked = queries.filter("embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    both = asked.mapInArrow(probed, PACKS).select("cell", F.col("ids").alias("qids"), F.col("data").alias("qdata")).join(codes, "cell")
    found = both.select("cell", "qids", "qdata", "ids", "data").mapInArrow(met, "query long, vec_id long, near double").filter("query <> vec_id")
    few = found.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "vec_id"))).filter(F.col("_n") <= rerank).select("query", "vec_id")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("_v"))
    from_ = asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("_q"))
    return ranked(few.join(own, "vec_id").join(from_, "query").select("query", "vec_id", cosine("_q", "_v").alias("score")), k)


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b)))
    return F.round(F.try_divide(dot(F.col(a), F.col(b)), size), 6)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    own = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "vec_id"))
    return rows.filter("score is not null").withColumn("rank", own).filter(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """What search() gives, by comparing the queries with all vectors; queries go to the tasks in blocks of a checked size, and each
    task compares CELLS pairs at a time and keeps a query's best of these."""
    spark = vectors.sparkSession
    asked = queries.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-n * max(width, 1) * 8 // BLOCK_BYTES))
    all_ = vectors.filter("embedding is not null").select(F.col("vec_id").cast("long"), "embedding")

    def compared(block):
        def run(batches):
            ids, q = block.value
            for b in batches:
                own, m = rows_of(b)
                if not len(own) or not len(ids):
                    continue
                for rows, columns in tiles(len(ids), len(own), CELLS):
                    mine, here = ids[rows], own[columns]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        cos = np.round(q[rows] @ m[columns].T / (np.linalg.norm(q[rows], axis=1)[:, None] * np.linalg.norm(m[columns], axis=1)[None, :]), 6)
                    cos[(mine[:, None] == here[None, :]) | np.isnan(cos)] = -2
                    near = np.lexsort((np.broadcast_to(here, cos.shape), -cos))[:, :k]
                    score = np.take_along_axis(cos, near, 1)
                    keep = score.ravel() > -2
                    out = np.repeat(mine, near.shape[1]), here[near].ravel(), score.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out], ["query", "vec_id", "score"])

        return run

    out = None
    for j in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == j)
        rows = part.collect()
        block = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows], np.int64), np.array([r.embedding for r in rows], np.float64)))
        found = all_.mapInArrow(compared(block), "query long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(n_queries, n_true, recall): the share of the true neighbours that were found."""
    both = true.join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return both.agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_true"), F.try_divide(F.sum(F.coalesce("hit", F.lit(0))).cast("double"), F.count("*")).alias("recall"))
