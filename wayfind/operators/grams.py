"""Substring search by an index of trigrams.

A value holds a needle of three characters or more only if it holds each of its trigrams. Postings say, for each trigram and
block of 65,536 places of the stored nodes, at which places of the block a node has it in one of its columns, as packed 16-bit numbers; a
frequent trigram is many rows of a bounded size. Needles meet the postings by an equality join on trigrams. Of a needle's
trigrams the RAREST ones are looked up; in each block that has all of them the rarest list is cut down by the others. What is left
is read and tested for the needle itself, so trigrams decide what is read and never what is found.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as X

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = tuple(dict.fromkeys(X.SEARCHED + X.CHAT_SEARCHED))
GRAM, RAREST = 3, 8
HELD = 1 << 22  # places that a task holds before it writes postings
POSTINGS = "gram long, layer string, node_bucket int, block long, piece string, n long, places binary"
SCHEMA = pa.schema([("gram", pa.int64()), ("layer", pa.string()), ("node_bucket", pa.int32()), ("block", pa.int64()), ("piece", pa.string()), ("n", pa.int64()), ("places", pa.binary())])


def grams(needle: Column) -> Column:
    """The different trigrams of a string as numbers: 21 bits of each character's code. None for shorter strings."""
    at = lambda i, k: F.shiftleft(F.ascii(F.substring(needle, i + k, F.lit(1))).cast("long"), 21 * k)
    codes = F.transform(F.sequence(F.lit(1), F.length(needle) - (GRAM - 1)), lambda i: at(i, 0) + at(i, 1) + at(i, 2))
    return F.when(F.length(needle) >= GRAM, F.array_distinct(codes)).otherwise(F.array().cast("array<long>"))


def codes_of(values) -> np.ndarray:
    """The different trigrams of some strings."""
    out = []
    for s in values:
        if s is not None and len(s) >= GRAM:
            c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            out.append(c[:-2] | c[1:-1] << 21 | c[2:] << 42)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def packed(batches):
    """mapInArrow function: (layer, bucket, _row, values in lower case) to POSTINGS."""
    import uuid

    held: dict[tuple[str, int, int], list] = {}
    size = 0

    def flush():
        piece = uuid.uuid4().hex
        for (layer, bucket, block), rows in held.items():
            code, place = np.concatenate([c for c, _ in rows]), np.repeat(np.array([p for _, p in rows], np.uint16), [len(c) for c, _ in rows])
            order = np.lexsort((place, code))
            code, place = code[order], place[order]
            edge = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)]
            for at in range(0, len(edge) - 1, 50_000):
                ends = edge[at : at + 50_001]
                n = len(ends) - 1
                lists = [place[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(code[ends[:-1]]), pa.array([layer] * n, pa.string()), pa.array([bucket] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([piece] * n, pa.string()), pa.array(np.diff(ends)), pa.array(lists, pa.binary())], schema=SCHEMA)
        held.clear()

    for b in batches:
        for layer, bucket, row, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            codes = codes_of(values)
            if len(codes):
                held.setdefault((layer, bucket, row >> 16), []).append((codes, row & 0xFFFF))
                size += len(codes)
                if size >= HELD:
                    yield from flush()
                    size = 0
    yield from flush()


def postings(rows: DataFrame) -> DataFrame:
    """POSTINGS of stored nodes with their places (layer, bucket, _row)."""
    lower = [F.lower(F.col(c).cast("string")).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    return rows.select("layer", "bucket", "_row", *lower).mapInArrow(packed, POSTINGS)


def met(batches):
    """mapInArrow function: (q, layer, node_bucket, block, wanted, lists of (gram, places)) to (q, layer, bucket, _row) of the
    places that have all the wanted trigrams."""
    for b in batches:
        out: list[list] = [[], [], [], []]
        for q, layer, bucket, block, wanted, lists in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own: dict[int, list] = {}
            for x in lists:
                own.setdefault(x["gram"], []).append(np.frombuffer(x["places"], np.uint16))
            if len(own) < wanted:
                continue
            left, *others = sorted((np.concatenate(v) for v in own.values()), key=len)
            for o in others:
                if not len(left):
                    break
                left = left[np.isin(left, o)]
            for i, v in enumerate((q, layer, bucket)):
                out[i] += [v] * len(left)
            out[3].append((block << 16) + left.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64))], ["q", "layer", "bucket", "_row"])


def candidates(needles: DataFrame, found: DataFrame) -> DataFrame:
    """(q, layer, bucket, _row) of the places that may hold a needle. needles: (q) different, of three characters or more;
    found: the postings of their trigrams."""
    wanted = needles.select("q", F.explode(grams(F.col("q"))).alias("gram"))
    sizes = found.groupBy("gram").agg(F.sum("n").alias("size"))  # narrow: no places are read for this
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.coalesce("size", F.lit(0)), "gram"))
    chosen = wanted.join(sizes, "gram", "left").withColumn("r", rank).filter(F.col("r") <= RAREST).withColumn("wanted", F.count("*").over(Window.partitionBy("q")))
    rows = chosen.select("q", "gram", "wanted").join(found, "gram")
    blocks = rows.groupBy("q", "layer", "node_bucket", "block").agg(F.max("wanted").alias("wanted"), F.collect_list(F.struct("gram", "places")).alias("lists"), F.count_distinct("gram").alias("grams")).filter("grams = wanted")
    return blocks.select("q", "layer", "node_bucket", "block", "wanted", "lists").mapInArrow(met, "q string, layer string, bucket int, _row long")
