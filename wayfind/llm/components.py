"""Connected components of an edge table, by alternating large and small stars.

Every round is a group-by with partial minima and a join on its key, which adaptive execution splits where a vertex has
very many edges. Rounds grow with the logarithm of the vertices. Each round's edges are written to the shared folder,
so lineage stays short and a lost executor costs one round at most. Nothing is collected but a count.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import by_value, drop, save

by_value(__name__)

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(pairs: np.ndarray) -> np.ndarray:
    """(vertex, smallest vertex of its component) for an array of pairs, smallest vertices left out."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    names, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    child = root != np.arange(len(names))
    return np.stack([names[child], names[root[child]]], 1)


def thinned(batches):
    """mapInArrow function: the edges of a partition as stars around the smallest vertices, bounded batches at a time."""
    held, count = [], 0
    for b in batches:
        held.append(np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], 1))
        count += b.num_rows
        if count > 1 << 20:
            held = [forest(np.concatenate(held))]
            if len(held[0]) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0].T.copy()], schema=EDGES)
                held = []
            count = sum(map(len, held))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(np.concatenate(held)).T.copy()], schema=EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for edges (a, b) of longs, without nulls: component is the smallest vertex that can be
    reached. Vertices without an edge, and the smallest ones of each component, have no row. Repeated edges, loops and
    an empty table do no harm."""
    now = save(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(thinned, "a long, b long").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        new = save(star, "edges")
        # Every vertex points at one other, and none of those points on: stars, and so components.
        more = new.groupBy("a").count().filter("count > 1").limit(1).count() or new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        drop(now)
        now = new
        if not more:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
