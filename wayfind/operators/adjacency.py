"""Edges by source, in segments: walks and contexts that read a bounded part of a hub.

A segment holds up to SEGMENT edges of one source in the order of edge_id, and the rank of the first; a source with many
edges has many segments. Edges are dealt by ranges of (source, edge_id), so a hub's segments are made by several tasks, and
ranks come from the segments' sizes.

Walks come in the order of length, start and edges. Of walks that differ in the last edge only, those by its first edges come
first. So of each walk that a limited search goes on from, the first edges of its end are enough: as many as the limit, and one
for each edge that the walk has used up. A search goes on to longer walks only with needles whose shorter walks don't fill the limit, so
there are fewer than the limit of these. Both bounds hold for every needle, whatever a hub's size.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators.context import edge_text, node_text
from wayfind.operators.paths import ORDER
from wayfind.sources.store import sized

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT = 1000
KEPT = ["edge_id", "dst", "type", "score"]
ROW = "src string, start long, size int, edges array<struct<edge_id: string, dst: string, type: string, score: double>>"


def cut(size: int):
    """mapInArrow function over edges in the order of source and edge_id: (src, size, edges) of up to ``size`` edges each."""

    def run(batches):
        held = None  # rows from the beginning of a segment that the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            src = t.column(0)
            changes = np.r_[True, pc.not_equal(src[1:], src[:-1]).to_numpy(zero_copy_only=False)]
            at = np.arange(len(src))
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(changes, at, 0))) % size == 0)
            held = t.slice(starts[-1])
            if len(starts) > 1:
                yield whole(t, starts)
        if held is not None:
            yield whole(held, np.array([0, held.num_rows]))

    def whole(t, ends):
        """Segments between places of a batch."""
        edges = pa.StructArray.from_arrays(t.columns[1:], names=t.schema.names[1:])
        return pa.RecordBatch.from_arrays([t.column(0).take(pa.array(ends[:-1])), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), edges)], ["src", "size", "edges"])

    return run


def segments(edges: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(src, start, size, edges) of edges (edge_id, src, dst, type, score): each source's edges by edge_id, in segments."""
    rows = edges.filter("src is not null").select("src", *KEPT).repartitionByRange("src", "edge_id").sortWithinPartitions("src", "edge_id")
    parts = rows.mapInArrow(cut(size), "src string, size int, edges array<struct<edge_id: string, dst: string, type: string, score: double>>")
    first = F.get("edges", F.lit(0))["edge_id"]
    before = Window.partitionBy("src").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")).select("src", "start", "size", "edges")


def edges_of(rows: DataFrame) -> DataFrame:
    """The edges of segments."""
    return rows.select("src", F.explode("edges").alias("e")).select("e.edge_id", "src", "e.dst", "e.type", "e.score")


def leaving(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of hits (node_id, ...) that an edge leaves. Narrow on both sides: ids only."""
    return hits.join(rows.filter("start = 0").select(F.col("src").alias("node_id")), "node_id", "left_semi")


def walks(starts: DataFrame, rows: DataFrame, hops: int, limit: int, keys: tuple = ("q",)) -> DataFrame:
    """The first ``limit`` walks of 1 to ``hops`` edges of each key from starts (keys, node_id), as paths.walks() gives them. Reads
    segments (``rows``) that begin before the limit, and of these as many edges as can count."""
    X.whole(hops, 1, "hops")
    X.whole(limit)
    by = list(keys)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER))
    most = limit + hops
    heads = rows.filter(F.col("start") < most).select(F.col("src").alias("end_id"), F.slice("edges", F.lit(1), F.greatest(F.lit(0), F.least(F.col("size"), F.lit(most) - F.col("start"))).cast("int")).alias("edges"))
    none = F.array().cast("array<string>")
    own = F.row_number().over(Window.partitionBy(*by).orderBy("node_id"))
    level = starts.select(*by, "node_id").withColumn("_n", own).filter(F.col("_n") <= limit).select(*by, F.col("node_id").alias("start_id"), F.col("node_id").alias("end_id"), none.alias("edge_ids"), none.alias("types_"))
    out = None
    for n in range(1, hops + 1):
        if out is not None:
            level = level.join(out.groupBy(*by).count().filter(F.col("count") >= limit).select(*by), by, "left_anti")
        free = F.filter("edges", lambda e: ~F.array_contains("edge_ids", e["edge_id"]))
        level = level.join(heads, "end_id").select(*by, "start_id", "edge_ids", "types_", F.explode(free).alias("e")).select(
            *by, "start_id", F.col("e.dst").alias("end_id"), F.array_append("edge_ids", F.col("e.edge_id")).alias("edge_ids"), F.array_append("types_", F.col("e.type")).alias("types_")
        )
        level = level.withColumn("path_length", F.lit(n)).withColumn("path", F.array_join("edge_ids", ",")).withColumn("_n", first).filter(F.col("_n") <= limit).drop("_n")
        here = level.select(*by, "start_id", "end_id", "path_length", "path", F.array_join("types_", " → ").alias("types"))
        out = here if out is None else out.unionByName(here)
    return out.withColumn("_n", first).filter(F.col("_n") <= limit).drop("_n")


def digits(a, n):
    """How many digits the ``n`` whole numbers from ``a`` on have."""
    out = F.lit(0).cast("long")
    for k in range(18):  # each number has a digit for each power of ten up to it
        out = out + F.greatest(F.lit(0).cast("long"), a + n - F.greatest(a, F.lit(10**k).cast("long")))
    return out


def bounded_context(top: DataFrame, rows: DataFrame, nodes: DataFrame, keys: tuple = ("needle",), most: int = 4500) -> DataFrame:
    """(keys, context, context_length) of found nodes (keys, node_id, labels, texts, relevance, rank): the first ``most``
    characters of what context.joined() makes of the nodes and their edges, and the length of all of it. Lines are numbered by the ranks of
    edges, so no hub is sorted or collected: each task keeps a key's first lines that can be in the cut context, and lengths are sums. What is found,
    and the ids of its edges, are stored first, so that they go to the segments and the nodes."""
    by = list(keys)
    head = F.when(X.shown() != "", node_text(X.label(), X.shown(), F.col("relevance")))
    top = sized(top.select(*by, "node_id", "rank", head.alias("head")), "found")
    degree = rows.join(top.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").groupBy("src").agg(F.sum("size").alias("n")).withColumnRenamed("src", "node_id")
    found = top.join(degree, "node_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    before = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    based = found.withColumn("base", F.coalesce(F.sum(F.greatest("n", F.lit(1).cast("long"))).over(before), F.lit(0)).cast("long"))
    based = sized(based.select(*by, "node_id", "n", "base", "head"), "found")
    # Every row of a node repeats its line; only the number at its beginning differs.
    heads = F.coalesce((F.length("head").cast("long") + 1) * F.greatest("n", F.lit(1).cast("long")) + digits(F.col("base") + 1, F.greatest("n", F.lit(1).cast("long"))), F.lit(0))
    target = nodes.select(F.col("node_id").alias("dst"), X.label().alias("_label"), F.left(X.shown(), F.lit(201)).alias("_text")).filter("_text <> ''")
    near = based.join(rows.select(F.col("src").alias("node_id"), "start", "edges"), "node_id").select(*by, "base", "head", "start", F.posexplode("edges").alias("place", "e"))
    edges = sized(near.select(*by, "base", "head", "start", "place", F.struct("e.type").alias("e"), F.col("e.dst").alias("dst")), "near")
    lined = edges.join(target, "dst", "left").withColumn("edge_line", edge_text(F.col("e.type"), F.col("_label"), F.col("_text")))
    numbered = lined.select(*by, (F.col("base") + F.col("start") + F.col("place") + 1).alias("i"), "head", "edge_line")
    alone = based.filter("n = 0").select(*by, (F.col("base") + 1).alias("i"), "head", F.lit(None).cast("string").alias("edge_line"))
    all_ = numbered.unionByName(alone)
    line = F.concat_ws("\n", F.concat(F.col("i").cast("string"), "head"), "edge_line")
    shown = all_.select(*by, "i", line.alias("s")).filter("s <> ''")
    few = most // 8 + 1  # a row's line has 8 characters at least
    first = shown.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("i"))).filter(F.col("_n") <= few).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("l"))
    text = first.select(*by, F.left(F.array_join(F.transform("l", lambda x: x["s"]), "\n"), F.lit(most)).alias("context"))
    sums = based.groupBy(*by).agg(F.sum(heads).alias("a")).join(numbered.groupBy(*by).agg(F.sum(F.coalesce(F.length("edge_line").cast("long") + 1, F.lit(0))).alias("b")), by, "left")
    size = sums.select(*by, F.greatest(F.lit(0).cast("long"), F.col("a") + F.coalesce("b", F.lit(0)) - 1).alias("context_length"))
    return size.join(text, by, "left").select(*by, F.coalesce("context", F.lit("")).alias("context"), "context_length")
