"""Variable-length paths: nodes may repeat in a path, edges may not."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators.search import hits_of, needles_of
from wayfind.sources.graph import Graph
from wayfind.sources.store import sized

ORDER = ["path_length", "start_id", "path", "end_id"]


def walks(starts: DataFrame, graph: Graph, hops: int, limit: int | None = None, keys: tuple = ()) -> DataFrame:
    """(keys, start_id, end_id, path_length, path, types) of all walks of 1 to ``hops`` edges from starts (keys, node_id).
    With a limit the first ones of each key by ORDER: as shorter ones come first, each level gives its own first ``limit``,
    while the next level goes on from the whole level, but only for keys that shorter walks have not filled. There, a level's ids are
    stored before the next one, so they go to the edges and the edges stay where they are."""
    X.whole(hops, 1, "hops")
    if limit is not None:
        X.whole(limit)
    by = list(keys) or ["_all"]
    starts = starts if keys else starts.withColumn("_all", F.lit(0))

    def first(rows):
        if limit is None:
            return rows
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER))).filter(F.col("_n") <= limit).drop("_n")

    step = graph.edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "edge_id", "type")
    level = starts.select(*by, F.col("node_id").alias("start_id"), F.col("node_id").alias("end_id"), F.array().cast("array<string>").alias("edge_ids"), F.array().cast("array<string>").alias("types_"))
    out = None
    for n in range(1, hops + 1):
        if limit is not None and out is not None:
            level = level.join(out.groupBy(*by).count().filter(F.col("count") >= limit).select(*by), by, "left_anti")
        level = level.join(step, (F.col("end_id") == F.col("_src")) & ~F.array_contains("edge_ids", F.col("edge_id"))).select(*by, "start_id", F.col("_dst").alias("end_id"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), F.array_append("types_", F.col("type")).alias("types_"))
        if limit is not None and n < hops:
            level = sized(level, "walks")
        rows = first(level.select(*by, "start_id", "end_id", F.lit(n).alias("path_length"), F.array_join("edge_ids", ",").alias("path"), F.array_join("types_", " → ").alias("types")))
        out = rows if out is None else out.unionByName(rows)
    return first(out).select(*keys, *[c for c in out.columns if c not in by])


def sources(graph: Graph) -> DataFrame:
    """(node_id) of the nodes that an edge leaves. Each gives a walk of one edge, and these come first by start: of a needle's
    nodes the first ``limit`` such starts hold all that a limited search can return. Each id once, as edges are many more."""
    return graph.edges.select(F.col("src").alias("node_id")).distinct()


def multi_hop(graph: Graph, needle: str, hops: int = 2, limit: int = 20) -> DataFrame:
    if hasattr(graph, "walked"):
        return graph.walked(graph.matches(needle).select(F.lit(needle).alias("q"), "node_id"), hops, limit).drop("q")
    found = graph.nodes.filter(X.holds(F.lit(needle))).select("node_id")
    starts = found.join(sources(graph), "node_id", "left_semi").orderBy("node_id").limit(X.whole(limit))
    return walks(sized(starts, "starts"), graph, hops, limit)


def multi_hop_batch(graph: Graph, questions: DataFrame, hops: int = 2, limit: int = 20) -> DataFrame:
    """The first walks of each entity of questions (entity, ...), under ``needle``: one plan for all of them. Entities that
    are equal but for case are searched and walked from once."""
    needles = needles_of(questions)
    if hasattr(graph, "walked"):
        return graph.walked(graph.starts(needles, limit), hops, limit).join(needles, "q").drop("q")
    starts = hits_of(graph.nodes, needles, limit, ranked=False, among=sources(graph)).select("q", "node_id")
    found = walks(sized(starts, "starts"), graph, hops, limit, ("q",))
    return found.join(needles, "q").drop("q")


def recursive(graph: Graph, start: str, hops: int) -> DataFrame:
    """Walks from one node by a recursive query, for any number of hops."""
    graph.views()
    return graph.nodes.sparkSession.sql(
        """
        with recursive w(start_id, end_id, path_length, edge_ids) as (
          select src, dst, 1, array(edge_id) from edges where src = :start
          union all
          select w.start_id, e.dst, w.path_length + 1, array_append(w.edge_ids, e.edge_id)
          from w join edges e on e.src = w.end_id
          where w.path_length < :hops and not array_contains(w.edge_ids, e.edge_id)
        )
        select start_id, end_id, path_length, array_join(edge_ids, ',') as path from w
        """,
        args={"start": start, "hops": int(hops)},
    )
