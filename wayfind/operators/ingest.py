"""Bulk updates of the graph, and checks of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.sources.graph import Graph


def last_scores(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """(src, dst, score) of rows (row_no, source, target, score): each directed pair of known ``keys`` (key), with the score of
    its last row."""
    known = rows.join(keys.select(F.col("key").alias("source")), "source", "left_semi").join(keys.select(F.col("key").alias("target")), "target", "left_semi")
    return known.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.max_by("score", "row_no").alias("score"))


def upsert_edges(keys: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``edges`` (src, dst, score) after rows (row_no, source, target, score): an edge for each directed pair of known
    ``keys`` (key), with the score of the last row. Running it again with the same rows changes nothing."""
    new = last_scores(keys, rows)
    return edges.join(new, ["src", "dst"], "left_anti").select("src", "dst", "score").unionByName(new)


def rejected(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with an endpoint that isn't known."""
    ok = rows.join(keys.select(F.col("key").alias("source")), "source", "left_semi").join(keys.select(F.col("key").alias("target")), "target", "left_semi")
    return rows.join(ok.select("row_no"), "row_no", "left_anti")


def harvest(nodes: DataFrame) -> DataFrame:
    """(original_id, text) of nodes with a text."""
    return nodes.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("node_id", "original_id", "text")


def update_embeddings(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes (original_id, embedding, ...) with the embeddings of rows (row_no, original_id, embedding): every node with
    the id, by the last row of the id; null ids match nothing."""
    last = rows.filter("original_id is not null").groupBy("original_id").agg(F.max_by("embedding", "row_no").alias("_new"))
    return nodes.join(last, "original_id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; a uniqueness constraint holds if there are none."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(F.col(key).cast("string").alias("key"), F.col("count").alias("n"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leaves or reaches, by two anti joins."""
    return nodes.join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def integrity(graph: Graph, label: str = "EntityCanonical", kind: str = "SIMILAR_TO") -> DataFrame:
    """(metric, value): nodes of the label, edges of the kind between them, nodes without any such edge."""
    own = graph.nodes.filter(F.array_contains("labels", label)).select("node_id")
    links = graph.edges.filter(F.col("type") == kind)
    inside = links.join(own.select(F.col("node_id").alias("src")), "src", "left_semi").join(own.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    return count(own, "canonical_nodes").unionByName(count(inside, "similarity_links")).unionByName(count(isolated(own, links), "canonical_without_similarity"))


def integrity_of_counts(nodes: DataFrame, counts: DataFrame, label: str = "EntityCanonical") -> DataFrame:
    """What integrity() gives where links go both ways between nodes of the label, from counts (node_id, links) of those that leave
    each: counts are as many as nodes, where links may be as many as pairs."""
    own = nodes.filter(F.array_contains("labels", label)).select("node_id", F.lit(1).alias("n"), F.lit(0).cast("long").alias("links"))
    each = own.unionByName(counts.select("node_id", F.lit(0).alias("n"), "links")).groupBy("node_id").agg(F.sum("n").alias("n"), F.sum("links").alias("links"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    all_ = each.agg(total("n").alias("nodes"), total("links").alias("links"), total(F.when(F.col("links") == 0, F.col("n"))).alias("alone"))
    return all_.select(F.expr("stack(3, 'canonical_nodes', nodes, 'similarity_links', links, 'canonical_without_similarity', alone) as (metric, value)"))
