"""A graph as bucketed tables, so that expanding many nodes moves none of them.

nodes are bucketed and sorted by node_id, edges by source. Each edge carries what a line shows of its target, so the target's
row isn't joined either: the one shuffle that takes is done when the tables are written. A join of nodes with their edges then
reads bucket by bucket, without an exchange on either side; a search of many needles, an export or a count over all edges
costs no network but its own result. A bucket is one task's part, so their number follows the rows.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.sources.graph import NODE, ROWS_A_TASK, Graph
from wayfind.sources.store import shared_folder

BUCKETS = 32
BUCKET_BYTES = 64 << 20  # of nodes' strings in a bucket
CLIP = 201  # characters of a target's text: lines clip at 200, and must see that there are more


class Bucketed:
    """Tables ``name``_nodes and ``name``_edges of the session's catalog."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @property
    def nodes(self) -> DataFrame:
        return self.spark.table(f"{self.name}_nodes")

    @property
    def edges(self) -> DataFrame:
        return self.spark.table(f"{self.name}_edges")

    def expanded(self, starts: DataFrame | None = None, how: str = "left") -> DataFrame:
        """Nodes, all of them or what a filter of self.nodes has left, with a row for each outgoing edge: the columns of
        search.expanded()."""
        starts = self.nodes if starts is None else starts
        return starts.join(self.edges.withColumnRenamed("src", "node_id"), "node_id", how)

    def drop(self) -> None:
        for kind in ("nodes", "edges"):
            self.spark.sql(f"drop table if exists {self.name}_{kind}")


def buckets_for(graph: Graph, least: int) -> int:
    """``least``, or as many buckets as the edges' number and the bytes of the nodes' strings need."""
    size = graph.nodes.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in NODE)).cast("long")).first()[0] or 0
    return max(least, -(-graph.edges.count() // ROWS_A_TASK), -(-size // BUCKET_BYTES))


def save_bucketed(graph: Graph, buckets: int = BUCKETS, name: str | None = None) -> Bucketed:
    """Write the graph's nodes and edges as bucketed tables in the shared folder, in ``buckets`` or more of them."""
    spark = graph.nodes.sparkSession
    buckets = buckets_for(graph, buckets)
    name = name or f"graph_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    target = graph.nodes.select(F.col("node_id").alias("dst"), F.col("labels").alias("target_labels"), *[F.left(F.col(c), F.lit(CLIP)).alias(f"target_{c}") for c in X.SEARCHED])
    dealt = lambda df: df.repartition(buckets, "dst") if buckets > int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    edges = dealt(graph.edges).join(dealt(target), "dst").select("src", "edge_id", "type", F.col("dst").alias("target_id"), "target_labels", *[f"target_{c}" for c in X.SEARCHED])
    for kind, df, key in (("nodes", graph.nodes, "node_id"), ("edges", edges, "src")):
        # Dealt like the buckets, each of which is then one file.
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{kind}").mode("overwrite").saveAsTable(f"{name}_{kind}")
    return Bucketed(spark, name)
