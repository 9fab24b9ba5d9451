"""A stored graph with indexes: trigrams of its nodes' strings and segments of its nodes' edges.

All are tables of one log: nodes (by node_id), grams (postings of the places in the nodes' layers, by trigram) and segments
(edges by source, operators/adjacency.py). A change to nodes adds its own layer and the postings of that layer in one version;
nodes that are replaced or deleted keep their postings, but their places have gone, so nothing finds them. Packing the nodes
makes their postings anew.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators import adjacency as A
from wayfind.operators import grams as G
from wayfind.operators.search import hits_of, ranked_first
from wayfind.sources.graph import Graph, load, tasks_for
from wayfind.sources.log import Change, Log
from wayfind.sources.store import files_of, new_log, sized

FEW = 1000  # places up to which a filter names them, so that a scan skips what has none of them
PLACE = ["layer", "bucket", "_row"]


@dataclass
class Indexed(Graph):
    """The graph in a version of ``log``. Its searches read postings and the rows that these name."""

    log: Log
    state: dict

    def labelled(self, label: str) -> DataFrame:
        """The nodes of a label: nodes lie in a folder for each set of labels, and no other is read."""
        return self.rows("nodes").filter(F.array_contains(F.split("label_set", r"\|"), label)).select(*self.nodes.columns)

    def rows(self, name: str) -> DataFrame:
        """A table's rows with their places."""
        return self.log.rows(self.log.table(self.state, name), name)

    def segments(self) -> DataFrame:
        return self.rows("segments").drop("layer", "bucket", "_row")

    def candidates(self, needles: DataFrame) -> DataFrame:
        """(q, layer, bucket, _row) of the places that may hold needles (q) of three characters or more. Only the buckets of their
        trigrams are read."""
        wanted = needles.select(F.explode(G.grams(F.col("q"))).alias("gram"))
        found = Change(self.log, self.state).having("grams", wanted).drop("layer", "bucket", "_row").withColumnRenamed("node_layer", "layer")
        return G.candidates(needles, found)

    def matches(self, needle: str, columns=X.SEARCHED) -> DataFrame:
        """Nodes that hold the needle in one of the columns. A needle of fewer than three characters reads all,
        and so does one with many places: what a join would move between tasks, a scan tests where it lies."""
        if len(needle) < G.GRAM:
            return self.nodes.filter(X.holds(F.lit(needle), columns))
        spark, rows = self.log.spark, self.rows("nodes")
        left = self.candidates(spark.range(1).select(F.lower(F.lit(needle)).alias("q"))).select(*PLACE)
        few = left.limit(FEW + 1).collect()
        if len(few) > FEW:
            return self.nodes.filter(X.holds(F.lit(needle), columns))
        for c in PLACE:
            rows = rows.filter(F.col(c).isin(sorted({r[c] for r in few})))
        left = F.broadcast(spark.createDataFrame(few, "layer string, bucket int, _row long"))
        return rows.join(left, PLACE, "left_semi").select(*self.nodes.columns).filter(X.holds(F.lit(needle), columns))

    def found(self, needles: DataFrame) -> DataFrame:
        """(q, node_id, relevance) of all nodes that hold needles (q) of three characters or more."""
        rows = self.rows("nodes").select(*PLACE, "node_id", *X.SEARCHED)
        near = sized(self.candidates(needles), "places").join(rows, PLACE).filter(X.holds(F.col("q")))
        return near.select("q", "node_id", X.relevance(F.col("q")).alias("relevance"))

    def split(self, needles: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Different needles with a trigram, and those without if there are any."""
        asked = needles.select("q").distinct()
        short = asked.filter(F.length("q") < G.GRAM)
        return asked.filter(F.length("q") >= G.GRAM), short if short.limit(1).count() else None

    def hits(self, needles: DataFrame, limit: int, ranked: bool = True) -> DataFrame:
        """What hits_of() gives for needles (q, ...): by the index, and by a scan for short ones."""
        long_, short = self.split(needles)
        out = ranked_first(self.found(long_), limit, ranked)
        return out if short is None else out.unionByName(hits_of(self.nodes, short, limit, ranked))

    def starts(self, needles: DataFrame, limit: int) -> DataFrame:
        """(q, node_id) of nodes that hold a needle (q, ...); of short needles, for which all nodes are read, the first ``limit`` that
        an edge leaves."""
        long_, short = self.split(needles)
        out = self.found(long_).select("q", "node_id")
        if short is None:
            return out
        return out.unionByName(hits_of(A.leaving(self.nodes, self.segments()), short, limit, ranked=False).select("q", "node_id"))

    def walked(self, starts: DataFrame, hops: int, limit: int) -> DataFrame:
        """The first walks of each needle from starts (q, node_id), under q. The search comes first, and its ids meet the edges:
        no text is below that join."""
        rows = self.segments()
        return A.walks(A.leaving(starts, rows), rows, hops, X.whole(limit))


def with_postings(change: Change, layer: str) -> DataFrame:
    return G.postings(change.layer("nodes", layer)).withColumnRenamed("layer", "node_layer")


def by_labels(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("label_set", F.array_join(F.array_sort(F.transform("labels", lambda x: F.replace(x, F.lit("|"), F.lit("/")))), "|"))


KEY = ["gram", "node_layer", "node_bucket", "block", "piece"]


def build(graph: Graph, log: Log) -> Indexed:
    """Store a graph and its indexes as one version of an empty log."""
    change = log.begin()
    layer = change.create("nodes", by_labels(graph.nodes), ["node_id"], split=["label_set"])
    change.create("grams", with_postings(change, layer), KEY, by=["gram"])
    change.create("segments", A.segments(graph.edges), ["src", "start"], by=["src"])
    change.commit()
    return open_indexed(log)


def put_nodes(log: Log, nodes: DataFrame) -> int:
    """Add nodes, each with a node_id of its own, or replace those with their ids; gives the version."""
    change = log.begin()
    layer = change.upsert("nodes", by_labels(nodes))
    change.add("grams", with_postings(change, layer))
    return change.commit()


def delete_nodes(log: Log, nodes: DataFrame) -> int:
    change = log.begin()
    change.delete("nodes", nodes)
    return change.commit()


def put_edges(log: Log, edges: DataFrame) -> int:
    """Add edges, or replace those with their edge_id and source. The segments of the edges' sources, and no others, are read
    and made anew."""
    change = log.begin()
    sources = edges.select("src").distinct()
    old = A.edges_of(change.having("segments", sources))
    kept = old.join(edges.select("src", "edge_id"), ["src", "edge_id"], "left_anti")
    new = A.segments(kept.unionByName(edges.select(*kept.columns)))
    change.delete("segments", change.having("segments", sources))
    change.append("segments", new)
    change.read_tables.add("segments")  # another change to these sources is a conflict
    return change.commit()


def pack(log: Log) -> int:
    """Write nodes and their postings anew, without what has been replaced."""
    change = log.begin()
    layer = change.rewrite("nodes")
    change.rewrite("grams", with_postings(change, layer))
    return change.commit()


_stored: dict[tuple, tuple] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> Indexed:
    """The graph of the star schema's tables with its indexes, made once and again when a table's file has changed."""
    key, files = (spark.sparkContext.applicationId, sf_dir), files_of(spark, sf_dir)
    if key not in _stored or _stored[key][0] != files:
        _stored[key] = files, build(load(spark, sf_dir, tasks_for(spark, sf_dir)), new_log(spark, "index"))
    return _stored[key][1]


def open_indexed(log: Log, version: int | None = None) -> Indexed:
    state = log.state(version)
    return Indexed(log.read("nodes", state["version"]).drop("label_set"), A.edges_of(log.read("segments", state["version"])), log, state)
