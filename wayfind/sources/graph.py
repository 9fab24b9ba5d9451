"""A property graph as two DataFrames, and CSV tables of links.

nodes: node_id, labels, name, canonical_name, text, title, description, disease, symptom, canonical_id, original_id
edges: edge_id, src, dst, type, score
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("part", "supplier", "nation", "region", "customer", "documents", "embeddings", "lineitem")  # what load() reads
ROWS_A_TASK = 500_000  # edges that a task makes, sorts or writes
NODE = ["name", "canonical_name", "text", "title", "description", "disease", "symptom", "canonical_id", "original_id"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def views(self) -> None:
        """Register the views nodes and edges for SQL."""
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")


def node_rows(df: DataFrame, prefix: str, key: str, label: str, **columns: str) -> DataFrame:
    own = {c: F.col(columns[c]).cast("string") if c in columns else F.lit(None).cast("string") for c in NODE}
    return df.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("node_id"), F.array(F.lit(label)).alias("labels"), *[v.alias(k) for k, v in own.items()])


def edge_rows(df: DataFrame, source: str, source_key: str, kind: str, target: str, target_key: str, score=None) -> DataFrame:
    src = F.concat(F.lit(f"{source}:"), F.col(source_key).cast("string"))
    dst = F.concat(F.lit(f"{target}:"), F.col(target_key).cast("string"))
    return df.select(F.concat_ws("|", src, F.lit(kind), dst).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.lit(None) if score is None else score).cast("double").alias("score"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks among which the graph's edges are dealt; None if the session's number of shuffle partitions is enough. The count
    reads the footers of files."""
    n = -(-table(spark, sf_dir, "lineitem").count() // ROWS_A_TASK)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def load(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> Graph:
    """The graph of the star schema's tables. ``tasks``: among how many the pairs of the largest table are dealt, if not among
    the session's number."""
    t = {n: table(spark, sf_dir, n) for n in TABLES}
    nodes = [
        node_rows(t["part"], "part", "p_partkey", "Part", name="p_name", canonical_name="p_brand", text="p_type"),
        node_rows(t["supplier"], "supplier", "s_suppkey", "Supplier", name="s_name"),
        node_rows(t["nation"], "nation", "n_nationkey", "Nation", name="n_name"),
        node_rows(t["region"], "region", "r_regionkey", "Region", name="r_name"),
        node_rows(t["customer"], "customer", "c_custkey", "Customer", name="c_name", text="c_mktsegment"),
        node_rows(t["documents"], "doc", "doc_id", "Document", text="text"),
        node_rows(t["embeddings"], "vec", "vec_id", "EntityCanonical", canonical_id="vec_id", original_id="label"),
    ]
    pairs = t["lineitem"].select("l_partkey", "l_suppkey")
    pairs = (pairs.repartition(tasks, "l_partkey", "l_suppkey") if tasks else pairs).distinct()
    edges = [
        edge_rows(pairs, "part", "l_partkey", "SUPPLIED_BY", "supplier", "l_suppkey"),
        edge_rows(t["supplier"], "supplier", "s_suppkey", "IN_NATION", "nation", "s_nationkey"),
        edge_rows(t["customer"], "customer", "c_custkey", "IN_NATION", "nation", "c_nationkey"),
        edge_rows(t["nation"], "nation", "n_nationkey", "IN_REGION", "region", "n_regionkey"),
    ]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return Graph(union(nodes), union(edges))


def link_columns(names: list[str]) -> tuple[str, str, str]:
    """(source, target, score): for each the first name in file order that contains one of its keywords."""

    def pick(*keywords: str) -> str | None:
        return next((n for n in names if any(k in n.lower() for k in keywords)), None)

    found = pick("src", "source"), pick("tgt", "target"), pick("score")
    if None in found:
        raise ValueError(f"no source, target and score among the columns {names}")
    if len(set(found)) < 3:
        raise ValueError(f"one column would have two roles: {found}")
    return found


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, source, target, score) of a CSV file with a header; keys stay strings, rows without both go."""
    df = spark.read.option("header", True).csv(path)
    a, b, s = link_columns(df.columns)
    return df.select(F.monotonically_increasing_id().alias("row_no"), F.col(a).alias("source"), F.col(b).alias("target"), F.col(s).cast("double").alias("score")).dropna(subset=["source", "target"])
