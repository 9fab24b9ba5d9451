"""Graphs in storage: nodes and edges as tables under one log, with uniqueness and known endpoints."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators.ingest import duplicates, last_scores
from wayfind.sources.graph import TABLES, Graph, load, tasks_for
from wayfind.sources.log import Log, file_system


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where that is unset, a local session gets a temporary
    one, and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if spark.sparkContext.applicationId not in _own:
            _own[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='wayfind-')}"
        base = _own[spark.sparkContext.applicationId]
    return base.rstrip("/")


_own: dict[str, str] = {}


def new_log(spark: SparkSession, name: str) -> Log:
    """An empty log in a new folder of the shared one."""
    return Log(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to a new folder in the shared one and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str) -> DataFrame:
    """``df``, narrow and for most callers short, written where a folder is shared: from its file Spark knows its size before it plans
    what comes next, and takes a short one to a large table. A join's or a search's size it overrates, and would move the large table."""
    try:
        return kept(df, name)
    except ValueError:
        return df


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, after a check that no value of ``key`` but null occurs twice; raises and names one otherwise."""
    twice = duplicates(df, key).limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0].key} occurs {twice[0].n} times")
    return df


def keyed(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """(key, node_id) of a label's nodes with a key."""
    return nodes.filter(F.array_contains("labels", label) & F.col(key).isNotNull()).select(key, "node_id")


def create_nodes(log: Log, nodes: DataFrame, label: str, key: str = "canonical_id") -> int:
    """A table of nodes, and one of the keys of ``label``, which must be unique; gives the version."""
    change = log.begin()
    change.create("nodes", nodes, ["node_id"])
    change.create(f"nodes_{key}", unique(keyed(nodes, label, key), key), [key])
    return change.commit()


def put_nodes(log: Log, nodes: DataFrame, label: str, key: str = "canonical_id") -> int:
    """Add nodes, each with a node_id of its own, or replace those with their ids; gives the version. Raises where a key of
    ``label`` would occur twice. The check reads the buckets of the new keys in the table of keys, and no others; a key that
    another writer adds meanwhile makes the commit fail."""
    change, keys = log.begin(), f"nodes_{key}"
    new = unique(keyed(nodes, label, key), key)
    old = keyed(change.lookup("nodes", nodes), label, key)
    held = change.lookup(keys, new.select(key)).withColumnRenamed("node_id", "_holder")
    taken = new.join(held, key).filter("node_id <> _holder").join(nodes.select(F.col("node_id").alias("_holder")), "_holder", "left_anti").limit(1).collect()
    if taken:
        raise ValueError(f"{key} {taken[0][key]} belongs to {taken[0]._holder}")
    change.delete(keys, old.join(new, [key, "node_id"], "left_anti"))
    change.append(keys, new.join(old, [key, "node_id"], "left_anti"))
    change.upsert("nodes", nodes)
    return change.commit()


def upsert_links(log: Log, rows: DataFrame) -> int:
    """Links (row_no, source, target, score) between known keys of the table nodes (key) into the table edges (src, dst,
    score): the last row of each directed pair counts; gives the version. Fails if nodes go meanwhile."""
    change = log.begin()
    change.upsert("edges", last_scores(change.read("nodes"), rows))
    return change.commit()


def save_graph(graph: Graph, log: Log) -> int:
    """The graph as tables nodes (by node_id) and edges (by edge_id), in one version."""
    change = log.begin()
    change.create("nodes", graph.nodes, ["node_id"])
    change.create("edges", graph.edges, ["edge_id"])
    return change.commit()


def open_graph(log: Log, version: int | None = None) -> Graph:
    """The graph of one version."""
    version = log.state(version)["version"]
    return Graph(log.read("nodes", version), log.read("edges", version))


def files_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, length and time of change of every file of the graph's tables."""
    out = []
    for name in TABLES:
        fs, p = file_system(spark, f"{sf_dir}/{name}.parquet")
        found = fs.listFiles(p, True)
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


_stored: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the star schema's tables. Its edges are distinct pairs of the largest table: they are written once, by
    type and source, by as many tasks as their number needs, and read from there as long as the tables' files stay as they are; when
    one has changed, they are made again. Where no folder is shared, they are made for each query."""
    graph = load(spark, sf_dir)
    try:
        folder = shared_folder(spark)
    except ValueError:
        return graph
    key = spark.sparkContext.applicationId, sf_dir
    files = files_of(spark, sf_dir)
    if key not in _stored or _stored[key][0] != files:
        path, tasks = f"{folder}/edges-{uuid.uuid4().hex}", tasks_for(spark, sf_dir)
        load(spark, sf_dir, tasks).edges.repartitionByRange(*[tasks] * bool(tasks), "type", "src", "dst").sortWithinPartitions("type", "src").write.partitionBy("type").parquet(path)
        _stored[key] = files, spark.read.parquet(path).select(*graph.edges.columns)
    return Graph(graph.nodes, _stored[key][1])
