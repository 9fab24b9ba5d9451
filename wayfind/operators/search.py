"""Entity search: scored, plain, chat and labelled, with one-hop expansion."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.sources.graph import NODE, Graph
from wayfind.sources.store import sized

TARGET = ["edge_id", "type", "target_id", "target_labels", "target_text", "target_name", "target_canonical_name"]
BLOCK_NEEDLES, BLOCK_BYTES = 50_000, 8 << 20  # needles that one pass over the nodes looks for
HELD = 500_000  # hits that a task holds before it gives them on


def expanded(starts: DataFrame, graph: Graph, how: str = "left", few: bool = False) -> DataFrame:
    """``starts`` with a row for each outgoing edge. Only the few edges of the starts meet the nodes; the starts' own
    rows are joined last, so a small start set can be broadcast though the join is an outer one. ``few``: a limit bounds the
    starts, so they and the ids of their edges are stored on the way, and neither all edges nor all nodes' texts are moved."""
    if few:
        starts = sized(starts, "starts")
    keys = starts.select(F.col("node_id").alias("src")).distinct()
    hit = graph.edges.join(keys, "src").select("src", "edge_id", "type", "dst")
    if few:
        hit = sized(hit, "hits")
    target = graph.nodes.select(F.col("node_id").alias("dst"), F.col("labels").alias("target_labels"), *[F.col(c).alias(f"target_{c}") for c in X.SEARCHED])
    found = hit.join(target, "dst").select(F.col("src").alias("node_id"), "edge_id", "type", F.col("dst").alias("target_id"), "target_labels", *[f"target_{c}" for c in X.SEARCHED])
    return starts.join(found, "node_id", how)


def matches(graph: Graph, needle: str, columns=X.SEARCHED) -> DataFrame:
    """Nodes that hold the needle in one of the columns: by the graph's index, or by a scan where it has none."""
    if hasattr(graph, "matches"):
        return graph.matches(needle, columns)
    return graph.nodes.filter(X.holds(F.lit(needle), columns))


def top_scored(graph: Graph, needle: str, limit: int = 15) -> DataFrame:
    """The ``limit`` most relevant nodes, by relevance and node_id."""
    found = matches(graph, needle).select("node_id", "labels", *X.SEARCHED, X.relevance(F.lit(needle)).alias("relevance"))
    return found.orderBy(F.desc("relevance"), "node_id").limit(X.whole(limit))


def scored(graph: Graph, needle: str, limit: int = 15, first_edge: bool = False) -> DataFrame:
    """Scored search: the top nodes, then their edges; ``first_edge`` keeps each node's first edge only."""
    out = expanded(top_scored(graph, needle, limit), graph, few=True)
    if first_edge:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("node_id").orderBy(F.col("edge_id").asc_nulls_last()))).filter("n = 1").drop("n")
    return out


def searched(block, limit: int | None, ranked: bool):
    """mapInArrow function over (node_id, text, name, canonical_name), all in lower case: (q, node_id, relevance) of the
    needles of ``block`` that a node holds; of each needle the task's first ``limit`` nodes by relevance, if ``ranked``, and
    node_id. A task that holds HELD hits keeps these first ones only; if they are still more than half of HELD, it gives them
    on and starts anew, so that it may give more than ``limit`` rows of a needle. Without a limit it gives all on."""

    def run(batches):
        import ahocorasick

        needles = block.value
        place = {q: i for i, q in enumerate(needles)}
        machine = ahocorasick.Automaton()
        for q, i in place.items():
            if q:
                machine.add_word(q, i)
        machine.make_automaton()
        everywhere = {place[""]} if "" in place else set()
        best: dict[int, list] = {}
        held = 0

        def inside(value):
            if value is None:
                return set()
            return {i for _, i in machine.iter(value)} | everywhere if len(machine) else everywhere

        def rows(found):
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([needles[i] for i, _, _ in part], pa.string()), pa.array([n for _, _, n in part], pa.string()), pa.array([-r for _, r, _ in part], pa.int32())], ["q", "node_id", "relevance"])

        for b in batches:
            for node, text, name, canonical in zip(*(c.to_pylist() for c in b.columns), strict=True):
                level = dict.fromkeys(inside(text), 1)
                level |= dict.fromkeys(inside(name) | inside(canonical), 5)
                level |= {place[v]: 10 for v in (name, canonical) if v in place}
                for i, r in level.items():
                    own = best.setdefault(i, [])
                    own.append((-r if ranked else 0, node, -r))
                    held += 1
                    if limit is not None and len(own) > 4 * limit:
                        own.sort()
                        held -= len(own) - limit
                        del own[limit:]
                if held > HELD:
                    if limit is not None:
                        for own in best.values():
                            own.sort()
                            del own[limit:]
                    held = sum(map(len, best.values()))
                    if held > HELD // 2:
                        yield from rows([(i, r, n) for i, own in best.items() for _, n, r in own])
                        best.clear()
                        held = 0
        yield from rows([(i, r, n) for i, own in best.items() for _, n, r in sorted(own)[:limit]])

    return run


def needles_of(questions: DataFrame) -> DataFrame:
    """(needle, q) of (entity, ...): each entity once, and in lower case."""
    return questions.filter("entity is not null").select(F.col("entity").alias("needle")).distinct().withColumn("q", F.lower("needle"))


def hits_of(nodes: DataFrame, needles: DataFrame, limit: int, ranked: bool = True, among: DataFrame | None = None) -> DataFrame:
    """(q, node_id, relevance, rank) of needles (q, ...) in lower case: the first ``limit`` nodes of each by relevance, if
    ``ranked``, and node_id. A substring is no join key, so an automaton of all needles reads each value once, whatever
    their number. Needles go to the tasks in blocks of a checked size; each block is one pass over the nodes. The limit is
    applied in each task first, so a word that every node holds costs no more rows than another. With ``among`` (node_id), only nodes of
    these ids count: then the ids of all hits meet them before the limit, and no text is moved."""
    most = None if among is not None else X.whole(limit)
    spark = nodes.sparkSession
    asked = needles.select("q").distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("q")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_NEEDLES), -(-size // BLOCK_BYTES))
    values = nodes.select("node_id", *[F.lower(c).alias(c) for c in X.SEARCHED])
    out = None
    for k in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k)
        found = values.mapInArrow(searched(spark.sparkContext.broadcast([r.q for r in part.collect()]), most, ranked), "q string, node_id string, relevance int")
        out = found if out is None else out.unionByName(found)
    if among is not None:
        out = out.join(among, "node_id", "left_semi")
    return ranked_first(out, limit, ranked)


def ranked_first(found: DataFrame, limit: int, ranked: bool = True) -> DataFrame:
    """The first ``limit`` of found rows (q, node_id, relevance) of each needle, with their rank."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(*([F.desc("relevance")] if ranked else []), "node_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit)


def hits(graph: Graph, needles: DataFrame, limit: int, ranked: bool = True) -> DataFrame:
    """What hits_of() gives: by the graph's index, or by a scan where it has none."""
    return graph.hits(needles, limit, ranked) if hasattr(graph, "hits") else hits_of(graph.nodes, needles, limit, ranked)


def scored_batch(graph: Graph, questions: DataFrame, limit: int = 15) -> DataFrame:
    """Top nodes for each row of (qid, entity, ...). Entities that are equal but for case are searched once; the limit is
    applied before rows are brought together, in each task, and only the rows that are left fetch their texts. node_id is
    the nodes' key."""
    needles = needles_of(questions)
    top = sized(hits(graph, needles, limit).join(needles, "q"), "hits")
    own = graph.nodes.select("node_id", "labels", *X.SEARCHED)
    return top.join(own, "node_id").select("needle", "node_id", "labels", *X.SEARCHED, "relevance", "rank")


def plain(graph: Graph, needle: str, limit: int = 5) -> DataFrame:
    """Unscored search: matches with their edges, of which the first ``limit`` rows count. Each match has a row, so the first
    ``limit`` matches are enough."""
    few = matches(graph, needle).select("node_id", "labels", *X.SEARCHED).orderBy("node_id").limit(X.whole(limit))
    return expanded(few, graph, few=True).orderBy("node_id", F.col("edge_id").asc_nulls_first()).limit(X.whole(limit))


def chat(graph: Graph, message: str, limit: int = 5) -> DataFrame:
    """Search of the whole message in six properties."""
    return matches(graph, message, X.CHAT_SEARCHED).orderBy("node_id").limit(X.whole(limit))


def labelled(graph: Graph, name: str, needle: str, limit: int = 15) -> DataFrame:
    """Nodes of a label whose name contains the needle, with the edges they must have."""
    own = graph.labelled(name) if hasattr(graph, "labelled") else graph.nodes
    starts = own.filter(F.array_contains("labels", name) & F.contains(F.lower("name"), F.lit(needle.lower()))).select("node_id", "labels", *X.SEARCHED)
    return expanded(starts, graph, "inner").orderBy("node_id", "edge_id").limit(X.whole(limit))


def schema(graph: Graph) -> DataFrame:
    """(kind, names): all labels and all edge types, sorted, joined by commas."""
    labels = graph.nodes.select(F.explode("labels").alias("x")).distinct().select(F.lit("labels").alias("kind"), "x")
    types = graph.edges.select(F.col("type").alias("x")).distinct().select(F.lit("types").alias("kind"), "x")
    return labels.unionByName(types).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("names"))


def sample(graph: Graph, limit: int = 5) -> DataFrame:
    """A few nodes with all their properties."""
    return graph.nodes.orderBy("node_id").limit(X.whole(limit)).select("node_id", X.label().alias("label"), *NODE)


def select(graph: Graph, statement: str, args: dict | None = None) -> DataFrame:
    """A user's query over the views nodes and edges; anything but a query is refused."""
    head = statement.strip().split(None, 1)[0].lower() if statement.strip() else ""
    if head not in ("select", "with"):
        raise ValueError("only SELECT statements are allowed")
    graph.views()
    return graph.nodes.sparkSession.sql(statement, args=args or {})
