"""Indexes of a stored graph against scans: trigrams, segments, bounded contexts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_graph import graph_of
from wayfind.functions import text as X
from wayfind.operators import adjacency as A
from wayfind.operators import context as C
from wayfind.operators import grams as R
from wayfind.operators import paths as P
from wayfind.operators import search as S
from wayfind.plans import ask as Q
from wayfind.sources import indexed as I
from wayfind.sources.graph import load
from wayfind.sources.log import Conflict, Log

NEEDLES = ["ab", "bca", "ÄBC", "abc", "", "x", "none of it", "cabca", "𝔘bc", "ABCABCA", "bca ab", "i̇", "ßßß"]


def words(r):
    return r.choice([None, "", "Ab", "𝔘BC", "ÄBc", "ßßß", "İx"] + ["".join(r.choice("abc ") for _ in range(r.randrange(40))) for _ in range(9)])


def graph_with(spark, seed, n=120, m=300):
    r = random.Random(seed)
    nodes = [(f"n{i:03}", r.choice([["L"], [], ["Much", "L"]]), words(r), words(r), words(r)) for i in range(n)]
    edges = [(f"e{i:03}", f"n{r.randrange(n // 2):03}", f"n{r.randrange(n):03}", r.choice("ST")) for i in range(m)]
    return graph_of(spark, nodes, edges)


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, f"file://{tmp_path}/index")


def ids(df):
    return sorted(r.node_id for r in df.select("node_id").collect())


def same_searches(spark, graph, own, needles=NEEDLES):
    for q in needles[::2]:
        assert ids(own.matches(q)) == ids(graph.nodes.filter(X.holds(F.lit(q)))), q
    asked = spark.createDataFrame([(i, q) for i, q in enumerate([*needles, None, "ABC"])], "qid long, entity string")
    found = lambda g: sorted((r.needle, r.rank, r.node_id, r.relevance) for r in S.scored_batch(g, asked, 4).collect())
    assert found(own) == found(graph)


@pytest.mark.parametrize("small", [False, True])
def test_searches_by_trigram_are_those_of_a_scan(spark, log, monkeypatch, small):
    if small:  # many pieces, few trigrams of a needle, and the way for many places
        monkeypatch.setattr(R, "HELD", 50)
        monkeypatch.setattr(R, "RAREST", 2)
        monkeypatch.setattr(I, "FEW", 2)
    graph = graph_with(spark, 1)
    own = I.build(graph, log)
    same_searches(spark, graph, own)
    for q in ("bca", "ab"):
        order = lambda df: [tuple(r) for r in df.collect()]
        assert order(S.top_scored(own, q, 7)) == order(S.top_scored(graph, q, 7)) and order(S.chat(own, q)) == order(S.chat(graph, q))
        assert order(S.plain(own, q)) == order(S.plain(graph, q))
    assert own.edges.count() == graph.edges.count()


def test_the_index_follows_changes(spark, log):
    graph, other = graph_with(spark, 2), graph_with(spark, 3)
    half = F.expr("cast(substr(node_id, 2) as int) % 2 = 0")
    I.build(type(graph)(graph.nodes.filter(half), graph.edges), log)
    assert I.put_nodes(log, graph.nodes.filter(~half)) == 2
    same_searches(spark, graph, I.open_indexed(log), NEEDLES[1:4])
    third = F.expr("cast(substr(node_id, 2) as int) % 3 = 0")
    I.put_nodes(log, other.nodes.filter(third))
    I.delete_nodes(log, graph.nodes.filter("node_id like 'n00%'"))
    now = graph.nodes.filter(~third).unionByName(other.nodes.filter(third)).filter("node_id not like 'n00%'")
    changed = type(graph)(now, graph.edges)
    same_searches(spark, changed, I.open_indexed(log), NEEDLES[1:4])
    before = log.read("grams").count()
    I.pack(log)
    assert log.read("grams").count() < before
    same_searches(spark, changed, I.open_indexed(log), NEEDLES[1:4])
    assert ids(I.open_indexed(log, 1).matches("abc")) == ids(graph.nodes.filter(half).filter(X.holds(F.lit("abc"))))


def test_a_search_reads_its_postings_and_places_only(spark, log):
    nodes = spark.range(20_000).selectExpr("concat('n', id) as node_id", "array('L') as labels", "concat('name ', id) as name", "cast(null as string) as canonical_name", "repeat('common text ', 3) as text")
    rest = [F.lit(None).cast("string").alias(c) for c in ("title", "description", "disease", "symptom", "canonical_id", "original_id")]
    own = I.build(graph_of(spark, [], []).__class__(nodes.select("*", *rest), graph_of(spark, [], []).edges), log)
    found = own.matches("name 1234")
    assert ids(found) == sorted(["n1234", *(f"n1234{i}" for i in range(10))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert re.search(r"_row#\d+L IN", plan) and "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters")[1]
    assert S.matches(own, "common").count() == 20_000
    # A trigram of all nodes is many rows of a bounded size.
    heavy = log.read("grams").filter(F.col("gram") == R.codes_of(["com"])[0].item())
    assert heavy.agg(F.sum("n")).first()[0] == 20_000 and heavy.agg(F.max(F.length("places"))).first()[0] <= 2 * 65536


def test_a_label_is_read_from_its_folders(spark, log):
    """Also where a node has several, and where the graph is a union of tables."""
    graph = graph_with(spark, 4, 60, 90)
    own = I.build(graph, log)
    for label in ("L", "Much", "N"):
        assert ids(own.labelled(label)) == ids(graph.nodes.filter(F.array_contains("labels", label)))
    order = lambda df: [tuple(r) for r in df.collect()]
    assert order(S.labelled(own, "Much", "b")) == order(S.labelled(graph, "Much", "b"))
    scan = next(x for x in own.labelled("Much")._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "array_contains" in scan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    I.put_nodes(log, graph.nodes.withColumn("labels", F.array(F.lit("N"), F.lit("a|b"))).limit(3))
    assert len(ids(I.open_indexed(log).labelled("N"))) == 3
    star = load(spark, "/root/testdata/sf0.001").nodes.filter(F.array_contains("labels", "Part"))
    assert {f.rsplit("/", 1)[1] for f in star.inputFiles()} >= {"part.parquet"} and star._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_trigrams_agree_in_spark_and_python(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("abÄ𝔘ß ") for _ in range(r.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.grams(F.col("t")).alias("g"))
    assert all(sorted(x.g) == R.codes_of([x.t]).tolist() for x in df.collect())


@pytest.mark.parametrize("size", [2, 1000])
def test_walks_over_segments_are_those_over_edges(spark, log, monkeypatch, size):
    monkeypatch.setattr(A.segments, "__defaults__", (size,))
    graph = graph_with(spark, 5, 40, 120)
    own = I.build(graph, log)
    rows = own.segments()
    assert rows.agg(F.max("size")).first()[0] <= size and rows.agg(F.sum("size")).first()[0] == 120
    assert rows.select("src", F.posexplode("edges").alias("p", "e"), "start").filter("start > 0").count() > 0 or size == 1000
    order = lambda df: [tuple(r) for r in df.orderBy("q", *P.ORDER).collect()]
    starts = graph.nodes.select(F.substring("node_id", 3, 1).alias("q"), "node_id")
    for hops, limit in ((2, 5), (3, 200)):
        assert order(A.walks(A.leaving(starts, rows), rows, hops, limit)) == order(P.walks(starts, graph, hops, limit, ("q",)))
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["abc", "ab", "", "b", "none", None])], "qid long, entity string")
    batch = lambda g: sorted(map(tuple, P.multi_hop_batch(g, asked, 2, 9).select("needle", *P.ORDER, "types").collect()))
    assert batch(own) == batch(graph)
    assert [tuple(r) for r in P.multi_hop(own, "abc", 2, 9).orderBy(*P.ORDER).collect()] == [tuple(r) for r in P.multi_hop(graph, "abc", 2, 9).orderBy(*P.ORDER).collect()]


def test_edges_that_change(spark, log):
    graph = graph_with(spark, 6, 30, 90)
    half = F.expr("cast(substr(edge_id, 2) as int) % 2 = 0")
    I.build(type(graph)(graph.nodes, graph.edges.filter(half)), log)
    late = log.begin()
    assert I.put_edges(log, graph.edges.filter(~half)) == 2
    I.put_edges(log, graph.edges.filter("edge_id = 'e001'").withColumn("type", F.lit("NEW")))
    got = sorted((r.edge_id, r.src, r.dst) for r in I.open_indexed(log).edges.collect())
    assert got == sorted((r.edge_id, r.src, r.dst) for r in graph.edges.collect())
    assert [r.type for r in I.open_indexed(log).edges.filter("edge_id = 'e001'").collect()] == ["NEW"]
    ranks = log.read("segments").groupBy("src").agg(F.sum("size").alias("n"), F.max(F.col("start") + F.col("size")).alias("m")).filter("n <> m").count()
    assert ranks == 0
    late.append("segments", A.segments(graph.edges.filter(~half)))
    with pytest.raises(Conflict):
        late.commit()


def test_a_hub_is_read_in_part(spark, log):
    """A hub of 300,000 edges: a walk reads its first segment, and its context is the beginning of the whole one."""
    nodes = [("hub", ["H"], "the hub", None, None), ("bare", ["B"], "hubless", None, ""), ("x", [], None, None, "a text of x"), ("y", [], None, None, None)]
    graph = graph_of(spark, nodes, [("b1", "bare", "x", "T")])
    many = spark.range(300_000).selectExpr("concat('h', lpad(cast(id as string), 6, '0')) as edge_id", "'hub' as src", "if(id % 2 = 0, 'x', 'y') as dst", "'HAS' as type", "cast(null as double) as score")
    own = I.build(type(graph)(graph.nodes, graph.edges.unionByName(many)), log)
    rows = own.segments()
    assert rows.filter("src = 'hub'").count() >= 300 and rows.filter("src = 'hub' and start < 22").count() == 1
    got = P.multi_hop(own, "hub", 2, 20).orderBy(*P.ORDER).collect()
    assert [(r.path_length, r.start_id, r.path) for r in got] == [(1, "bare", "b1")] + [(1, "hub", f"h{i:06}") for i in range(19)]
    top = S.scored_batch(own, spark.createDataFrame([(1, "hub")], "qid long, entity string"))
    out = A.bounded_context(top, rows, own.nodes).first()
    lines = [f"{1 + i}. [H] ★ the hub" + ("\n   → HAS: [Node] a text of x" if i % 2 == 0 else "") for i in range(300_000)]
    order = sorted([("bare", 0), ("hub", 0)])
    whole = "\n".join([f"1. [B] ★ hubless\n   → T: [Node] a text of x", *[f"{2 + i}" + s[len(str(1 + i)):] for i, s in enumerate(lines)]])
    assert order[0][0] == "bare" and out.context == whole[:4500] and out.context_length == len(whole)


def test_bounded_contexts_are_cut_whole_ones(spark, log):
    graph = graph_with(spark, 8, 80, 900)
    own = I.build(graph, log)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["abc", "ab", "bc", "c a", "", "ßßß", "zz", "n"])], "qid long, entity string")
    whole = {r.needle: r.context for r in C.joined(C.lines(S.expanded(S.scored_batch(graph, asked), graph), [F.col("rank"), F.col("edge_id").asc_nulls_first()], ["needle"]), ["needle"]).collect()}
    for most in (4500, 40):
        got = {r.needle: (r.context, r.context_length) for r in A.bounded_context(S.scored_batch(own, asked), own.segments(), own.nodes, most=most).collect()}
        assert got == {q: (c[:most], len(c)) for q, c in whole.items()}
    questions = asked.selectExpr("qid", "'what?' as question", "entity")
    records = lambda g, **k: sorted(map(tuple, Q.ask(g, questions, **k).drop("context").collect()))
    assert records(own, bounded=True) == records(graph)


def test_many_places_are_tested_by_a_scan(spark, tmp_path, monkeypatch):
    """A needle that more nodes may hold than a filter names moves no texts between tasks."""
    nodes = [(f"n{i}", ["L"], None, None, f"red {i}") for i in range(20)]
    own = I.build(graph_of(spark, nodes, []), Log(spark, f"file://{tmp_path}/index"))
    monkeypatch.setattr(I, "FEW", 3)
    found = own.matches("red")
    assert sorted(r.node_id for r in found.collect()) == sorted(n for n, *_ in nodes)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_segments_go_on_over_batches():
    import pyarrow as pa

    from wayfind.operators.adjacency import cut

    src = ["a"] * 5 + ["b"] + ["c"] * 8
    b = pa.RecordBatch.from_arrays([pa.array(src), pa.array([f"e{i:02d}" for i in range(14)]), pa.array(["d"] * 14), pa.array(["t"] * 14), pa.nulls(14, pa.float64())], ["src", "edge_id", "dst", "type", "score"])
    for step in (1, 3, 14):
        got = [(r["src"], [e["edge_id"] for e in r["edges"]]) for o in cut(4)([b.slice(i, step) for i in range(0, 14, step)]) for r in o.to_pylist()]
        assert [(s, len(e)) for s, e in got] == [("a", 4), ("a", 1), ("b", 1), ("c", 4), ("c", 4)] and sum((e for _, e in got), []) == [f"e{i:02d}" for i in range(14)]
