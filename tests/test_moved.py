"""What searches move between tasks: ids, and no texts of nodes that they don't show."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tests.test_graph import graph_of
from wayfind.operators import context as C
from wayfind.operators import paths as P
from wayfind.operators import search as S
from wayfind.plans import ask as Q
from wayfind.plans import models as M
from wayfind.plans.routed import Route
from wayfind.sources.graph import Graph
from wayfind.sources.store import new_log

N, TEXT = 2000, 2000  # nodes, and characters of the text of each
MOST = 200_000  # bytes that may be moved; all texts are twenty times as many


def moved(spark, run):
    """The rows that ``run`` gives, and the bytes that its stages wrote to shuffles."""
    sc = spark.sparkContext
    group = f"moved-{random.random()}"
    sc.setJobGroup(group, "moved")
    rows = sorted(map(tuple, run().collect()), key=str)
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {k for j in sc.statusTracker().getJobIdsForGroup(group) for k in sc.statusTracker().getJobInfo(j).stageIds}
    total = 0
    for k in stages:
        try:
            total += sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteBytes()
        except Exception:  # a stage whose output was there
            continue
    return rows, total


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A graph in files, with texts that don't compress well and edges from every third node; needles are in the names."""
    r, here = random.Random(5), str(tmp_path_factory.mktemp("wide"))
    text = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(TEXT))
    nodes = [(f"n{i}", ["L"], f"{'apple' if i % 50 == 0 else 'pear'} {i}", None, text()) for i in range(N)]
    edges = [(f"e{i}", f"n{i}", f"n{(i * 7 + 1) % N}", "T") for i in range(0, N, 3)]
    graph = graph_of(spark, nodes, edges)
    graph.nodes.write.parquet(f"{here}/nodes")
    graph.edges.write.parquet(f"{here}/edges")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    yield Graph(spark.read.parquet(f"{here}/nodes"), spark.read.parquet(f"{here}/edges"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def asked(spark):
    return spark.createDataFrame([(1, "a?", "apple"), (2, "b?", "PEAR 7"), (3, "c?", "no such thing")], "qid int, question string, entity string")


def test_answers_with_fallback_move_no_texts(spark, wide):
    rows, total = moved(spark, lambda: Q.ask_with_fallback(wide, asked(spark), make=M.Doubting, when_empty=True).select("qid", "context"))
    assert [r[0] for r in rows] == [1, 2, 3] and rows[2][1] == "No multi-hop results found for 'no such thing'."
    assert total < MOST


def test_nodes_that_no_edge_leaves_take_no_place_among_starts(spark, wide):
    """The limit comes behind the edges: 20 of the 40 nodes found have none."""
    found = S.hits_of(wide.nodes, S.needles_of(asked(spark)), 5, ranked=False, among=P.sources(wide)).select("q", "node_id", "rank")
    got = [r[1] for r in sorted(map(tuple, found.filter("q = 'apple'").collect()), key=lambda r: r[2])]
    assert got == sorted(f"n{i}" for i in range(0, N, 150))[:5]


def test_a_task_without_a_limit_gives_all_hits(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(S, "HELD", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([f"n{n:02d}" for n in range(40)]), pa.array(["a b"] * 40), pa.nulls(40, pa.string()), pa.nulls(40, pa.string())], ["node_id", "text", "name", "canonical_name"])
    out = [(r["q"], r["node_id"]) for b in S.searched(SimpleNamespace(value=["a", "b"]), None, False)([batch]) for r in b.to_pylist()]
    assert sorted(out) == [(q, f"n{n:02d}") for q in "ab" for n in range(40)]


def test_one_question_with_paths_moves_no_texts(spark, wide):
    rows, total = moved(spark, lambda: Q.ask_one(wide, "What?", "apple", multihop=True).select("context"))
    assert rows[0][0].count("--T-->") == 10 and total < MOST


def test_each_kind_of_one_question_moves_no_texts(spark, wide):
    def run():
        kinds = [Q.ask_one(wide, "What?", "apple"), Q.ask_one(wide, "What?", "apple", multihop=True), Q.ask_one(wide, "How many?", None, "select count(*) as n from nodes"), Q.ask_one(wide, "so?")]
        return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(k).alias("k"), "context") for k, df in enumerate(kinds)])

    rows, total = moved(spark, run)
    assert rows[0][1].startswith("1. [L] ★ ") and rows[1][1].count("--T-->") == 10 and str(N) in rows[2][1] and rows[3][1] == C.NO_ENTITY
    assert total < MOST


def test_walks_move_ids_of_starts_and_no_edges(spark, wide):
    """The first start fills the limit, and no edge is moved to see that."""
    many = Graph(wide.nodes, wide.edges.selectExpr("explode(sequence(1, 40)) as k", "*").selectExpr("concat(edge_id, '-', k) as edge_id", "src", "dst", "type", "score"))
    want = {(r.src, r.edge_id) for r in many.edges.join(wide.nodes.filter("name like 'apple%'").selectExpr("node_id as src"), "src").orderBy("src", "edge_id").limit(5).collect()}
    rows, total = moved(spark, lambda: P.multi_hop(many, "apple", 2, 5).select("start_id", "path"))
    assert set(rows) == want and total < MOST


def test_edges_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Not by the session's number of partitions, which grows with nothing; the edges stay the same."""
    from wayfind.sources import graph as G
    from wayfind.sources import store as T

    for name in G.TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    monkeypatch.setattr(G, "ROWS_A_TASK", 500)
    edges = T.stored(spark, str(tmp_path)).edges
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum("SUPPLIED_BY" in f for f in edges.inputFiles()) > n
    want = G.load(spark, str(tmp_path)).edges
    assert edges.count() == want.count() and edges.exceptAll(want).isEmpty()


def test_routed_contexts_move_no_texts(spark, wide):
    rows, total = moved(spark, lambda: Q.contexts(wide, asked(spark)).select("qid", "context"))
    assert rows[0][1].startswith("1. [L] ★ ") and rows[2][1] == "No results found for 'no such thing'."
    assert total < MOST


def test_routed_answers_move_no_texts(spark, wide):
    """Neither when models are asked, nor when all answers are kept."""
    questions, log = asked(spark).selectExpr("*", "'a' as backend", "cast(null as string) as model"), new_log(spark, "answers")

    def run():
        Q.ask_routed(wide, questions, {"a": Route(lambda _: M.Extract(), 2)}, log)
        return Q.ask_routed(wide, questions, {"a": Route(None, 2)}, log).select("qid", "answer", "status")

    rows, total = moved(spark, run)
    assert [(r[0], r[2]) for r in rows] == [(1, "ok"), (2, "ok"), (3, "ok")] and rows[0][1].startswith("1. [L] ★ ")
    assert total < MOST


def test_answers_to_many_questions_move_no_texts(spark, wide):
    rows, total = moved(spark, lambda: Q.ask(wide, asked(spark)).select("qid", "answer", "context"))
    assert [r[0] for r in rows] == [1, 2, 3] and rows[0][1].startswith("1. [L] ★ ") and rows[2][2] == "No results found for 'no such thing'."
    assert total < MOST


def test_a_scored_context_moves_no_texts(spark, wide):
    """The whole context, with texts of nodes and targets in its lines."""
    order = [F.desc("relevance"), F.col("node_id"), F.col("edge_id").asc_nulls_first()]
    rows, total = moved(spark, lambda: C.or_else(C.joined(C.lines(S.scored(wide, "apple"), order, []), []), "nothing"))
    assert len(rows) == 1 and rows[0][0].count("[L] ★ ") == 15 and "   → T: [L] " in rows[0][0] and total < MOST


def test_a_scored_search_and_its_lines_move_no_texts(spark, wide):
    order = ["relevance", "node_id", "edge_id"]
    rows, total = moved(spark, lambda: C.lines(S.scored(wide, "apple"), order, []).select("i", "node_line", "edge_line"))
    assert len(rows) == 15 and total < MOST
