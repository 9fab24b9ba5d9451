"""Table functions over an indexed graph, in plain SQL."""

from tests.test_graph import EDGES, NODES, graph_of
from wayfind.operators import paths as P
from wayfind.operators import search as S
from wayfind.plans import statements as Z
from wayfind.sources import indexed as I
from wayfind.sources.log import Log


def test_lateral_functions(spark, tmp_path):
    graph = graph_of(spark, NODES, EDGES)
    own = I.build(graph, Log(spark, f"file://{tmp_path}/index"))
    Z.register(own)
    spark.createDataFrame([(1, "CIRRHOSIS"), (2, "met"), (3, "zz"), (4, "zzz"), (5, None)], "qid int, needle string").createOrReplaceTempView("asked")
    rows = spark.sql(Z.SEARCH.format(asked="asked", limit=3))
    got = sorted((r.qid, r.rank, r.node_id, r.relevance) for r in rows.collect())
    want = [(q, i + 1, r.node_id, r.relevance) for q, n in ((1, "cirrhosis"), (2, "met")) for i, r in enumerate(S.top_scored(graph, n, 3).collect())]
    assert got == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, Contains" not in plan and "Cartesian" not in rows._jdf.queryExecution().executedPlan().toString()
    walks = spark.sql("select a.node_id, w.* from (values ('n1'), ('n6'), (null)) a(node_id), lateral node_walks(a.node_id) w").collect()
    starts = graph.nodes.filter("node_id in ('n1', 'n6')")
    assert sorted((r.node_id, r.path_length, r.path, r.end_id) for r in walks) == sorted((r.start_id, r.path_length, r.path, r.end_id) for r in P.walks(starts, graph, 2).collect())
    assert spark.sql("select count(*) as n from lateral node_edges('n1')").first().n == 3


def test_only_places_of_all_trigrams_fetch_a_node(spark, tmp_path):
    """A needle's first trigram is in every text: the nodes' texts meet the places that have all of its trigrams, no others."""
    nodes = [(f"n{i:03d}", ["L"], None, None, f"red {'bolt' if i % 50 == 0 else 'x'} {i}") for i in range(200)]
    own = I.build(graph_of(spark, nodes, []), Log(spark, f"file://{tmp_path}/index"))
    Z.register(own)
    spark.createDataFrame([(1, "Red Bolt"), (2, "red bolt 1"), (3, "red bolt 150")], "qid int, needle string").createOrReplaceTempView("asked")
    rows = spark.sql(Z.SEARCH.format(asked="asked", limit=10))
    assert sorted((r.qid, r.node_id) for r in rows.collect()) == [(1, "n000"), (1, "n050"), (1, "n100"), (1, "n150"), (2, "n100"), (2, "n150"), (3, "n150")]
    places = Z.SEARCH.split("found_ as")[0].rstrip().rstrip(",")
    assert spark.sql(f"{places} select * from places_".format(asked="asked")).count() == 7
