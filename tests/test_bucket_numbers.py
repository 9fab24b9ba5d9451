"""The number of buckets follows the rows, and what is read from them stays the same."""

from tests.test_graph import graph_of
from wayfind.operators import search as S
from wayfind.sources import buckets as B


def test_large_graphs_have_more_buckets(spark, monkeypatch):
    nodes = [(f"n{i}", ["L"], f"name {i}", None, "t" * 100) for i in range(40)]
    edges = [(f"e{i}", f"n{i % 45}", f"n{i * 7 % 45}", "T") for i in range(200)]
    graph = graph_of(spark, nodes, edges)
    order = lambda df: sorted((tuple(x) for x in df.select("node_id", "edge_id", "target_id", "target_name").collect()), key=str)
    want = order(S.expanded(graph.nodes, graph))
    for name, most, n in (("ROWS_A_TASK", 20, 10), ("BUCKET_BYTES", 1000, 5)):
        with monkeypatch.context() as m:
            m.setattr(B, name, most)
            own = B.save_bucketed(graph, 4)
        described = {r.col_name: r.data_type for r in spark.sql(f"describe extended {own.name}_nodes").collect()}
        assert int(described["Num Buckets"]) == n and order(own.expanded()) == want
        own.drop()
    assert B.buckets_for(graph, 4) == 4
