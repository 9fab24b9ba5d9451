"""Bucketed tables: the same expansion, without an exchange on either side."""

import random

from tests.test_graph import graph_of
from wayfind.operators import search as S
from wayfind.sources.buckets import save_bucketed


def test_expansion_moves_neither_side(spark):
    r = random.Random(3)
    nodes = [(f"n{i}", ["L"], r.choice([None, "", f"name {i}"]), None, "t" * r.randrange(400)) for i in range(60)]
    edges = [(f"e{i}", f"n{r.randrange(70)}", f"n{r.randrange(70)}", "T") for i in range(200)]
    graph = graph_of(spark, nodes, edges)
    own = save_bucketed(graph, 4)
    columns = ["node_id", "name", "edge_id", "type", "target_id", "target_name"]
    order = lambda df: sorted((tuple(x) for x in df.select(*columns).collect()), key=str)
    for how in ("left", "inner"):
        assert order(own.expanded(how=how)) == order(S.expanded(graph.nodes, graph, how))
    some = own.nodes.filter("node_id like 'n1%'")
    assert order(own.expanded(some)) == order(S.expanded(graph.nodes.filter("node_id like 'n1%'"), graph))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = own.expanded()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("SelectedBucketsCount: 4 out of 4") == 2
    own.drop()
    assert not spark.catalog.tableExists(f"{own.name}_nodes")
