"""Properties as VARIANT, and JSON over lines."""

import json

from pyspark.sql import functions as F

from wayfind.operators import context as C
from wayfind.plans import ask as A
from wayfind.sources import properties as V


def nodes(spark, *raw):
    rows = [(f"n{i}", "L" if i % 2 == 0 else "M", r) for i, r in enumerate(raw)]
    return spark.createDataFrame(rows, "node_id string, label string, raw string").select("node_id", "label", F.expr("parse_json(raw) as props"))


RAW = ['{"a":1,"b":"Éx \\"q\\"","embedding":[1.5],"o":{"k":1},"n":null}', '{"a":"one","b":true,"c":2.5}', "{}", None, '{"embedding":"text","a":3.25e40,"kéy \\"":"v"}', "[1,2]"]


def test_plain_properties_of_any_kind(spark):
    df = nodes(spark, *RAW)
    got = sorted((r.node_id, r.key, r.kind) for r in V.properties(df).collect())
    assert got == [("n0", "a", "BIGINT"), ("n0", "b", "STRING"), ("n1", "a", "STRING"), ("n1", "b", "BOOLEAN"), ("n1", "c", "DECIMAL"), ("n4", "a", "DOUBLE"), ("n4", 'kéy "', "STRING")]
    every = {(r.node_id, r.key) for r in V.properties(df, plain=False).collect()}
    assert {("n0", "embedding"), ("n0", "o"), ("n4", "embedding")} <= every and ("n0", "n") not in every
    out = {r.node_id: json.loads(r.json) for r in V.plain_json(df).collect()}
    assert out == {"n0": {"a": 1, "b": 'Éx "q"'}, "n1": {"a": "one", "b": True, "c": 2.5}, "n4": {"a": 3.25e40, 'kéy "': "v"}}
    assert sorted((r.node_id, r.key) for r in V.holding(df, "ÉX").collect()) == [("n0", "b")]
    assert sorted((r.node_id, r.key) for r in V.holding(df, "e").collect()) == [("n1", "a"), ("n1", "b"), ("n4", "a")]
    assert {r.node_id: r.x for r in df.select("node_id", V.typed("a", "int").alias("x")).collect()} == {"n0": 1, "n1": None, "n2": None, "n3": None, "n4": None, "n5": None}
    assert V.properties(df.limit(0)).count() == 0


def test_columns_become_properties_without_nulls(spark):
    df = spark.sql("select * from values (1, 'x', cast(null as double), array(1.0f), date'2020-01-01'), (2, null, 2.5D, null, null) t(id, s, d, embedding, day)")
    got = sorted((r.id, r.key, r.kind) for r in V.properties(V.with_props(df, "s", "d", "embedding", "day")).collect())
    assert got == [(1, "s", "STRING"), (2, "d", "DOUBLE")]


def test_json_over_lines(spark):
    rows = spark.sql("""select 'é"' as s, 2 as n, true as b, cast(null as int) as gone, 1.5D as d, named_struct('k', 'v', 'x', cast(null as int), 'l', array(1), 'embedding', array(1.0)) as o,
      named_struct('l', array(1)) as nothing_plain, map('p', 1, 'embedding', 2, 'q"', 3) as m, array(1, null, 3) as l, array(named_struct('z', 1), named_struct('z', cast(null as int))) as ll, cast(array() as array<int>) as e""")
    want = {"s": 'é"', "n": 2, "b": True, "d": 1.5, "o": {"k": "v"}, "m": {"p": 1, 'q"': 3}, "l": [1, None, 3], "ll": [{"z": 1}, {}], "e": []}
    (row,) = C.records(rows, spread=True).collect()
    assert row.node_line == "1. " + json.dumps(want, indent=2, ensure_ascii=False)
    assert json.loads(C.records(rows).first().node_line[3:]) == want


def test_statements_and_plain_questions(spark):
    from tests.test_graph import EDGES, NODES, graph_of

    graph = graph_of(spark, NODES, EDGES)
    q = spark.createDataFrame([(1, "What of cirrhosis, then?", None), (2, "so?", None), (3, "x", "zz"), (4, "y", "jaundice")], "qid long, question string, entity string")
    got = {r.qid: r for r in A.ask_plain(graph, q).collect()}
    assert got[2].context == C.NO_ENTITY_PLAIN and got[3].context == C.NOTHING.format("zz")
    assert got[4].context == "1. Symptom: Yellow skin, common in CIRRHOSIS" and got[1].context.count("\n   → ") == 4 and got[1].context.startswith("1. Disease: Chronic liver scarring\n   → CAUSES: Symptom - Yellow")
    out = A.ask_statement(graph, q, "select name from nodes where array_contains(labels, :l) order by name", {"l": "Drug"}).collect()
    assert {r.qid for r in out} == {1, 2, 3, 4} and out[0].context == '1. {\n  "name": "Metformin"\n}'
    assert A.ask_statement(graph, q, "select 1 as a where false", plain=True).first().context == C.NOTHING_FROM_QUERY
