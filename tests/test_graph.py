"""The hand-made micro-graph: rankings, contexts, paths, upserts, entities, pipeline, streaming."""

import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators import context as C
from wayfind.operators import dialog as D
from wayfind.operators import ingest as I
from wayfind.operators import paths as P
from wayfind.operators import search as S
from wayfind.plans import ask as A
from wayfind.plans import models as M
from wayfind.sources import graph as G

NODES = [
    ("n1", ["Disease"], "Cirrhosis", None, "Chronic liver scarring"),
    ("n2", ["Disease"], "Biliary Cirrhosis", "cirrhosis", None),
    ("n3", ["Symptom"], "Jaundice", None, "Yellow skin, common in CIRRHOSIS"),
    ("n4", [], "", None, "post-cirrhosis follow-up"),
    ("n5", ["Drug"], "Metformin", "metformin", None),
    ("n6", ["Note"], None, None, ""),
    ("n7", ["Disease"], "Cirrhosis nodularis", None, None),
]
EDGES = [("1", "n1", "n3", "CAUSES"), ("2", "n1", "n2", "RELATED_TO"), ("3", "n2", "n1", "RELATED_TO"), ("4", "n3", "n6", "HAS_NOTE"), ("5", "n1", "n1", "RELATED_TO"), ("6", "n5", "n1", "TREATS")]


def graph_of(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "node_id string, labels array<string>, name string, canonical_name string, text string")
    rest = [F.lit(None).cast("string").alias(c) for c in G.NODE if c not in ("name", "canonical_name", "text")]
    e = spark.createDataFrame(edges, "edge_id string, src string, dst string, type string")
    return G.Graph(n.select("*", *rest), e.withColumn("score", F.lit(None).cast("double")))


@pytest.fixture(scope="module")
def graph(spark):
    return graph_of(spark, NODES, EDGES)


def order():
    return [F.desc("relevance"), F.col("node_id"), F.col("edge_id").asc_nulls_first()]


def test_ranking(graph):
    got = [(r.node_id, r.relevance) for r in S.top_scored(graph, "cirrhosis").collect()]
    assert got == [("n1", 10), ("n2", 10), ("n7", 5), ("n3", 1), ("n4", 1)]
    got = {r.node_id: r.relevance for r in S.top_scored(graph, "").collect()}
    assert got == {"n4": 10, "n1": 5, "n2": 5, "n3": 5, "n5": 5, "n7": 5, "n6": 1}


def test_scored_context(graph):
    (row,) = C.joined(C.lines(S.scored(graph, "cirrhosis"), order(), []), []).collect()
    assert row.context == (
        "1. [Disease] ★★★ Chronic liver scarring\n   → CAUSES: [Symptom] Yellow skin, common in CIRRHOSIS\n"
        "2. [Disease] ★★★ Chronic liver scarring\n   → RELATED_TO: [Disease] Biliary Cirrhosis\n"
        "3. [Disease] ★★★ Chronic liver scarring\n   → RELATED_TO: [Disease] Chronic liver scarring\n"
        "4. [Disease] ★★★ Biliary Cirrhosis\n   → RELATED_TO: [Disease] Chronic liver scarring\n"
        "5. [Disease] ★ Cirrhosis nodularis\n6. [Symptom]  Yellow skin, common in CIRRHOSIS\n7. [Node]  post-cirrhosis follow-up"
    )
    assert S.scored(graph, "cirrhosis", 1).count() == 3 and S.plain(graph, "cirrhosis", 1).count() == 1
    assert S.scored(graph, "cirrhosis", first_edge=True).count() == 5
    assert C.or_else(C.joined(C.lines(S.scored(graph, "zz"), order(), []), []), C.NOTHING.format("zz")).first().context == "No results found for 'zz'."


def test_paths(graph):
    got = [(r.path_length, r.start_id, r.path, r.end_id) for r in P.multi_hop(graph, "cirrhosis", 2, 50).collect()]
    assert got == [(1, "n1", "1", "n3"), (1, "n1", "2", "n2"), (1, "n1", "5", "n1"), (1, "n2", "3", "n1"), (1, "n3", "4", "n6")] + [
        (2, "n1", "1,4", "n6"), (2, "n1", "2,3", "n1"), (2, "n1", "5,1", "n3"), (2, "n1", "5,2", "n2"), (2, "n2", "3,1", "n3"), (2, "n2", "3,2", "n2"), (2, "n2", "3,5", "n1"),
    ]
    lines = [(r.i, r.node_line is None) for r in C.path_lines(P.multi_hop(graph, "cirrhosis", 2, 20), graph.nodes).orderBy("i").collect()]
    assert lines == [(i, i in (5, 6)) for i in range(1, 11)]
    with pytest.raises(ValueError, match="hops"):
        P.multi_hop(graph, "x", 0)


def test_walks_on_random_graphs(spark):
    r = random.Random(1)
    for _ in range(3):
        nodes = [(f"v{i}", ["L"], f"name{i}", None, None) for i in range(6)]
        edges = [(f"e{i:02d}", f"v{r.randrange(6)}", f"v{r.randrange(6)}", "T") for i in range(9)]
        g = graph_of(spark, nodes, edges)

        def walk(at, used, edges=edges):
            for e, a, b, _ in edges:
                if a == at and e not in used:
                    yield [*used, e], b
                    if len(used) < 2:
                        yield from walk(b, [*used, e])

        want = sorted((len(p), "v0", ",".join(p), b) for p, b in walk("v0", []))
        start = g.nodes.filter("node_id = 'v0'")
        rows = [(x.path_length, x.start_id, x.path, x.end_id) for x in P.walks(start, g, 3).collect()]
        assert sorted(rows) == want
        assert [(x.path_length, x.start_id, x.path, x.end_id) for x in P.walks(start, g, 3, 7).collect()] == want[:7]
        assert sorted((x.path_length, x.start_id, x.path, x.end_id) for x in P.recursive(g, "v0", 3).collect()) == want


def test_upsert_is_idempotent(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    rows = spark.createDataFrame([(1, "a", "b", 0.1), (2, "a", "b", 0.2), (3, "b", "a", 0.3), (4, "a", "zz", 0.9)], "row_no long, source string, target string, score double")
    none = spark.createDataFrame([], "src string, dst string, score double")
    once = I.upsert_edges(keys, none, rows)
    twice = I.upsert_edges(keys, once, rows)
    for df in (once, twice):
        assert sorted(tuple(r) for r in df.select("src", "dst", "score").collect()) == [("a", "b", 0.2), ("b", "a", 0.3)]
    assert [r.row_no for r in I.rejected(keys, rows).collect()] == [4]
    assert [r.node_id for r in I.isolated(keys.withColumnRenamed("key", "node_id"), once).collect()] == ["c"]


def test_entities(spark):
    rows = [("What causes jaundice in cirrhosis?", "causes", "causes"), ("Does Aspirin help?", "Aspirin", "Aspirin"), ("Which drugs treat gout?", "Which", "Which"), ("why so ill?", None, None), ("Is it ?????!", "", "!")]
    df = spark.createDataFrame([(q,) for q, *_ in rows], "q string")
    got = [tuple(r) for r in df.select("q", X.entity(F.col("q")), X.entity_plain(F.col("q"))).collect()]
    assert got == rows


def test_link_columns(spark, tmp_path):
    assert G.link_columns(["row", "source", "model", "target", "score"]) == ("source", "target", "score")
    assert G.link_columns(["target", "source", "source_2", "score"]) == ("source", "target", "score")
    assert G.link_columns(["SRC", "TGT", "SCORE"]) == ("SRC", "TGT", "SCORE")
    for bad in (["a", "b", "score"], ["src_tgt", "score"]):
        with pytest.raises(ValueError, match="column"):
            G.link_columns(bad)
    (tmp_path / "links.csv").write_text("source_id,target_id,sim_score\n007,8,0.5\n,9,0.1\n")
    assert [tuple(r)[1:] for r in G.read_links(spark, str(tmp_path / "links.csv")).collect()] == [("007", "8", 0.5)]


def test_only_select_statements(graph):
    with pytest.raises(ValueError, match="SELECT"):
        S.select(graph, "drop view nodes")
    assert S.select(graph, "select count(*) as n from edges where type = :t", {"t": "CAUSES"}).first().n == 1


class Weak:
    model = "weak"

    def __call__(self, prompt):
        return "There is not enough information." if "★" in prompt else "fine"


def test_ask_and_fallback(spark, graph):
    q = spark.createDataFrame([(1, "What is it?", "cirrhosis"), (2, "so?", None), (3, "Metformin dose", None), (4, "x", "zz")], "qid long, question string, entity string")
    got = {r.qid: r for r in A.ask(graph, q).collect()}
    assert got[1].answer == "1. [Disease] ★★★ Chronic liver scarring" and got[1].status == "ok"
    assert got[2].context == C.NO_ENTITY and got[3].answer.startswith("1. [Drug] ★★★ Metformin") and got[4].context == "No results found for 'zz'."
    assert got[1].context_length == len(got[1].context) and got[1].prompt_length > got[1].context_length
    again = {r.qid: r for r in A.ask_with_fallback(graph, q, make=Weak).collect()}
    assert again[1].answer == "fine" and again[1].context.startswith("1. [Disease] Chronic liver scarring --CAUSES--> [Symptom]")
    assert again[2].context == C.NO_ENTITY and len(again) == 4


def test_ask_one_and_chat(spark, graph):
    got = lambda **k: A.ask_one(graph, "What of Metformin?", **k).collect()
    (r,) = got(entity="zz", statement="select named_struct('embedding', array(1.0), 'k', :v, 'l', array(1)) as s, null as n, 3 as x union all select null, null, 4 order by x", args={"v": "é"})
    assert r.context == '1. {"s":{"k":"é"},"x":3}\n2. {"x":4}' and r.status == "ok"
    assert got(statement="select 1 where false")[0].context == C.NOTHING_FROM_QUERY
    assert got()[0].context.startswith("1. [Drug] ★★★ Metformin") and got(entity="zz")[0].context == C.NOTHING.format("zz")
    assert got(multihop=True)[0].context == "1. [Drug] Metformin --TREATS--> [Disease] Chronic liver scarring\n2. " + got(multihop=True)[0].context.split("\n2. ")[1]
    assert got(entity="zz", multihop=True)[0].context == C.NOTHING_ON_PATHS.format("zz")
    assert [r.context for r in A.ask_one(graph, "so?", multihop=True).collect()] == [C.NO_ENTITY]
    assert A.chat_context(graph, "jaundice").first().context == '{\n  "name": "Jaundice",\n  "text": "Yellow skin, common in CIRRHOSIS"\n}'
    assert A.chat_context(graph, "zz").first().context == C.NO_CHAT_MATCH
    turns = spark.sql("select array(named_struct('patient', 'a', 'doctor', 'b'), named_struct('patient', 'c', 'doctor', null)) as t")
    text = turns.select(C.chat_prompt(F.col("t"), F.lit("ctx")).alias("p")).first().p
    assert "Conversation:\nPatient: a\nDoctor: b\nPatient: c\n\nContext:\nctx" in text
    (r,) = A.chat(graph, "jaundice", [("a", "b")]).collect()
    assert r.question == "jaundice" and r.status == "ok" and r.prompt_length > r.context_length


class Backend:
    """A server that answers POSTs by ``reply``: a function of the body to (status, JSON)."""

    def __init__(self, reply):
        import http.server
        import json
        import threading

        outer = self
        self.seen = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                outer.seen.append(body)
                status, out = reply(body)
                raw = out if isinstance(out, bytes) else json.dumps(out).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def test_a_model_that_has_gone_is_replaced_over_http():
    said = lambda text: {"choices": [{"message": {"content": text}}]}
    gone = lambda m: {"error": {"message": f"The model {m} has been Decommissioned"}}
    with Backend(lambda b: (200, said(" yes ")) if b["model"] == "gemma2-9b-it" else (404, gone(b["model"]))) as server:
        m = M.Http("groq", server.url, "old", key="k", system="be brief")
        assert m("p") == "yes" and m("p") == "yes" and m.model == "gemma2-9b-it"
        assert [b["model"] for b in server.seen] == ["old", "llama-3.1-8b-instant", "gemma2-9b-it", "gemma2-9b-it"]
        assert server.seen[0] | {"model": ""} == {"model": "", "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "p"}], "temperature": 0.2, "max_tokens": 800, "top_p": 0.95, "stream": False}
        one = M.Http("groq", server.url, "old", settings=M.PLAIN, fallbacks=["llama-3.1-8b-instant"])
        with pytest.raises(M.ModelError, match="no model is left"):
            one("p")
        assert server.seen[-1]["max_tokens"] == 500
    with Backend(lambda b: (429, {"error": {"message": "rate limit"}})) as server:
        with pytest.raises(M.ModelError, match="rate limit") as e:
            M.Http("groq", server.url, "m")("p")
        assert e.value.status == 429 and len(server.seen) == 1
    with Backend(lambda b: (500, b"no json")) as server, pytest.raises(M.ModelError, match="no json"):
        M.Http("cohere", server.url, "m")("p")
    with pytest.raises(OSError):
        M.Http("groq", "http://127.0.0.1:1/", "m")("p")


def test_what_each_backend_is_asked_and_answers():
    ask = lambda kind, out, **more: M.Http(kind, "", "m", post=lambda b: sent.append(b) or out, **more)("p")
    sent = []
    assert ask("huggingface", [{"generated_text": " t "}]) == "t" and ask("huggingface", {"generated_text": "u\n"}) == "u" and ask("huggingface", []) == ""
    assert ask("ollama", {"response": " r "}) == "r" and ask("cohere", {"text": " c "}) == "c"
    assert sent[0] == {"inputs": "p", "parameters": {"max_new_tokens": 600, "temperature": 0.2, "top_p": 0.95, "return_full_text": False}}
    assert sent[3] == {"model": "m", "prompt": "p", "stream": False, "options": {"temperature": 0.2, "num_predict": 700}}
    assert sent[4] == {"model": "m", "message": "p", "temperature": 0.4}
    assert M.TIMEOUTS["ollama"] == 60
    with pytest.raises(ValueError, match="unknown backend"):
        M.Http("other", "")

    def old(body):
        if body["model"] != "new":
            raise OSError("no")
        return {"text": "ok"}

    m = M.Http("cohere", "", "old", post=old)
    assert m.probe(("older", "new")) and m.model == "new" and not M.Http("cohere", "", "x", post=old).probe()


def test_stored_graphs_and_encoded_texts(spark, graph, tmp_path):
    from wayfind.plans import embed as B
    from wayfind.sources import log as L
    from wayfind.sources import store as T

    log = L.Log(spark, f"file://{tmp_path}/g")
    T.save_graph(graph, log)
    own = T.open_graph(log)
    assert sorted(r.node_id for r in own.nodes.collect()) == sorted(n[0] for n in NODES) and own.edges.count() == len(EDGES)
    assert [r.node_id for r in S.scored(own, "cirrhosis").select("node_id").distinct().orderBy("node_id").collect()] == ["n1", "n2", "n3", "n4", "n7"]
    change = log.begin()
    change.delete("edges", graph.edges.filter("type <> 'TREATS'"))
    change.commit()
    assert T.open_graph(log).edges.count() == 1 and T.open_graph(log, 1).edges.count() == len(EDGES) and log.versions() == [1, 2]
    twice = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "canonical_id string")
    with pytest.raises(ValueError, match="canonical_id a occurs 2 times"):
        T.unique(twice, "canonical_id")

    nodes = spark.createDataFrame([("1", "x", "red bolt", None), ("2", "x", None, None), ("3", "y", "", [1.0]), ("4", None, "blue", None)], "node_id string, original_id string, text string, embedding array<float>")
    got = {r.node_id: r.embedding for r in B.embed_nodes(nodes, lambda: B.Hashed(16)).collect()}
    assert got["1"] == got["2"] and len(got["1"]) == 16 and got["3"] == [1.0] and got["4"] is None
    run = B.encoded(nodes, lambda: B.Hashed(4), batch=2)
    assert run.schema["embedding"].dataType.simpleString() == "array<float>"
    assert [len(r.embedding or ()) for r in run.orderBy("node_id").collect()] == [4, 0, 4, 4]


def test_edges_are_made_again_when_a_table_changes(spark, tmp_path):
    """Also with the same name, rows of the same length, or a folder instead of a file."""
    import shutil

    from wayfind.sources import store as T

    for name in G.TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    count = lambda: {r.type: r["count"] for r in T.stored(spark, str(tmp_path)).edges.groupBy("type").count().collect()}
    before = count()
    assert count() == before and T.stored(spark, str(tmp_path)).edges.inputFiles() == T.stored(spark, str(tmp_path)).edges.inputFiles()
    shutil.copy("/root/testdata/sf0.01/customer.parquet", tmp_path)
    assert count()["IN_NATION"] == before["IN_NATION"] + 1350 and T.stored(spark, str(tmp_path)).nodes.filter("node_id like 'customer:%'").count() == 1500
    (tmp_path / "customer.parquet").unlink()
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    assert count() == before


def test_limits_are_whole_numbers(graph):
    for call in (lambda: S.scored(graph, "x", -1), lambda: S.chat(graph, "x", "5; drop"), lambda: P.multi_hop(graph, "x", 0), lambda: P.multi_hop(graph, "x", 2, 1.5)):
        with pytest.raises(ValueError, match="must be a whole number"):
            call()


def test_dialog(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "It appears so"), (1, 2, "user", " BYE \n"), (1, 3, "assistant", "diagnosis: x"), (2, 0, "user", "exit now")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert [(r.suggested, r.notice) for r in D.latch(df).orderBy("conv_id", "turn").collect()] == [(False, False), (True, True), (True, False), (True, False), (False, False)]
    assert sorted((r.conv_id, r.turn) for r in D.until_exit(df).collect()) == [(1, 0), (1, 1), (2, 0)]
    assert {r.conv_id: r.transcript for r in D.transcript(df).collect()}[1] == "Patient: hi\nDoctor: It appears so\nPatient:  BYE \n\nDoctor: diagnosis: x"


def test_stream_latch(spark, tmp_path):
    from wayfind.streaming.chat import notices

    schema = "conv_id long, turn long, role string, text string"
    for k, rows in enumerate([[(1, 0, "assistant", "hello"), (2, 0, "assistant", "Diagnosis: a")], [(1, 1, "assistant", "you may have b"), (2, 1, "assistant", "likely cause c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = notices(stream).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(out) == [(1, 0, False), (1, 1, True), (2, 0, True), (2, 1, False)]


def test_batches_agree_with_single_searches(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: rng.choice([None, "", "Ab", "abc", "bC cab", "ÄB c", "c" * 50, "xAbcx"])
    nodes = [(f"n{i:02}", ["L"], word(), word(), word()) for i in range(40)]
    edges = [(f"e{i:02}", f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}", "T") for i in range(60)]
    g = graph_of(spark, nodes, edges)
    needles = ["ab", "AB", "", "äb", "c", "none", "abc"]
    q = spark.createDataFrame([(i, n) for i, n in enumerate([*needles, None, "c"])], "qid long, entity string")
    for most in (50_000, 2):
        monkeypatch.setattr(S, "BLOCK_NEEDLES", most)
        top, paths = {}, {}
        for r in S.scored_batch(g, q, 3).orderBy("needle", "rank").collect():
            top.setdefault(r.needle, []).append((r.node_id, r.relevance, r.text))
        for r in P.multi_hop_batch(g, q, 2, 9).orderBy("needle", *P.ORDER).collect():
            paths.setdefault(r.needle, []).append((r.path_length, r.start_id, r.path, r.end_id))
        for n in needles:
            assert top.get(n, []) == [(r.node_id, r.relevance, r.text) for r in S.top_scored(g, n, 3).collect()]
            if most == 2:
                assert paths.get(n, []) == [(r.path_length, r.start_id, r.path, r.end_id) for r in P.multi_hop(g, n, 2, 9).collect()]
    none = q.filter("entity is null")
    assert not S.scored_batch(g, none).count() and not P.multi_hop_batch(g, none).count() and not S.scored_batch(graph_of(spark, [], []), q).count()


def test_models_travel_by_value(tmp_path):
    code = "import sys; from pyspark import cloudpickle; print(cloudpickle.loads(sys.stdin.buffer.read())('Context:\\na\\n\\nQuestion: b'))"
    out = subprocess.run([sys.executable, "-I", "-c", code], input=cloudpickle.dumps(M.Extract()), capture_output=True, cwd=tmp_path, check=True)
    assert out.stdout.strip() == b"a"
