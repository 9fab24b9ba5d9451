"""Nearest vectors: the exact mode against NumPy, the index against the exact mode."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfind.operators import vectors as V


def frame(spark, m, ids=None):
    rows = [(int(i), [float(x) for x in v] if v is not None else None) for i, v in zip(ids or range(len(m)), m, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def test_exact_neighbours(spark, monkeypatch):
    r = np.random.default_rng(1)
    m = r.normal(size=(120, 8)).astype(np.float32)
    m[7] = m[3] * 2  # as near as can be
    m[9] = 0  # near to nothing
    df = frame(spark, [*m, None], [*range(120), 500])
    want = {}
    for i in range(0, 120, 10):
        q = m[i].astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = np.round(m.astype(np.float64) @ q / (np.linalg.norm(m.astype(np.float64), axis=1) * np.linalg.norm(q)), 6)
        order = sorted((j for j in range(120) if j != i and not np.isnan(cos[j])), key=lambda j: (-cos[j], j))[:5]
        want |= {(i, k + 1): (j, cos[j]) for k, j in enumerate(order)}
    for size in (16 << 20, 200):
        monkeypatch.setattr(V, "BLOCK_BYTES", size)
        got = {(x.query, x.rank): (x.vec_id, x.score) for x in V.exact(df, df.filter("vec_id % 10 = 0"), 5).collect()}
        assert {k: v for k, (v, _) in got.items()} == {k: v for k, (v, _) in want.items()} and all(abs(s - want[k][1]) < 2e-6 for k, (_, s) in got.items())


def test_the_index_finds_nine_of_ten(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 32))
    m = centres[r.integers(0, 30, 3000)] + 0.7 * r.normal(size=(3000, 32))
    df = frame(spark, m).persist()
    monkeypatch.setattr(V, "PACK", 50)
    monkeypatch.setattr(V, "QUERIES", 7)
    book = V.fit(df, cells=24, pieces=16, sample=1500)
    codes = V.index(df, book).persist()
    assert sum(len(x.ids) // 8 for x in codes.collect()) == 3000 and max(len(x.ids) // 8 for x in codes.collect()) <= 50
    queries = df.filter("vec_id % 50 = 0")
    true = V.exact(df, queries, 10)
    found = V.search(codes, df, queries, book, 10, probes=8, rerank=80)
    assert found.groupBy("query").count().filter("count = 10").count() == 60
    assert V.recall(found, true).first().recall >= 0.9
    # With all cells and all candidates the index gives what the exact mode gives.
    every = V.search(codes, df, queries, book, 10, probes=24, rerank=3000)
    order = lambda x: sorted((a.query, a.rank, a.vec_id, a.score) for a in x.collect())
    assert [x[:3] for x in order(every)] == [x[:3] for x in order(true)] and max(abs(a[3] - b[3]) for a, b in zip(order(every), order(true), strict=True)) < 2e-6
    with pytest.raises(ValueError, match="no vectors"):
        V.fit(df.limit(0))
    assert V.exact(df, df.limit(0)).count() == 0


def test_a_task_compares_a_bounded_number_of_pairs(monkeypatch):
    """What a task gives at a time is bounded, whatever the number of queries and the size of a batch."""
    from types import SimpleNamespace

    import pyarrow as pa

    from wayfind.operators import similarity as S

    m = np.random.default_rng(4).normal(size=(300, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(list(m), pa.list_(pa.float64()))], ["vec_id", "embedding"])
    block = SimpleNamespace(value=[(int(i), m[i]) for i in range(40)])
    whole = [tuple(x) for b in S.compared(block, -1.0)([batch]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    for most in (500, 100):
        monkeypatch.setattr(S, "CELLS", most)
        parts = list(S.compared(block, -1.0)([batch]))
        got = [tuple(x) for b in parts for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert max(b.num_rows for b in parts) <= most and sorted(got) == sorted(whole) and len(got) == 40 * 299


@pytest.mark.parametrize("cells", [1, 64, 700])
def test_neighbours_do_not_depend_on_the_pairs_at_a_time(spark, monkeypatch, cells):
    m = np.random.default_rng(5).normal(size=(200, 8))
    df = frame(spark, m).persist()
    book, queries = V.fit(df, cells=4, pieces=4), df.filter("vec_id % 10 = 0")
    codes = V.index(df, book)
    order = lambda x: sorted((a.query, a.rank, a.vec_id) for a in x.collect())
    want, found = order(V.exact(df, queries)), order(V.search(codes, df, queries, book, probes=2, rerank=20))
    monkeypatch.setattr(V, "CELLS", cells)
    assert order(V.exact(df, queries)) == want and order(V.search(codes, df, queries, book, probes=2, rerank=20)) == found


@pytest.mark.parametrize("block, blocks, side", [(32_768, 16, 512), (7, 1, 3), (1000, 1, 512)])
def test_links_of_all_vectors_are_counted(spark, monkeypatch, block, blocks, side):
    """Each with each, copies too, whatever the blocks; the sums are those of the links one by one."""
    from wayfind.operators import similarity as S

    r = np.random.default_rng(6)
    m = list(r.normal(size=(90, 8)).astype(np.float32))
    m[3], m[50], m[11], m[12] = m[2] * 2, m[2], np.zeros(8), None  # copies; no direction; no vector
    ids = [*range(88), 5, 5]  # an id of several rows has no link to itself
    df = frame(spark, m, ids)
    for k, v in (("BLOCK", block), ("BLOCKS", blocks), ("SIDE", side)):
        monkeypatch.setattr(S, k, v)
    want = {x.a: x.n for x in S.links(df, df, 0.3).groupBy("a").agg(F.count("*").alias("n")).collect()}
    got = {x.vec_id: x.links for x in S.link_counts(df, 0.3).collect()}
    assert got == want and len(got) > 80 and 11 not in got and 12 not in got
    assert S.link_counts(df.limit(0), 0.3).count() == 0


def test_the_report_counts_links_of_all_vectors(spark, tmp_path):
    """Also of those whose ids are not divisible by 100, which the query once did not compare with one another."""
    import os

    import duckdb

    from wayfind import catalogue
    from wayfind.sources.graph import TABLES

    for name in TABLES:
        if name != "embeddings":
            os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    vectors = {1: [1, 0], 2: [1, 0.1], 3: [-1, 0], 100: [0, -1], 205: [0.9, 0]}
    rows = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {x.metric: x.value for x in catalogue.QUERIES["integrity_report"](spark, str(tmp_path)).collect()}
    assert got == {"canonical_nodes": 5, "similarity_links": 6, "canonical_without_similarity": 2}
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == dict(duck.execute(catalogue.ORACLE["integrity_report"]).fetchall())


def test_counts_give_the_report_of_the_links(spark):
    from wayfind.operators import ingest as I
    from wayfind.operators import similarity as S
    from wayfind.sources.graph import Graph

    df = frame(spark, np.random.default_rng(7).normal(size=(12, 6)))
    nodes = df.select(F.col("vec_id").cast("string").alias("node_id"), F.array(F.lit("EntityCanonical")).alias("labels")).unionByName(spark.createDataFrame([("x", ["Part"])], "node_id string, labels array<string>"))
    edges = S.links(df, df, 0.7).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.lit("SIMILAR_TO").alias("type"))
    want = {x.metric: x.value for x in I.integrity(Graph(nodes, edges)).collect()}
    counts = S.link_counts(df, 0.7).select(F.col("vec_id").cast("string").alias("node_id"), "links")
    assert {x.metric: x.value for x in I.integrity_of_counts(nodes, counts).collect()} == want
    assert want["canonical_nodes"] == 12 and want["similarity_links"] > 0 and 0 < want["canonical_without_similarity"] < 12
