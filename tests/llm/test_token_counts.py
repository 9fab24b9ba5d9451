import duckdb
import pytest

from wayfind.llm import token_counts as T


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(*T.KEYS, *T.SUMS).collect())


def test_query_against_sql(spark, tmp_path):
    texts = ["a b  c", "", None, "x\nx\ny z\nx", "É1, ab_c!", " \n ", "one\n\n\ntwo"] * 3
    docs = spark.createDataFrame([(i, t, ["en", None][i % 2], ["s0", "s0", "s1"][i % 3], i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, kind long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(f"select {', '.join(T.KEYS + T.SUMS)} from ({T.OP2_SQL})").fetchall()
    assert rows(T.op2_token_counts(spark, str(tmp_path))) == sorted(tuple(str(x) for x in r) for r in want)


def test_commits_are_idempotent_and_compaction_keeps_totals(spark):
    r = T.Rollup(spark, T.shared(spark, "rollup"))
    assert r.totals().count() == 0
    docs = spark.createDataFrame([("s", "en", 5), ("s", "en", 7), (None, "en", 1)], "source string, lang string, n long")
    assert r.commit("a", T.events(docs, "insert", "v", after=T.F.col("n")))
    assert not r.commit("a", T.events(docs, "insert", "v", after=T.F.col("n")))
    assert r.commit("b", T.events(docs.filter("n = 5"), "revise", "v", before=T.F.col("n"), after=T.F.lit(9).cast("long")))
    assert r.commit("c", T.events(docs.filter("n = 1"), "delete", "v", before=T.F.col("n")))
    assert r.commit("empty", T.events(docs.limit(0), "insert", "v"))
    want = [("None", "en", "v", "0", "0", "1", "1", "0"), ("s", "en", "v", "2", "16", "2", "0", "1")]
    assert rows(r.totals()) == want
    assert r.compact() and rows(r.totals()) == want
    assert not r.commit("b", T.events(docs, "insert", "v"))
    assert r.commit("d", T.events(docs.filter("n = 7"), "delete", "v", before=T.F.col("n")))
    assert r.compact() and rows(r.totals())[1] == ("s", "en", "v", "1", "9", "2", "1", "1")
    with pytest.raises(Exception, match="unknown kind"):
        r.commit("e", T.events(docs, "upsert", "v"))
    assert r.names()[0] == ["batch=d"]  # the others went with the second compaction


def test_a_batch_that_is_committed_during_compaction_counts_once(spark):
    r = T.Rollup(spark, T.shared(spark, "rollup"))
    docs = spark.createDataFrame([("s", "en", 5)], "source string, lang string, n long")
    add = lambda name: r.commit(name, T.events(docs, "insert", "v", after=T.F.col("n")))
    assert add("a")
    listing = r.names()
    assert add("b")
    assert r.compact(listing) and rows(r.totals()) == [("s", "en", "v", "2", "10", "2", "0", "0")]
    assert not add("b") and not add("a")
    # Another compaction of the same listing finds the snapshot's name taken.
    assert not r.compact(listing)
    assert r.compact() and rows(r.totals()) == [("s", "en", "v", "2", "10", "2", "0", "0")]


def test_a_replay_that_ends_after_its_batch_was_folded_counts_once(spark):
    r = T.Rollup(spark, T.shared(spark, "rollup"))
    docs = spark.createDataFrame([(f"s{i}", "en", 5) for i in range(50)], "source string, lang string, n long")
    add = lambda name: r.commit(name, T.events(docs, "insert", "v", after=T.F.col("n")))
    assert add("a") and add("b")
    rows_of = r.sums(["a"], None)
    assert r.compact() and add("c") and r.compact() and r.names()[0] == ["batch=c"]
    want = rows(r.totals())
    assert r.put("batch=a", ("sums", spark.createDataFrame([("s0", "en", "v", 1, 5, 1, 0, 0)], rows_of.schema)))
    assert rows(r.totals()) == want and len(want) == 50 and want[0][3:5] == ("3", "15")
    assert r.compact() and rows(r.totals()) == want


def test_a_commit_of_many_keys_is_not_one_task(spark):
    r = T.Rollup(spark, T.shared(spark, "rollup"))
    delta = spark.range(1000).select(T.F.concat(T.F.lit("s"), "id").alias("source"), T.F.lit("en").alias("lang"), T.F.lit(1).cast("long").alias("n"))
    assert "Coalesce" not in r.sums([], None)._jdf.queryExecution().toString()
    assert r.commit("a", T.events(delta, "insert", "v", after=T.F.col("n"))) and r.totals().count() == 1000


def test_very_long_texts_and_extra_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "w " * 400_000, "en", "s", "insert"), (1, "w " * 400_000, "en", "s", "x")], "doc_id long, text string, lang string, source string, kind string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(T.op2_token_counts(spark, str(tmp_path)))
    assert got == [("s", "en", v, "2", "800000", "2", "0", "0") for v in ("alnum-1", "words-1")]


def test_changes_between_states(spark):
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    old = spark.createDataFrame([(1, "s", "en", "v", 5), (2, "s", "en", "v", 6), (3, "s", "en", "v", 7)], schema)
    new = spark.createDataFrame([(1, "s", "en", "v", 5), (2, "s", "en", "v", 9), (4, "t", "en", "v", 1)], schema)
    got = sorted((r.kind, r.source, r.before, r.after) for r in T.changes(old, new).collect())
    assert got == [("delete", "s", 7, 0), ("insert", "t", 0, 1), ("revise", "s", 6, 9)]
