import random

import public_tokenizers

import corpus_pipeline as P
from tests.llm import test_decontaminate as D
from tests.llm import test_near_documents as N
from tests.llm import test_quality_rules as Q
from wayfind.llm import byte_bpe


def brute(docs, items):
    docs = [(d, t) for d, t in docs if Q.brute(t)[6]]
    one = N.brute(docs)
    docs = [(d, t) for d, t in docs if d in one]
    first, out = {}, []
    for d, t in sorted(docs):
        b = t.encode()
        for i in range(len(b) - 99):
            first.setdefault(b[i : i + 100], (d, i))
    for d, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] != (d, i):
                gone[i : i + 100] = b"\x01" * 100
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if kept:
            out.append((d, kept))
    leaks = {d for d, *_ in D.brute(out, items)}
    bpe = byte_bpe.BPE(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return {d: len(bpe.encode([t])[0]) // 4 for d, t in out if d not in leaks}


def test_run_against_brute_force(spark, tmp_path):
    r = random.Random(20)
    vocabulary = [f"wört{i}" for i in range(400)] + ["the", "of", "#"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(30)) for i in range(6)]
    passages = [text(25) for _ in range(5)]
    docs = [(d, text(r.randint(20, 150))) for d in range(60)]
    for d in range(60, 140):
        base = docs[r.randrange(60)][1].split()
        what = r.randrange(5)
        if what == 0:
            base[r.randrange(len(base))] = "edited"
        elif what == 1:
            base[5:5] = r.choice(items)[1].split()
        elif what == 2:
            base = f"{text(60)} {r.choice(passages)} {text(9)}".split()
        elif what == 3:
            base = (base[:12] * 9)[:200]
        docs.append((d, " ".join(base)))
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, items)
    assert 50 < len(want) < 120
    assert {x.doc_id: x.n_tokens for x in P.run(spark, str(tmp_path)).collect()} == want
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, documents, str(tmp_path)).schema.simpleString() == documents.schema.simpleString(), name


ODD = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (None, "x y", "d"), (None, "x y", "d"), (4, "x y", "e"), (4, "x y", "e"), (5, "z " * 100_000, "f"), (6, "one two three four five six seven", "g"), (6, "other words of the same id", "h")]


def odd(spark):
    """Nulls, blanks, ties, repeated rows and ids, a very long text, and columns whose names operators use themselves."""
    df = spark.createDataFrame([(d, t, x, 1) for d, t, x in ODD], "doc_id long, text string, part string, bucket int")
    return df.selectExpr("*", "part as _id", "part as sha", "part as spans", "part as cut", "part as digest", "part as kind", "part as blob", "bucket as n", "part as component_id")


def test_every_stage_takes_odd_rows_and_columns(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd(spark)
    got = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "encoding":
            assert out.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns, name
        got[name] = sorted((r.doc_id or 0, getattr(r, "part", None) or "") for r in out.collect())
    all_ = sorted((d or 0, x) for d, _, x in ODD)
    assert got["quality"] == []
    assert got["near_dedup"] == [(0, "d"), (0, "d"), (1, "a"), (5, "f"), (6, "g"), (6, "h")]
    assert got["string_dedup"] == all_
    assert got["decontamination"] == [x for x in all_ if x != (6, "g")]
    assert [d for d, _ in got["encoding"]] == [d for d, _ in all_]


def test_run_of_an_empty_table(spark, tmp_path):
    odd(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
