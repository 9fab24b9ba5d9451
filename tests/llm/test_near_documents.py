import random

import corpus_pipeline
from tests.llm.test_paragraph_dedup import shingled


def brute(rows):
    """Ids that stay of documents with distinct ids, by all pairs."""
    sets = {d: shingled(t or "")[1] for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def test_stage_finds_all_near_copies_and_no_others(spark):
    r = random.Random(12)
    text = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    rows = [(0, ""), (1, None), (2, "one two"), (3, "One\ntwo")]
    for d in range(10, 50):
        words = text(r.randint(30, 300))
        rows.append((d, " ".join(words)))
        for k in range(3):
            own = list(words)
            for _ in range(r.randint(0, 1 + len(own) // 40)):
                own[r.randrange(len(own))] = f"new{r.randint(0, 9)}"
            rows.append((d + 100 * (k + 1), " ".join(own)))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string").repartition(5)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    want = brute(rows)
    assert 42 < len(want) < len(rows) - 60
    assert sorted(x.doc_id for x in got.collect()) == sorted(want)


def test_large_groups_are_cut_and_still_meet(spark, monkeypatch):
    """Clusters with much text in common but not enough for a link, each a chain of edits, in groups far over the block."""
    from wayfind.llm import simhash_dedup

    r = random.Random(7)
    common, rows = [f"c{i}" for i in range(55)], []
    for cluster in range(30):
        words = common + [f"k{cluster}w{i}" for i in range(14)]
        for k in range(5):
            rows.append((100 * cluster + k, " ".join(words)))
            words = list(words)
            words[r.randrange(55, 69)] = f"e{cluster}x{k}"
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(brute(rows))
    assert 25 < len(want) < 60
    again, second = [], simhash_dedup.banding.second_round
    monkeypatch.setattr(simhash_dedup.banding, "second_round", lambda *x: again.append(second(*x)) or again[-1])
    for block in (3, 7, 40):
        assert sorted(x.doc_id for x in simhash_dedup.one_of_each(df, block=block).collect()) == want
    assert all(x.count() > 100 for x in again) and len(again) == 3
    monkeypatch.undo()
    again.clear()
    assert sorted(x.doc_id for x in simhash_dedup.one_of_each(df).collect()) == want and not again
    # With a single band no other key makes up for links that the second round is there to find.
    one = {"hashes": 1, "recall": 0.5}
    whole = simhash_dedup.one_of_each(df, **one).count()
    assert simhash_dedup.one_of_each(df, block=3, **one).count() == whole
    monkeypatch.setattr(simhash_dedup.banding, "second_round", lambda *x: second(*x).limit(0))
    assert simhash_dedup.one_of_each(df, block=3, **one).count() > whole


def test_ids_that_repeat_or_are_null(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, a), (1, a), (2, b), (2, b), (2, c), (3, b)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(((x.doc_id or 0), x.text[0]) for x in got.collect()) == [(0, "a"), (0, "a"), (2, "b"), (2, "c")]


def test_columns_with_any_names_long_texts_and_empty_tables(spark):
    a, b = " ".join(f"a{i}" for i in range(60_000)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x", "p"), (2, a + " more", "y", "p"), (3, b, "x", "q"), (4, None, "x", "q"), (5, " \n", "x", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, digest string").selectExpr("*", "part as n", "digest as fp", "doc_id as bucket")
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted((x.doc_id, x.part, x.digest, x.n, x.bucket) for x in got.collect()) == [(1, "x", "p", "x", 1), (3, "x", "q", "x", 3), (4, "x", "q", "x", 4)]
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0
