import random
import re
from collections import Counter

from wayfind.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, text in items:
            own = words(text)
            if not own or not w:
                continue
            k, size = min(5, len(own)), min(len(own), len(w))
            weights = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            b, best = weights(own), 0
            for s in range(len(w) - size + 1):
                a = weights(w[s : s + size])
                if a:
                    best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out.add((d, i, round(best, 9)))
    return out


def data():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "the", "of"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(r.randint(6, 50))) for i in range(40)] + [(50, "one two"), (51, "solo"), (52, ""), (53, None), (None, text(20)), (54, "a a a a a a a a a a a a a a a")]
    docs = [(0, None), (1, ""), (2, "one, TWO three"), (3, "solo"), (4, "a " * 500)]
    for d in range(5, 160):
        w = text(r.randint(0, 60)).split()
        for _ in range(r.randint(0, 2)):
            leak = (r.choice(items)[1] or "").split()
            for _ in range(r.randint(0, 2)):
                if leak:
                    leak[r.randrange(len(leak))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = leak
        docs.append((d, ", ".join(w).upper() if d % 5 == 0 else " ".join(w)))
    return docs, items


def test_against_all_windows(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 40
    for most in (D.MOST, 900):
        got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in D.contaminated(df, bench, most=most).collect()}
        assert got == want
    clean = D.clean_documents(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in want}
    # Several blocks are several passes, and the caller's own table stays.
    mine = D.save(df, "mine")
    monkeypatch.setattr(D, "PAIRS", 7)
    for _ in range(2):
        assert {r.doc_id for r in D.clean_documents(mine, bench, most=900).collect()} == {d for d, _ in docs} - {d for d, *_ in want}
    assert mine.count() == len(docs)
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_very_long_texts_long_items_and_repeated_rows(spark):
    r = random.Random(1)
    text = lambda n: [f"v{r.randint(0, 99999)}" for _ in range(n)]
    long_, short = text(20_000), text(30)
    near = list(long_)
    near[7], near[15_000] = "changed", "also"
    items = [(1, " ".join(long_)), (2, " ".join(short)), (2, " ".join(short))]
    docs = [(1, " ".join(text(100_000) + near + text(999))), (2, " ".join(text(50) + short)), (2, " ".join(text(50) + short)), (3, " ".join(text(100_000))), (4, "the " * 200_000)]
    df = spark.createDataFrame([(d, t, 0.0, 1) for d, t in docs], "doc_id long, text string, similarity double, first_word int")
    got = D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.first_word, x.n_words) for x in got) == [(1, 1, 100_000, 20_000)] + [(2, 2, 50, 30)] * 4
    assert D.clean_documents(df, spark.createDataFrame(items, "item_id long, text string")).columns == df.columns


def test_the_blocks_lists_miss_none_within_the_radius():
    import numpy as np

    r = random.Random(4)
    items = [(i, " ".join(f"x{r.randint(0, 50)}" for _ in range(12))) for i in range(200)]
    index = D.Index(items, D.RADIUS)
    own = index.near[12][0]
    prints = own[np.random.RandomState(1).randint(0, 200, 500)] ^ np.array([sum(1 << b for b in r.sample(range(64), r.randint(0, 24))) for _ in range(500)], np.uint64)
    want = np.argwhere(np.bitwise_count(prints[:, None] ^ own[None]) <= D.RADIUS)
    assert sorted(zip(*(x.tolist() for x in index.candidates(12, prints)), strict=True)) == sorted(map(tuple, want.tolist()))
