import random

import numpy as np

from wayfind.llm import paragraph_dedup as P


def test_any_shared_fifty_words_are_found_wherever_lines_end(spark, tmp_path):
    r = random.Random(9)
    words = lambda n: [f"w{r.randint(0, 9999)}" for _ in range(n)]
    broken = lambda ws: "".join(w + r.choice([" ", " ", " ", "  ", "\n"]) for w in ws)
    passages = [words(50) for _ in range(40)]
    rows = [(2 * i + k, " ".join(words(r.randint(3, 60))) + " " + (broken(p) if i % 2 else " ".join(p)) + " " + " ".join(words(r.randint(3, 60)))) for i, p in enumerate(passages) for k in (0, 1)]
    # Clean texts share lines of up to 19 words, and passages of 24.
    short, passage = words(19), words(24)
    rows += [(d, " ".join(words(60)) + "\n" + " ".join(short) + "\n" + " ".join(words(60) + passage + words(60))) for d in range(100, 130)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op9_paragraph_dedup(spark, str(tmp_path)).collect()
    texts = {d: text.lower().split() for d, text in rows}
    lines = {d: [i for i, line in enumerate(text.split("\n")) for _ in line.split()] for d, text in rows}
    assert {g.doc_id for g in got} == set(range(80))
    for g in got:
        assert texts[g.doc_id][g.first_word :][: g.n_words] == texts[g.first_doc_id][g.first_first_word :][: g.n_words]
        assert lines[g.doc_id][g.first_word] == g.paragraph
        assert (g.first_doc_id, g.n_members, g.kept) == (g.doc_id // 2 * 2, 2, g.doc_id % 2 == 0)


def test_anchors_against_their_definition():
    rng = np.random.RandomState(2)
    for _ in range(30):
        sizes = rng.randint(1, 120, rng.randint(1, 6))
        ends = np.cumsum(sizes)
        h = rng.randint(0, 1 << 60, ends[-1]).astype(np.uint64) * np.uint64(3)
        got = set(P.anchors(h, ends).tolist())
        with np.errstate(over="ignore"):
            five = P.mix(P.gram_hash(h, 5)) if len(h) >= 5 else h
        want = set()
        for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
            for a in range(e - n, e - P.PASSAGE + 1):
                run = range(a, a + P.PASSAGE - P.WINDOW + 1)
                want |= {i for i in run if five[i] == min(five[j] for j in run)}
        assert got == want


def test_windows_against_all_windows(spark, monkeypatch):
    """Windows that several texts share, some more than once in a text, and ones that a large part of all texts share; repeats
    within one text only are none. Small blocks and buckets."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randint(0, 9999)}" for _ in range(n)]
    hot, other = words(70), words(60)
    rows = [(None, " ".join(hot)), (1, None), (2, ""), (3, " ".join(other * 3)), (3, " ".join(hot)), (3, " ".join(hot))]
    rows += [(d, " ".join(words(r.randint(0, 80)) + r.choice([hot, other[5:], []]) + words(r.randint(0, 9)))) for d in range(10, 90)]
    rows += [(200, " ".join(words(30_000) + hot)), (201, " ".join(words(60) * 3))]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, block int, kind int").repartition(5)
    for size in (1 << 19, 40):
        monkeypatch.setattr(P, "HELD", size)
        monkeypatch.setattr(P, "BUCKET", size)
        got = sorted(((g.doc_id or 0, g.part, g.number), (g.first_doc_id or 0, g.first_part, g.first_number), g.n_members, g.kept) for g in P.windows(df).collect())
        import hashlib

        parts = {t: i for i, t in enumerate(sorted({t for d, t in rows if d == 3}, key=lambda t: hashlib.md5(t.encode()).hexdigest()))}
        occurs = {}
        for d, t in rows:  # rows that agree in both give rows of their own
            w = (t or "").split()
            h = np.array([P.xxhash.xxh64_intdigest(x.encode()) for x in w], np.uint64)
            for a in P.anchors(h, np.array([len(w)])).tolist() if w else ():
                occurs.setdefault(tuple(w[a : a + 25]), []).append((d or 0, parts[t] if d == 3 else 0, a))
        want = sorted((o, min(own), len(own), o == min(own)) for own in occurs.values() if len({x[:2] for x in own}) > 1 for o in own)
        assert len(want) > 100 and got == want
    assert P.windows(df.limit(0)).count() == 0
