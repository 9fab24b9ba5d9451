import random
import re

from wayfind.llm import quality_rules as Q


def brute(t, least=Q.LEAST):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(words)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    seen = {}
    for i in range(n - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    rep = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    cover, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        if best >= least:
            cover |= set(range(i, i + best))
            longest = max(longest, best)
    failed = n < 50 or 100 * len(rep) > 50 * n
    kept = not failed and len(cover) <= Q.MAX_COVERED * n and longest <= Q.MAX_LONGEST * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed, kept, len(cover), longest


def texts():
    r = random.Random(4)
    out = ["", None, " \n\t ", "a", "a " * 70, "a b " * 60, "x\n\nx\nx \n", "é#$ ü\x0bz\x0c| q<>"]
    for _ in range(120):
        words = [f"w{r.randint(0, 300)}é" if r.random() < 0.8 else r.choice(["the", "of", "#", "|"]) for _ in range(r.randint(1, 160))]
        for _ in range(r.randint(0, 3)):
            a, size, b = r.randrange(len(words)), r.randint(2, 40), r.randrange(len(words))
            words[b:b] = words[a : a + size]
        out.append("".join(w + r.choice([" ", " ", "\n", "\t", "  "]) for w in words))
    return out


def test_against_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in Q.quality(df).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert sum(g[6] for g in got.values()) > 20 and sum(not g[5] and not g[6] for g in got.values()) > 10
    kept = Q.kept_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g[6]}


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_words) for r in Q.quality(df).collect()) == [("1", 2), ("1", 2), ("None", 2)]
    assert Q.quality(df.limit(0)).count() == 0
