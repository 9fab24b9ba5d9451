import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from wayfind.llm import periodic_runs as P


def brute(words, least=24, times=3):
    """All maximal stretches whose smallest period is q, by comparing words."""
    n, out = len(words), []

    def smallest(a, b):
        return next(q for q in range(1, b - a + 1) if all(words[i] == words[i + q] for i in range(a, b - q)))

    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and smallest(i, j + q) == q:
                out.append((i, j + q - i, q))
            i = j
    return sorted(out)


def planted(r, size):
    words = [r.randrange(r.choice([2, 5, 40])) for _ in range(size)]
    for _ in range(r.randrange(4)):
        p, a = r.randrange(1, 12), r.randrange(len(words))
        words[a:a] = (words[a : a + p] or [1]) * r.randrange(3, 9)
    return words


@pytest.mark.parametrize("small", [0, 1024])
def test_runs_against_brute_force(monkeypatch, small):
    monkeypatch.setattr(P, "SMALL", small)
    r = random.Random(13)
    total = 0
    for _ in range(150):
        words = planted(r, r.randrange(1, 150))
        least = r.choice([24, 6, 1])
        want = brute(words, least)
        total += len(want)
        assert P.runs_of(np.array(words, np.int64), least) == want
    assert total > 200
    ids = np.array([0] * 5000 + [1] + [0] * 3000 + [1, 2, 3, 0] * 900, np.int64)
    assert P.runs_of(ids) == [(0, 5000, 1), (5001, 3000, 1), (8000, 3601, 4)]


def query_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in planted(r, r.randrange(1, 120)))) for i in range(200)]
    rows += [(900, ""), (901, None), (902, " \n\t "), (903, "é x " * 30), (5, rows[5][1]), (5, rows[5][1])]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int").write.parquet(str(tmp_path / "documents.parquet"))
    out = P.op13_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted((query_row(i, t) for i, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10 and sum(g[1] > 0 for g in got) > 50


def test_null_ids_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b " * 20), (None, None)], "doc_id long, text string")
    assert sorted((len(r.runs), r.collapsed) for r in P.periodic_runs(df).collect()) == [(0, ""), (1, "a b")]
    df.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.op13_periodic_runs(spark, str(tmp_path)).count() == 0
    df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert {r.n_runs for r in P.op13_periodic_runs(spark, str(tmp_path)).collect()} == {0, 1}


def test_a_long_text(spark):
    """A text of 60,000 words with one long run, and one of a single word, take seconds."""
    r = random.Random(2)
    ids = np.array([r.randrange(500) for _ in range(60_000)], np.int64)
    ids[20_000:52_000] = np.resize(ids[20_000:28_001], 32_000)
    want = P.runs_of(ids)
    assert [(q, size >= 32_000) for _, size, q in want] == [(8001, True)]
    assert P.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
