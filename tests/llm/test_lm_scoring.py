import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfind.llm import lm_scoring as L


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def held_out(d):
    return d is None or zlib.crc32(str(d).encode()) % 10 == 0


def counted(rows, order):
    """Counts of all n-grams of the training texts as tuples, None for the end."""
    count = Counter()
    for d, t in rows:
        if not held_out(d):
            tokens = [None, *words(t), None]
            count.update((w,) for w in tokens[1:])
            for k in range(2, order + 1):
                count.update(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
    return count


def brute(rows, order=3, mass=16.0):
    """The interpolated probabilities by their definition, without an automaton."""
    count = counted(rows, order)
    n = sum(c for g, c in count.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 0.1) / (n + 0.1 * (v + 1))
        return (count[gram] + mass * p(gram[1:])) / (count[gram[:-1]] + mass)

    out = []
    for d, t in rows:
        tokens = [None, *words(t), None]
        score = sum(math.log10(p(tuple(tokens[max(0, i + 1 - order) : i + 1]))) for i in range(1, len(tokens)))
        base = sum(math.log10(p((w,))) for w in tokens[1:])
        out.append((str(d), held_out(d), len(tokens) - 1, sum(count[(w,)] > 0 for w in tokens[1:]), n, base, score))
    return sorted(out)


def corpus():
    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("Wo", "te", "é", "the", "x|") for b in ("", "n", "ing", "é", "ß", "99", "A")]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(d, " ".join(r.choices(vocabulary, weights, k=r.randint(0, 60))) + f" rare{r.randint(0, 200)}") for d in range(120)]
    return rows + [(None, "the wo"), (None, "the wo"), (500, None), (501, " \n"), (7, "again the"), (7, "again the"), (502, "the " * 2000)]


def result(df, **more):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in L.score(df, **more).collect())


@pytest.mark.parametrize("more", [{}, {"order": 2}, {"order": 4, "mass": 1.5}, {"block": 90, "bucket": 50, "segment": 7}])
def test_against_brute_force(spark, more):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, score string, block int, kind int").repartition(4)
    got, want = result(df, **more), brute(rows, **{k: v for k, v in more.items() if k in ("order", "mass")})
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def automaton(rows, order, mass):
    """The automaton of one block that holds all rows, and the block."""
    (batch,) = L.blocks(10**9)([batch_of(rows)])
    block = L.Block(batch.column(1)[0].as_py())
    grams = block.grams(order)
    counts = [np.bincount(of[block.train & (of >= 0)], minlength=len(name)) for name, _, of in grams]
    count = block.word_counts()
    return block, L.Automaton(block, count, grams, counts, int(count.sum()), int((count > 0).sum()), mass)


def batch_of(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])


def test_every_state_is_a_distribution_and_failure_arcs_are_followed(monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(L.TaskContext, "get", staticmethod(lambda: Task))
    rows = [(d, t) for d, t in corpus() if d is not None and d < 200]
    block, a = automaton(rows, 3, 2.0)
    types = int(a.known.sum())
    unknown = 0.1 / (int(block.word_counts().sum()) + 0.1 * (types + 1))
    symbol = np.flatnonzero(a.known)
    reached, open_ = {0}, [0]
    while open_:  # all states that known words lead to; nothing is read after an end
        after = np.unique(a.step(np.full(len(symbol) - 1, open_.pop()), symbol[1:])[0])
        open_ += [s for s in after.tolist() if s not in reached]
        reached.update(after.tolist())
    failed = 0
    for s in reached:
        _, log = a.step(np.full(len(symbol), s), symbol)
        lost, at = 0.0, s  # unknown words share what is left at the empty history
        while at:
            lost, at = lost + a.weight[at], a.failure[at]
            failed += 1
        assert (10**log).sum() + 10**lost * unknown == pytest.approx(1)
    assert len(reached) > 500 and failed > len(reached)


def test_score_tells_seen_texts_from_new_ones(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(r.choices(vocabulary, k=80))
    ids = [d for d in range(400) if held_out(d)]
    rows = [(d, text()) for d in range(400)]
    twice = dict(zip(ids[:10], [t for d, t in rows if not held_out(d)], strict=False))
    rows = [(d, twice.get(d, t)) for d, t in rows]
    got = {x.doc_id: x.score / x.n_tokens for x in L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[d] for d in twice) > max(got[d] for d in ids[10:]) + 0.3


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(empty).count() == 0
    (row,) = L.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and math.isfinite(row.score)
