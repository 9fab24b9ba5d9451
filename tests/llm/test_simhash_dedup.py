import random

import numpy as np
import xxhash

from wayfind.llm import bits as B
from wayfind.llm import simhash_dedup as S
from wayfind.llm.components import components, forest


def brute_print(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["Wort", "de", "la", "ÉTÉ", "the", "of", "Sun", "x y", "é"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 120))) for _ in range(150)]
    for _ in range(100):
        words = r.choice(texts).split(" ")
        words[r.randrange(len(words))] = "changed"
        texts.append(("\n\t" if r.random() < 0.3 else " ").join(words))
    rows = [*enumerate(texts), (500, None), (501, "  \n"), (502, "one"), (503, "one two"), (504, texts[0] * 40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string").repartition(6)
    got = {x.doc_id: (x.fp & (1 << 64) - 1, x.component_id) for x in S.near_duplicates(df).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == brute_classes(prints, 2)
    # Buckets of more than three fingerprints, cut into blocks that all meet, give the same.
    assert {x.doc_id: x.component_id for x in S.near_duplicates(df, block=3).collect()} == {i: c for i, (_, c) in got.items()}


def test_bit_planes_against_all_pairs():
    rng = np.random.RandomState(5)
    for n in (1, 2, 17, 64, 65, 300):
        base = rng.randint(0, 1 << 62, 4).astype(np.uint64)
        prints = np.unique(base[rng.randint(0, 4, n)] ^ (np.uint64(1) << rng.randint(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.randint(0, 64, n).astype(np.uint64)))
        planes = B.planes_of(prints)
        for radius in (0, 1, 2, 3, 7):
            near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
            for i, x in enumerate(prints):
                assert B.within(planes, len(prints), int(x), radius).tolist() == np.flatnonzero(near[i]).tolist()
            want = forest(np.argwhere(np.triu(near, 1)))
            got = forest(B.linked(prints, radius))
            assert sorted(map(tuple, want)) == sorted(map(tuple, got))


def test_near_links_in_small_and_large_groups():
    """Exact links of sets within a radius, in groups on both sides of SMALL, against all pairs."""
    rng = np.random.RandomState(4)
    for _ in range(6):
        sets, end = [], []
        for m in rng.choice([1, 2, 5, B.SMALL, B.SMALL + 1, 150], 4):
            base = [rng.randint(0, 1 << 60, 40) for _ in range(3)]
            for _ in range(m):
                own = base[rng.randint(3)].copy()
                own[rng.randint(0, 40, rng.randint(0, 9))] = rng.randint(0, 1 << 60)
                sets.append(np.unique(own).astype(np.uint64))
            end += [len(end) + m] * m
        size = np.array([len(s) for s in sets])
        prints = B.fingerprints(np.concatenate(sets), size)
        flat, begin = np.concatenate(sets), np.cumsum(size) - size
        got = S.banding.near_links(prints, np.array(end), flat, begin, size, 24, 0.8)
        want = []
        for i in range(len(sets)):
            for j in range(i + 1, end[i]):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (size[i] + size[j] - both) - 1e-9 and int(prints[i] ^ prints[j]).bit_count() <= 24:
                    want.append((i, j))
        assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, forest(np.array(want).reshape(-1, 2)).tolist()))
        near = S.banding.near_in_keys(prints, np.diff(np.r_[0, np.unique(end)]), 24, 100)
        far = [not any(i != j and end[i] == end[j] and int(prints[i] ^ prints[j]).bit_count() <= 24 for j in range(len(sets))) for i in range(len(sets))]
        sizes = np.bincount(end)[end]
        assert near.tolist() == [bool(m > 100 or not f) for f, m in zip(far, sizes, strict=True)]


def test_ids_that_repeat_or_are_null(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "q r s t u"), (2, "q r s t u")], "doc_id long, text string")
    got = sorted((str(x.doc_id), str(x.component_id)) for x in S.near_duplicates(df).collect())
    assert got == [("1", "1"), ("1", "None"), ("2", "1"), ("None", "None")]
    assert S.near_duplicates(df.limit(0)).count() == 0
    least = -(1 << 63)  # a document's id like any other
    near = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(7, near), (7, "other words that are near to nothing"), (3, near), (least, "one more text"), (None, "and one without an id")]
    got = sorted((x.fp, str(x.doc_id), str(x.component_id)) for x in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    prints = [(p - (p >> 63 << 64), str(d), c) for (d, t), c in zip(rows, ["3", "7", "3", str(least), "None"], strict=True) for p in [brute_print(t)]]
    assert got == sorted(prints)


def test_repeated_ids_link_by_fingerprint_alone(spark, monkeypatch):
    """Fingerprints, not ids, are what is linked: two texts of one id are two vertices."""
    x, y, z = 0b0, 0b11, (1 << 40) - 1
    given = {"X": x, "Y": y, "Z": z}
    df = spark.createDataFrame([(7, "X"), (7, "Z"), (3, "Y")], "doc_id long, text string")
    monkeypatch.setattr(S, "prints", lambda docs, words: docs.select("doc_id", S.F.expr("case " + " ".join(f"when text = '{k}' then {v}" for k, v in given.items()) + " end").cast("long").alias("fp")))
    assert sorted((r.doc_id, r.fp, r.component_id) for r in S.near_duplicates(df).collect()) == [(3, y, 3), (7, x, 3), (7, z, 7)]


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 7)]
    pairs += [(r.randint(10_000, 10_400), r.randint(10_000, 10_400)) for _ in range(200)]
    r.shuffle(pairs)
    got = {x.vertex: x.component for x in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    want = forest(np.array(pairs))
    assert got == dict(want.tolist())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
