import random

from wayfind.llm import paragraph_dedup as P


def shingled(line):
    words = [w for w in line.encode().translate(P.LOWER).split()]
    return words, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, least=20):
    """(doc_id, line): (first doc_id, first line, members, kept) of tables of distinct ids."""
    units = []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            words, s = shingled(line)
            if len(words) >= least:
                units.append((d, i, s))
    root = list(range(len(units)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(units)):
        for j in range(i):
            a, b = units[i][2], units[j][2]
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    members = {}
    for i in range(len(units)):
        members.setdefault(find(i), []).append(i)
    return {units[i][:2]: (*units[f][:2], len(m), i == f) for f, m in members.items() if len(m) > 1 for i in m}


def corpus(seed):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(["the", "Öl", "x#"]) + str(r.randint(0, 999)) for _ in range(n))
    passages = [line(r.randint(22, 70)) for _ in range(8)]
    rows = [(None, passages[0]), (1, None), (2, ""), (3, "\n\n"), (4, (passages[1] + "\n") * 3), (5, "short line here")]
    for d in range(6, 120):
        lines = [line(r.randint(1, 60)) for _ in range(r.randint(0, 4))]
        for _ in range(r.randint(0, 2)):
            words = r.choice(passages).split()
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = f"new{r.randint(0, 3)}"
            lines.insert(r.randint(0, len(lines)), "  ".join(words).upper() if r.random() < 0.2 else " ".join(words))
        rows.append((d, "\n".join(lines)))
    return rows


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int").repartition(4)
    got = P.repeats(df, **more).collect()
    place = lambda d, line: sum(len(x.split()) for x in (dict(rows)[d] or "").split("\n")[:line])
    lines = {(d, place(d, i)): i for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.split()}
    assert all(lines[r.doc_id, r.number] == r.paragraph for r in got)
    out = {(r.doc_id, r.paragraph): (r.first_doc_id, lines[r.first_doc_id, r.first_number], r.n_members, r.kept) for r in got}
    assert len(out) == len(got)
    return out


def test_against_all_pairs(spark):
    rows = corpus(1)
    want = brute(rows)
    assert len(want) > 50
    assert result(spark, rows) == want


def test_many_small_buckets(spark, monkeypatch):
    import wayfind.llm.common as common

    monkeypatch.setattr(common, "BUCKET_BYTES", 300)
    rows = corpus(3)
    assert result(spark, rows) == brute(rows)


def test_blocks_of_large_keys_meet(spark):
    rows = corpus(2)
    assert result(spark, rows, block=3) == brute(rows)


def test_bands_and_edges(spark):
    assert P.banding.tune_bands(0.8, 0.995, 48) == (11, 4)
    df = spark.createDataFrame([(1, "a " * 30, 7), (1, "a " * 30, 8), (2, "b " * 30, 9)], "doc_id long, text string, line int")
    assert P.repeats(df.limit(0)).count() == 0
    assert [(r.doc_id, r.kept) for r in P.repeats(df).collect()] == [(1, True), (1, True)]


def test_one_doc_id_with_several_texts_and_a_very_long_text(spark):
    """Many texts without an id, and a text of 200,000 words that holds a line of each."""
    r = random.Random(5)
    line = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    texts = [line(30) for _ in range(50)]
    rows = [(None, t) for t in texts] + [(1, line(199_000) + "\n" + "\n".join(texts[:10]))]
    got = P.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len({(g.first_doc_id, g.first_part) for g in got}) == 10
    assert sorted((g.doc_id or 0, g.kept, g.n_members) for g in got) == [(0, True, 2)] * 10 + [(1, False, 2)] * 10
