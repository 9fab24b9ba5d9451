import hashlib
import random

from wayfind.llm import suffix_dedup as S


def brute(rows, size):
    """Result by doc_id of a table of distinct ids."""
    first, out = {}, {}
    texts = sorted(((d if d is not None else S.NO_ID, (t or "").encode()) for d, t in rows), key=lambda x: x[0])
    for d, t in texts:
        for i in range(len(t) - size + 1):
            first.setdefault(t[i : i + size], (d, i))
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] != (d, i):
                gone[i : i + size] = b"\x01" * size
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[None if d == S.NO_ID else d] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(15, 60)) for _ in range(4)]
    rows = [(None, text(50)), (1, None), (2, ""), (3, "x" * 400), (4, "ab" * 150), (5, "x" * 99), (6, "x" * 100)]
    for d in range(7, 80):
        t = text(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            t = f"{t} {r.choice(passages)}{text(r.randint(0, 9))}"
        if r.random() < 0.3:
            base = r.choice(rows)[1] or ""
            cut = r.randint(0, len(base))
            t = base[:cut] + r.choice(["", "zz"]) + base[cut:]
        rows.append((d, t))
    r.shuffle(rows)
    return rows


def letters(seed, n):
    return "".join(random.Random(seed).choices("abcdéf ", k=n))


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, part string, bucket int")
    got = S.dedup(df.repartition(5), **more).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}, len(got)


def test_against_all_strings(spark):
    for seed in range(3):
        rows = corpus(seed)
        for hot in ({}, {"hot": 2}, {"hot": 2, "hot_in_task": 1}):
            got, n = result(spark, rows, **hot)
            assert n == len(rows)
            assert got == brute(rows, 100)


def test_many_small_buckets(spark, monkeypatch):
    import wayfind.llm.common as common

    monkeypatch.setattr(common, "BUCKET_BYTES", 300)
    rows = corpus(4)
    assert len(S.buckets_for(spark.createDataFrame(rows, "doc_id long, text string"))) > 16
    got, n = result(spark, rows)
    assert n == len(rows) and got == brute(rows, 100)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(S.C, "CHUNK", 300)
    got, _ = result(spark, rows, size=40)
    assert got == brute(rows, 40)


def test_repeated_rows_ids_and_empty_table(spark):
    a, b = letters(1, 300), letters(2, 200)
    n = len(a.encode())
    df = spark.createDataFrame([(1, a), (1, a), (2, a), (3, b), (3, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.part, r.n_removed) for r in S.dedup(df).collect())
    first = hashlib.md5(a.encode()).hexdigest() < hashlib.md5(b.encode()).hexdigest()  # texts of one id follow their digests
    assert got == [(1, 0, 0), (1, 0, 0), (2, 0, n), (3, 0, n if first else 0), (3, 1, 0 if first else n)]
    assert S.dedup(df.limit(0)).count() == 0


def test_many_texts_without_an_id(spark):
    texts = [letters(k, 200) for k in range(60)]
    got = S.dedup(spark.createDataFrame([(None, t) for t in texts] + [(5, "".join(texts[:20]))], "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.part for r in got if r.doc_id is None) == list(range(60))
    assert sum(r.n_removed for r in got if r.doc_id is None) == 0
    assert [r.n_removed for r in got if r.doc_id == 5] == [sum(len(t.encode()) for t in texts[:20])]


def test_documents_keep_their_columns(spark):
    a = letters(1, 300)
    df = spark.createDataFrame([(1, a, "en", 300), (2, a, "en", 300), (3, "é" + a + "tail", "fr", 305), (4, None, "fr", None), (5, "", "fr", 0)], "doc_id long, text string, lang string, n_chars long")
    got = S.deduped_documents(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.doc_id != 4) == [(1, a, 300), (3, "étail", 5), (5, "", 0)]
    assert sum(r.text is None for r in got.collect()) == 1
    clash = df.selectExpr("doc_id", "text", "lang as _sha", "lang as _id", "lang as _spans", "lang as sha", "lang as id", "lang as spans", "lang as cut", "doc_id as part", "n_chars")
    again = S.deduped_documents(clash)
    assert again.columns == clash.columns
    assert sorted((r.doc_id, r.text, r.sha, r._id, r.cut, r.part) for r in again.collect() if r.doc_id in (1, 3, 5)) == [(1, a, "en", "en", "en", 1), (3, "étail", "fr", "fr", "fr", 3), (5, "", "fr", "fr", "fr", 5)]
