import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from wayfind.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts():
    r = random.Random(2)
    alphabet = "abcdefgé ñß \n\t0129.,!?'#中文字🙂  AZ"
    out = ["", None, " ", "  \n ", "I'm we'll 123 don't<|endoftext|>", "a" * 5000, "é" * 3000, "=" * 999, "\x00\x7f�"]
    return out + ["".join(r.choices(alphabet, k=r.randint(1, 300))) for _ in range(300)]


def test_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 40)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in B.encode_decode(df, PATH, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(got[i].ids) == ids and got[i].n_tokens == len(ids) // 4
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert bytes(got[i].decoded).decode() == (t or "")
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.encode_decode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    hashes = np.random.RandomState(1).randint(0, 1 << 62, 20_000).astype(np.uint64)
    hashes = np.unique(hashes)
    f = B.PerfectHash(hashes)
    assert sorted(f(hashes).tolist()) == list(range(len(hashes)))
    assert (f(np.arange(100).astype(np.uint64)) < len(hashes)).all()
