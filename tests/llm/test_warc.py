import gzip
import hashlib
import random

import pytest

from wayfind.llm import warc as W


def brute(rows, least=100):
    first = {}
    for p, h in sorted(((W.NO_ID if p is None else p, h or "") for p, h in rows)):
        b = h.encode()
        if len(b) >= least:
            first.setdefault(b, p)
    out, seen = [], set()
    for p, h in sorted(((W.NO_ID if p is None else p, h or "") for p, h in rows)):
        b = h.encode()
        target = first.get(b)
        revisit = target is not None and (target != p or b in seen)
        seen.add(b)
        clean = lambda x: None if x in (None, W.NO_ID) else x
        out.append((str(clean(p)), len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", str(clean(target) if revisit else None)))
    return sorted(out)


def pages():
    r = random.Random(5)
    page = lambda n: "".join(r.choices("<p>é中 \r\nx", k=n))
    shared = [page(300), "y" * 99, "z" * 100, page(5000)]
    rows = [(i * i % 9973 * 7, r.choice(shared) if r.random() < 0.5 else page(r.randint(0, 400))) for i in range(300)]
    return rows + [(None, shared[0]), (10**12, None), (-5, ""), (3, shared[0]), (3, shared[0]), (3, "other" * 40)]


def files(folder):
    import pathlib

    return {p.name: p.read_bytes() for p in pathlib.Path(folder.removeprefix("file://")).glob("files-*/*.gz*")}


def test_round_trip_and_determinism(spark):
    rows = pages()
    df = spark.createDataFrame([(p, f"http://x/{p}", h, "x") for p, h in rows], "page_id long, url string, html string, digest string")
    a, b = W.shared(spark, "a"), W.shared(spark, "b")
    W.write(df.repartition(5), a, roll=3000)
    W.write(df.repartition(3), b, roll=3000)
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in W.read(spark, a).collect()]
    assert sorted(got) == brute(rows)
    one, two = files(a), files(b)
    assert one == two and len(one) > 8 and not any(n.endswith("tmp") for n in one)
    name, data = next(iter(one.items()))
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
    W.write(df.limit(0), a)
    assert W.read(spark, a).count() == 0


def test_damage_is_found(spark):
    folder = W.shared(spark, "c")
    W.write(spark.createDataFrame([(1, "x" * 500)], "page_id long, html string"), folder)
    (data,) = files(folder).values()
    import pathlib

    (path,) = pathlib.Path(folder.removeprefix("file://")).glob("files-*/*.gz")
    with open(path, "wb") as f:
        f.write(gzip.compress(gzip.decompress(data).replace(b"xxx", b"xyx", 1)))
    with pytest.raises(Exception, match="digest or length is wrong"):
        W.read(spark, folder).count()


def test_ranges_follow_clustered_ids(spark):
    ids = spark.createDataFrame([(i, "7") for i in [*range(1000), *(10**15 + i for i in range(1000)), 10**17]], "page_id long, digest string")
    bounds = W.ranges(ids, 10)
    sizes = [ids.filter((W.F.col("page_id") >= a) & (W.F.col("page_id") < b)).count() for a, b in zip([-1, *(p for p, _ in bounds)], [*(p for p, _ in bounds), 10**18], strict=True)]
    assert len(bounds) == 9 and max(sizes) <= 250


def test_ranges_of_very_large_ids(spark):
    base = (1 << 62) + 1
    ids = spark.createDataFrame([(base + 2 * i, "7") for i in range(4000)] + [(-base, "7")], "page_id long, digest string")
    bounds = W.ranges(ids, 8)
    keys = sorted(r.page_id for r in ids.collect())
    sizes = [sum(1 for k in keys if a <= k < b) for a, b in zip([-(1 << 63), *(p for p, _ in bounds)], [*(p for p, _ in bounds), 1 << 63], strict=True)]
    assert sum(sizes) == 4001 and max(sizes) <= 502


def test_an_id_with_very_many_rows_is_cut_by_digest(spark):
    rows = [(None, f"{i} " * 60) for i in range(300)] + [(7, f"{i}x" * 60) for i in range(300)] + [(7, "y" * 200)] * 20 + [(i, "") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    short = df.select(W.F.coalesce("page_id", W.F.lit(W.NO_ID)).alias("page_id"), W.F.sha2("html", 256).alias("digest"))
    bounds = W.ranges(short, 8)
    sizes = short.groupBy(W.range_of(bounds, list(range(len(bounds) + 1))).alias("k")).count().collect()
    assert len(sizes) > 7 and max(c for _, c in sizes) < 160
    keys = sorted((r.page_id, r.digest) for r in short.collect())
    brute_sizes = sorted(c for c in [sum(1 for x in keys if sum(b <= x for b in bounds) == i) for i in range(len(bounds) + 1)] if c)
    assert sorted(c for _, c in sizes) == brute_sizes
    folder = W.shared(spark, "hot")
    W.write(df, folder, shards=8)
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in W.read(spark, folder).collect()]
    assert sorted(got) == brute(rows)


def test_urls_that_would_break_a_header_and_large_payloads(spark):
    urls = ["http://a/\n\nz", "http://b/\r\nX: y", "http://c/é x\x85", "", None, "http://d/\u2028"]
    rows = [(i, u, "é" * (3_000_000 if i == 2 else i)) for i, u in enumerate(urls)]
    folder = W.shared(spark, "urls")
    W.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = sorted((r.page_id, r.url, r.payload_bytes) for r in W.read(spark, folder).collect())
    want = ["http://a/%0A%0Az", "http://b/%0D%0AX:%20y", "http://c/é%20x%C2%85", None, None, "http://d/%E2%80%A8"]
    assert got == [(i, u, len(rows[i][2].encode())) for i, u in enumerate(want)]


def test_a_write_that_stops_before_its_manifest_leaves_the_one_before(spark, monkeypatch):
    folder = W.shared(spark, "twice")
    one, two = (spark.createDataFrame([(i, x * 300) for i in range(9)], "page_id long, html string") for x in "ab")
    W.write(one, folder)
    want = sorted(tuple(r)[:5] for r in W.read(spark, folder).collect())
    real = W.fs_of

    class Stopped:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name) if name != "rename" else lambda *_: False

    monkeypatch.setattr(W, "fs_of", lambda *a: (Stopped(real(*a)[0]), real(*a)[1]))
    with pytest.raises(OSError, match="can't be committed"):
        W.write(two, folder)
    monkeypatch.undo()
    assert sorted(tuple(r)[:5] for r in W.read(spark, folder).collect()) == want
    W.write(two, folder)
    assert sorted(tuple(r)[:5] for r in W.read(spark, folder).collect()) != want


def test_query_against_sql(spark, tmp_path):
    import duckdb

    rows = [(p, h) for p, h in dict(pages()).items() if p is not None]
    spark.createDataFrame([(p, f"http://x/{p}", h) for p, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = duck.execute(f"select {names} from ({W.OP6_SQL})").fetchall()
    assert sorted(tuple(map(str, r)) for r in W.op6_warc(spark, str(tmp_path)).select(*names.split(", ")).collect()) == sorted(tuple(map(str, r)) for r in want)
