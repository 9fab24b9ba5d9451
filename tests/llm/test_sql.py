import random

import duckdb
import pytest

from wayfind.llm import entry


def conversations():
    r = random.Random(11)
    rows = [(c, r.choice([t, t, t, 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(["a.", "b!", "c", " \n", None, "", "é? ", "a.", "x\ny"])) for c in range(200) for t in range(r.randrange(30))]
    return [*rows, (None, None, None, None), (None, 1, "user", "x."), (900, 0, "user", "x" * 5000 + ".")]


def tables():
    r = random.Random(14)
    word = lambda: r.choice(["the", "Öl", "x#", "a|b", "É", "of"]) + str(r.randint(0, 40))
    text = lambda n: "".join(word() + r.choice([" ", " ", " ", "  ", "\n", "\n\n", "\t"]) for _ in range(n))
    items = [(i, text(r.randint(6, 40))) for i in range(20)] + [(30, "one two"), (31, "solo"), (32, ""), (33, None), (34, "a a a a a a a a a")]
    passages = [text(r.randint(9, 50)) for _ in range(6)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "solo"), (4, "a " * 900), (5, "One, TWO"), (6, "é" * 300), (7, "xy" * 400), (8, text(6000) + passages[0])]
    for d in range(10, 120):
        parts = [text(r.randint(0, 90))]
        parts += [r.choice(passages)] * r.randint(0, 2) + [r.choice(items[:20])[1]] * r.randint(0, 1)
        if d % 9 == 0:
            parts = [docs[-1][1]]
        r.shuffle(parts)
        docs.append((d, "".join(parts)))
    pages = [(d, f"http://x/{d}", t) for d, t in docs]
    return {
        "documents": ([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (items, "item_id long, text string"),
        "pages": (pages, "page_id long, url string, html string"),
        "conversations": (conversations(), "conv_id long, turn long, role string, text string"),
    }


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder, duck = str(tmp_path_factory.mktemp("tables")), duckdb.connect()
    for name, (rows, schema) in tables().items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        duck.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    return folder, duck


@pytest.mark.parametrize("name", sorted(entry.ORACLE))
def test_query_matches_its_sql(spark, both, name):
    folder, duck = both
    got = entry.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({entry.ORACLE[name]})").fetchall()
    assert want and sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
