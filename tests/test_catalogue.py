import math

import duckdb
import pytest

from wayfind import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows):
    clean = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(map(clean, r)) for r in rows), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({catalogue.ORACLE[name]})").fetchall()
    assert norm(map(tuple, got.select(*columns).collect())) == norm(want)
