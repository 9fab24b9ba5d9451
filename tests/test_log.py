"""Tables under a log: upserts, deletes, concurrent writers, crashes, compaction."""

import random

import pytest

from wayfind.operators import ingest as I
from wayfind.sources import log as L
from wayfind.sources import store as T

EDGE = "src string, dst string, score double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def edges(spark, *triples):
    return spark.createDataFrame(list(triples), EDGE)


@pytest.fixture
def log(spark, tmp_path):
    return L.Log(spark, f"file://{tmp_path}/log")


def test_random_changes_against_a_dict(spark, log):
    r = random.Random(4)
    change = log.begin()
    change.create("e", edges(spark, ("a", "b", 0.5)), ["src", "dst"], 4)
    change.commit()
    want = {("a", "b"): 0.5}
    for _ in range(6):
        change = log.begin()
        new = {(r.choice("abcdef"), r.choice("abcdef")): r.random() for _ in range(r.randrange(1, 9))}
        if r.random() < 0.3:
            change.delete("e", edges(spark, *[(*k, 0.0) for k in new]))
            want = {k: v for k, v in want.items() if k not in new}
        else:
            change.upsert("e", edges(spark, *[(*k, v) for k, v in new.items()]))
            want |= new
        change.commit()
        assert rows(log.read("e")) == sorted((*k, v) for k, v in want.items())
    assert rows(log.read("e", 1)) == [("a", "b", 0.5)] and log.versions() == list(range(1, 8))
    before = log.state()
    log.compact("e")
    assert rows(log.read("e")) == sorted((*k, v) for k, v in want.items())
    own = log.state()["tables"]["e"]
    assert len(own["layers"]) == 1 and not own["gone"] and len(before["tables"]["e"]["layers"]) > 3
    assert log.clean() and rows(log.read("e")) == sorted((*k, v) for k, v in want.items()) and not log.clean()
    with pytest.raises(KeyError, match="no table x"):
        log.read("x")


def test_two_writers_both_hold(spark, log):
    change = log.begin()
    change.create("e", edges(spark, ("a", "b", 0.1), ("b", "c", 0.1)), ["src", "dst"], 4)
    change.commit()
    one, two = log.begin(), log.begin()
    one.upsert("e", edges(spark, ("a", "b", 0.2), ("x", "y", 0.2)))
    two.upsert("e", edges(spark, ("a", "b", 0.3), ("b", "c", 0.3), ("u", "v", 0.3)))
    assert one.commit() == 2 and two.commit() == 3
    assert rows(log.read("e")) == [("a", "b", 0.3), ("b", "c", 0.3), ("u", "v", 0.3), ("x", "y", 0.2)]
    # One that meets a compaction looks for its rows again.
    late = log.begin()
    late.upsert("e", edges(spark, ("x", "y", 0.9)))
    log.compact("e")
    late.commit()
    assert rows(log.read("e"))[-1] == ("x", "y", 0.9) and log.read("e").count() == 4
    # A compaction whose layers have lost rows fails, one beside an insert doesn't.
    pack = log.begin()
    pack.rewrite("e")
    other = log.begin()
    other.upsert("e", edges(spark, ("x", "y", 1.0)))
    other.commit()
    with pytest.raises(L.Conflict):
        pack.commit()
    pack = log.begin()
    pack.rewrite("e")
    other = log.begin()
    other.append("e", edges(spark, ("new", "one", 1.0)))
    other.commit()
    pack.commit()
    assert rows(log.read("e")) == [("a", "b", 0.3), ("b", "c", 0.3), ("new", "one", 1.0), ("u", "v", 0.3), ("x", "y", 1.0)]


def test_a_writer_that_loses_the_race_for_a_name(spark, log, monkeypatch):
    """Both have seen the same latest version; the file of one is there first."""
    change = log.begin()
    change.create("e", edges(spark, ("a", "b", 0.1)), ["src", "dst"], 4)
    change.commit()
    assert not L.create(spark, f"{log.folder}/log/{1:012d}.json", "{}") and log.state()["tables"]
    mine, theirs = log.begin(), log.begin()
    theirs.upsert("e", edges(spark, ("t", "t", 1.0)))
    mine.upsert("e", edges(spark, ("m", "m", 1.0)))
    stale, seen = log.state(), []
    real = L.Log.state
    monkeypatch.setattr(L.Log, "state", lambda self, v=None: seen.append(1) or (theirs.commit() and stale if len(seen) == 1 else real(self, v)))
    assert mine.commit() == 3 and {r[0] for r in rows(log.read("e"))} == {"a", "t", "m"}


def test_a_crash_between_tables_shows_the_old_version(spark, log):
    nodes = lambda *names: spark.createDataFrame([(n,) for n in names], "node_id string")
    change = log.begin()
    change.create("nodes", nodes("a"), ["node_id"])
    change.create("edges", edges(spark, ("a", "a", 1.0)), ["src", "dst"])
    change.commit()
    change = log.begin()
    change.append("nodes", nodes("b"))  # and no more: the writer dies
    assert rows(log.read("nodes")) == [("a",)] and log.read("edges").count() == 1
    assert len(log.clean()) == 1
    change = log.begin()
    change.append("nodes", nodes("b"))
    change.append("edges", edges(spark, ("a", "b", 1.0)))
    change.commit()
    assert (log.read("nodes").count(), log.read("edges").count()) == (2, 2) and (log.read("nodes", 1).count(), log.read("edges", 1).count()) == (1, 1)


def test_a_change_reads_the_buckets_of_its_keys_only(spark, log):
    change = log.begin()
    change.create("e", spark.range(2000).selectExpr("cast(id as string) as src", "'x' as dst", "1.0D as score"), ["src", "dst"], 16)
    change.commit()
    new = edges(spark, ("7", "x", 2.0))
    change = log.begin()
    found = change.found("e", change.keys("e", new), log.state()["tables"]["e"])
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "bucket#" in scan.split("PartitionFilters: [")[1].split("]")[0] and found.count() == 1
    change.upsert("e", new)
    change.commit()
    assert log.read("e").filter("score = 2").count() == 1 and log.read("e").count() == 2000


def test_edges_of_known_nodes_and_nodes_that_go(spark, log):
    """What a change has read must still hold when it is committed."""
    change = log.begin()
    change.create("nodes", spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), ["key"])
    change.create("edges", edges(spark), ["src", "dst"])
    change.commit()
    new = spark.createDataFrame([(1, "a", "b", 0.1), (2, "a", "b", 0.2), (3, "a", "zz", 0.9)], "row_no long, source string, target string, score double")
    assert T.upsert_links(log, new) == 2 and T.upsert_links(log, new) == 3
    assert rows(log.read("edges")) == [("a", "b", 0.2)]
    change = log.begin()
    change.upsert("edges", I.last_scores(change.read("nodes"), spark.createDataFrame([(1, "c", "a", 0.4)], new.schema)))
    other = log.begin()
    other.delete("nodes", spark.createDataFrame([("c",)], "key string"))
    other.commit()
    with pytest.raises(L.Conflict, match="nodes"):
        change.commit()
    assert rows(log.read("edges")) == [("a", "b", 0.2)] and rows(log.read("nodes")) == [("a",), ("b",)]


def test_unique_keys_are_checked_in_their_buckets(spark, log):
    nodes = lambda *pairs: spark.createDataFrame([(n, ["E"], k) for n, k in pairs], "node_id string, labels array<string>, canonical_id string")
    T.create_nodes(log, nodes(("n1", "k1"), ("n2", None), ("n3", None)), "E", "canonical_id")
    T.put_nodes(log, nodes(("n4", "k4"), ("n1", "k1")), "E", "canonical_id")
    for bad in (nodes(("n9", "k4")), nodes(("n8", "k8"), ("n9", "k8"))):
        with pytest.raises(ValueError, match="canonical_id k[48] "):
            T.put_nodes(log, bad, "E", "canonical_id")
    assert sorted(r.node_id for r in log.read("nodes").collect()) == ["n1", "n2", "n3", "n4"]
    T.put_nodes(log, nodes(("n4", "k5")), "E", "canonical_id")  # its old key is free now
    T.put_nodes(log, nodes(("n9", "k4")), "E", "canonical_id")
    assert rows(log.read("nodes_canonical_id")) == [("k1", "n1"), ("k4", "n9"), ("k5", "n4")]
    with pytest.raises(ValueError, match="occurs"):
        T.create_nodes(L.Log(spark, log.folder + "2"), nodes(("n1", "k"), ("n2", "k")), "E", "canonical_id")
