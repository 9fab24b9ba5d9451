"""The automaton's search: what a task holds is bounded, and its results are the same."""

from types import SimpleNamespace

import pyarrow as pa

from wayfind.operators import search as S


def test_a_task_gives_hits_on_before_it_holds_too_many(monkeypatch):
    needles = [f"w{i} " for i in range(50)]
    texts = ["".join(f"w{i} " for i in range(50) if (n + i) % 3) for n in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"n{n:02d}" for n in range(40)]), pa.array(texts), pa.nulls(40, pa.string()), pa.nulls(40, pa.string())], ["node_id", "text", "name", "canonical_name"])

    def found():
        out = [(r["q"], r["node_id"], r["relevance"]) for b in S.searched(SimpleNamespace(value=needles), 3, True)([batch]) for r in b.to_pylist()]
        first = {q: sorted(x for x in out if x[0] == q)[:3] for q in needles}
        return first, len(out)

    whole, n = found()
    assert n == 150
    monkeypatch.setattr(S, "HELD", 120)
    parts, more = found()
    assert parts == whole and more > n
