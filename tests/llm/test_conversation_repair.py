import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from wayfind.llm import conversation_repair as R

ROLE = re.compile("(s?(ua)+)?")


def cheapest(rows, fault):
    """The least (cost, audit, repaired rows) of all edits, by trying every one (Dijkstra over strings would do the same)."""
    best = None
    n = len(rows)
    choices = [("D",) if f in (1, 2) else ("D", "K", "Ru", "Ra") for f in fault]
    for pick in itertools.product(*choices):
        base = sum({"D": 3, "K": 0}.get(p, 2) + (p != "D" and f == 3) for p, f in zip(pick, fault, strict=True))
        for ins in itertools.product(("", "u", "a", "ua", "au"), repeat=n + 1):
            cost = base + 2 * sum(map(len, ins))
            if best and cost > best[0]:
                continue
            audit, lines, roles = "", [], ""
            for i in range(n + 1):
                for x in ins[i]:
                    audit, roles = audit + "I", roles + x
                    lines.append({"u": "user", "a": "assistant"}[x] + ":")
                if i < n:
                    audit += pick[i][0]
                    if pick[i] != "D":
                        role = rows[i][0] if pick[i] == "K" else {"u": "user", "a": "assistant"}[pick[i][1]]
                        roles += role[:1] if role[:1] in ("s", "u", "a") else "x"  # an empty role can't be kept
                        lines.append(f"{role}:{rows[i][1]}")
            if ROLE.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def expected(conv, rows):
    """Of original rows (turn, role, text), by the statement of the query."""
    after = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        after += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    fault, seen = [], set()
    for _, role, text in after:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in after if t is not None]
    initials = [r[:1] for _, r, _ in after]
    cost, audit, text = cheapest([x[1:] for x in after], fault)
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(k) for k in (1, 2, 3)),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def conversations():
    r = random.Random(11)
    rows = []
    for conv in range(300):
        for turn in range(r.randrange(0, 5)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, r.choice([turn, turn, turn, 7, None]), role, r.choice(["a.", "b!", "c", " \n", None, "", "é? ", "a."])))
    rows += [(None, None, None, None), (None, 1, "user", "x."), (None, 2, "assistant", "y.")]
    return rows


def test_query_against_all_edits(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, copies int").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    out = R.op11_conversation_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    own = {}
    for conv, *x in rows:
        own.setdefault(conv, []).append(tuple(x))
    got = {x.conv_id: tuple(x) for x in out.collect()}
    assert len(got) == len(own) == out.count()
    short = {c: v for c, v in own.items() if len(v) < 4 or c is None}
    assert {c: got[c] for c in short} == {c: expected(c, v) for c, v in short.items()}
    assert any(g[7] == "" for g in got.values()) and any("I" in g[7] for g in got.values()) and any("R" in g[7] for g in got.values())


def slow_costs(kind, gone, broken):
    """Least cost and audit by states, one conversation at a time, keeping whole strings."""
    ways = {R.START: (0, "")}

    def inserts(w):
        for _ in range(3):
            for s, (c, a) in list(w.items()):
                x = (c + 2, a + "I")
                if x < w.get(R.AFTER[s].item(), (1 << 30, "")):
                    w[R.AFTER[s].item()] = x
        return w

    def step(w, k, g, b):
        out = {}
        for s, (c, a) in w.items():
            moves = [(s, c + 3, "D")]
            if not g:
                moves.append((R.AFTER[s].item(), c + 2 + b, "R"))
                if R.KEPT[s, k] >= 0:
                    moves.append((R.KEPT[s, k].item(), c + b, "K"))
            for to, cost, x in moves:
                out[to] = min(out.get(to, (1 << 30, "")), (cost, a + x))
        return out

    ways = inserts(ways)
    for k, g, b in zip(kind, gone, broken, strict=True):
        ways = inserts(step(ways, k, g, b))
    return min(ways[s] for s in (R.START, R.DONE) if s in ways)


def test_costs_of_long_conversations():
    r = np.random.default_rng(5)
    for turns in (0, 1, 7, 40):
        n = 60
        size = r.integers(0, turns + 1, n)
        kind, gone, broken = r.integers(0, 4, (turns, n)), r.random((turns, n)) < 0.2, r.random((turns, n)) < 0.3
        cost, (conv, letter, _, _) = R.edits(kind, gone, broken, size)
        for j in range(n):
            want = slow_costs(*(x[: size[j], j] for x in (kind, gone, broken)))
            assert (cost[j], "".join(map(chr, letter[conv == j]))) == want


@pytest.mark.parametrize("held", [1, 8 << 20])
def test_long_conversation_and_small_batches(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD", held)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}. " + "x" * (300_000 if t == 3 else 5) + ".") for t in range(2000)] + [(2, 0, "user", "hi.")]
    got = {r.conv_id: r for r in R.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].cost, got[1].audit, len(got[1].turns)) == (0, "K" * 2000, 2000) and (got[2].cost, got[2].audit) == (2, "KI")
    assert [t.role for t in got[2].turns] == ["user", "assistant"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert R.op11_conversation_repair(spark, str(tmp_path)).count() == 0
