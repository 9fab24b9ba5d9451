"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, by dynamic programming over
time-major arrays.

Conversations are bucketed by length, and each bucket's costs are an array of (turn, conversation, state). A state is what
may come next: START (a system or user turn, or the end), FIRST (after a system turn), USER (a user turn is there) and DONE (a
reply is there; the end, or a user turn). One step back over a turn takes all conversations of the bucket at once; the stored
costs then lead the edits forward, again for all at once. At each step the first of Delete, Insert, Keep and Rerole that
stays on a cheapest way is taken, which gives the least string of initials; what Rerole and Insert give follows from the state.

Turns: (conv_id, turn, role, text). Those of a conversation are taken by turn, nulls first, then by role and text; a null role
or text is one space, and an empty role can't be kept. A null conv_id is a conversation of its own. Blank turns and turns with a role and text seen earlier
must go; undeleted turns that break off cost 1. A conversation without turns has no edits. Texts and conversations of any length are
treated whole; a conversation's turns meet in one task, which holds its texts, as its repaired text is one value. Columns
beside these four are ignored; an empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import by_value, partitions, table, trimmed

by_value(__name__)

START, FIRST, USER, DONE = range(4)
OTHER, S, U, A = range(4)  # initials of roles
KINDS = {"s": S, "u": U, "a": A}
NEVER = 1 << 28
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1  # costs
AFTER = np.array([USER, USER, DONE, USER])  # the state after a turn that Rerole or Insert gives
GIVEN = ("user", "user", "assistant", "user")  # and that turn's role
KEPT = np.full((4, 4), -1)  # the state after a kept turn, by state and initial
KEPT[START, S], KEPT[START, U], KEPT[FIRST, U], KEPT[USER, A], KEPT[DONE, U] = FIRST, USER, USER, DONE, USER
HELD = 8 << 20  # bytes of texts whose conversations are repaired at once


def costs(kind: np.ndarray, gone: np.ndarray, broken: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(turn, conversation, state): the cheapest way from there to the end. ``kind``, ``gone`` (must be deleted) and ``broken``
    are (turn, conversation); conversations end after ``size`` turns."""
    turns, n = kind.shape
    out = np.empty((turns + 1, n, 4), np.int64)
    out[turns] = np.array([0, INSERT * 2, INSERT, 0])
    for t in reversed(range(turns)):
        then = out[t + 1]
        stay = np.full((n, 4), NEVER)
        for state in range(4):
            after = KEPT[state][kind[t]]
            stay[:, state] = np.where(after >= 0, then[np.arange(n), np.maximum(after, 0)] + KEEP, NEVER)
        stay = np.minimum(stay, then[:, AFTER] + REROLE) + BROKEN * broken[t][:, None]
        best = np.minimum(then + DELETE, np.where(gone[t][:, None], NEVER, stay))
        best[:, [USER, DONE]] = np.minimum(best[:, [USER, DONE]], best[:, [DONE, USER]] + INSERT)
        best[:, [START, FIRST]] = np.minimum(best[:, [START, FIRST]], best[:, [USER]] + INSERT)
        out[t] = np.where((t < size)[:, None], best, out[turns])
    return out


def edits(kind: np.ndarray, gone: np.ndarray, broken: np.ndarray, size: np.ndarray):
    """The cost of each conversation, and its edits in order: arrays of (conversation, letter, turn, state before)."""
    cost = costs(kind, gone, broken, size)
    n = kind.shape[1]
    state, at, steps = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    live = np.arange(n)
    while True:
        live = live[(at[live] < size[live]) | (cost[at[live], live, state[live]] > 0)]
        if not len(live):
            break
        t, s = at[live], state[live]
        left = cost[t, live, s]
        inside = t < size[live]
        row = np.minimum(t, len(kind) - 1) if len(kind) else t
        after = np.minimum(t + 1, len(cost) - 1)
        remove = inside & (cost[after, live, s] + DELETE == left)
        insert = ~remove & (cost[t, live, AFTER[s]] + INSERT == left)
        if len(kind):
            free, extra = inside & ~gone[row, live], BROKEN * broken[row, live]
            then = KEPT[s, kind[row, live]]
            keep = ~remove & ~insert & free & (then >= 0) & (cost[after, live, np.maximum(then, 0)] + KEEP + extra == left)
        else:
            then, keep = s, np.zeros(len(live), bool)
        letter = np.select([remove, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R"))
        steps.append((live, letter, t, s))
        state[live] = np.where(remove, s, np.where(keep, then, AFTER[s]))
        at[live] = t + ~insert
    out = [np.concatenate(x) if steps else np.zeros(0, np.int64) for x in (zip(*steps, strict=True) if steps else [()] * 4)]
    order = np.argsort(out[0], kind="stable")
    return cost[0, :, START], [x[order] for x in out]


def faults(rows: list[tuple]) -> np.ndarray:
    """Per turn (role, text): 1 blank, 2 seen earlier, 3 breaks off, else 0; the first that holds."""
    seen: set[bytes] = set()
    out = np.zeros(len(rows), np.int8)
    for i, (role, text) in enumerate(rows):
        raw = text.encode()
        words = raw.strip(b" \t\n\r\x0b\x0c")
        key = hashlib.md5(f"{len(role)}:{role}".encode() + raw).digest()
        out[i] = 1 if not words else 2 if key in seen else 3 if words[-1:] not in (b".", b"!", b"?") else 0
        seen.add(key)
    return out


COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<edit: string, role: string, text: string>>"


def repaired(conversations: list[tuple]) -> list[tuple]:
    """Rows of COLUMNS for conversations (conv_id, [(turn, role, text), ...]), each bucket of lengths at once."""
    out: list = [None] * len(conversations)
    buckets: dict[int, list[int]] = {}
    for i, (_, rows) in enumerate(conversations):
        buckets.setdefault(len(rows).bit_length(), []).append(i)
    for own in buckets.values():
        n, size = len(own), np.array([len(conversations[i][1]) for i in own], np.int64)
        fault, kind = np.zeros((int(size.max()), n), np.int8), np.zeros((int(size.max()), n), np.int8)
        for j, i in enumerate(own):
            rows = [(role, text) for _, role, text in conversations[i][1]]
            fault[: size[j], j] = faults(rows)
            kind[: size[j], j] = [KINDS.get(role[:1], OTHER) for role, _ in rows]
        pair = 4 * kind[:-1].astype(np.int64) + kind[1:]
        wrong = ~np.isin(pair, [4 * S + U, 4 * U + A, 4 * A + U]) & (np.arange(1, len(kind))[:, None] < size)
        cost, (conv, letter, turn, state) = edits(kind, (fault == 1) | (fault == 2), fault == 3, size)
        ends = np.searchsorted(conv, np.arange(n + 1))
        for j, i in enumerate(own):
            conv_id, rows = conversations[i]
            numbers = [t for t, _, _ in rows if t is not None]
            gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
            span = slice(ends[j], ends[j + 1])
            turns = []
            for c, t, s in zip(map(chr, letter[span].tolist()), turn[span].tolist(), state[span].tolist(), strict=True):
                if c != "D":
                    turns.append({"edit": c, "role": rows[t][1] if c == "K" else GIVEN[s], "text": "" if c == "I" else rows[t][2]})
            audit = letter[span].astype(np.uint8).tobytes().decode()
            out[i] = (conv_id, gaps, *((fault[:, j] == k).sum().item() for k in (1, 2, 3)), wrong[:, j].sum().item(), cost[j].item(), audit, turns)
    return out


TURN = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("turns", pa.list_(TURN))])


def by_conversation(batches):
    """mapInArrow function over (conv_id, turn, role, text, copies), in order: COLUMNS of each conversation."""
    held, size, now, rows = [], 0, None, None

    def flush():
        done = repaired(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)

    for b in batches:
        for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows is None or conv_id != now:
                if size >= HELD or len(held) >= 4096:
                    yield flush()
                    size = 0
                now, rows = conv_id, []
                held.append((conv_id, rows))
            rows += [(turn, role, text)] * copies
            size += len(text)
    if held:
        yield flush()


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """COLUMNS of each conversation of turns (conv_id, turn, role, text): what is wrong with it, the cost and the initials of
    the cheapest edits, and the repaired turns. A column ``copies`` says how often each row counts; conversations whose
    rows count no times are still there."""
    space = F.lit(" ")
    long_ = lambda c: F.col(c).cast("long").alias(c)
    rows = turns.select(long_("conv_id"), long_("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(trimmed(by_conversation), COLUMNS)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, copies) of which some, by the checksum of `conv_id:turn`, are dropped, emptied, without
    their full stops, repeated, or said by the user; nulls are one space."""
    space = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark, sf_dir):
    done = repair(damaged(table(spark, sf_dir, "conversations")), "copies")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select(*[c for c in done.columns if c != "turns"], F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


def op11_sql() -> str:
    """The query in SQL, forward: of each state the cheapest way to it and its string of edits, turn by turn."""
    way = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {s}.r || {line}}}"
    insert = lambda s, role: way(s, INSERT, "I", f"chr(10) || '{role}:'")
    delete = lambda s: way(s, DELETE, "D", "''")
    rerole = lambda s, role: f"case when not gone then {way(s, f'{REROLE} + broken', 'R', f'''chr(10) || '{role}:' || text''')} end"
    keep = lambda s, k: f"case when not gone and k = '{k}' then {way(s, 'broken', 'K', '''chr(10) || role || ':' || text''')} end"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    # Insertions lead from START, FIRST and DONE to USER, and from there to DONE.
    user = lambda s: least(s["u"], *(insert(s[x], "user") for x in ("s0", "s1", "d")))
    never = f"{{'c': {NEVER}, 'a': '', 'r': ''}}"
    stepped = f"""select o.g, o.i, {delete("s0")} as s0, {least(delete("s1"), keep("s0", "s"))} as s1,
      {least(delete("u"), *(rerole(x, "user") for x in ("s0", "s1", "d")), *(keep(x, "u") for x in ("s0", "s1", "d")))} as u, {least(delete("d"), rerole("u", "assistant"), keep("u", "a"))} as d
      from w join o on o.g = w.g and o.i = w.i + 1"""
    closed = lambda source: f"select g, i, s0, s1, u2 as u, {least('d', insert('u2', 'assistant'))} as d from (select *, {user(dict(s0='s0', s1='s1', u='u', d='d'))} as u2 from ({source}))"
    start = f"select g, cast(0 as bigint) as i, {{'c': 0, 'a': '', 'r': ''}} as s0, {never} as s1, {never} as u, {never} as d from convs"
    space = r"\x20\x09-\x0D"
    return f"""with recursive bits as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from (select unnest(range(256)) as i))),
convs as (select conv_id, row_number() over () as g from (select distinct conv_id from conversations)),
n as (select g, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(c.conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations c join convs v on v.conv_id is not distinct from c.conv_id),
f as (select n.*, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: ascii(x)::bigint), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 as f from n, bits),
x as (select g, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case f when 0 then 0 when 3 then 2 else 1 end)) as c from f),
y as materialized (select *, row_number() over (partition by g order by turn nulls first, role, text) as i from x),
s as (select *, row_number() over (partition by g, role, text order by i) as seen, left(role, 1) as k from y),
o as (select *, fault in (1, 2) as gone, case when fault = 3 then {BROKEN} else 0 end as broken, lag(k) over (partition by g order by i) as before
  from (select *, case when not regexp_matches(text, '[^{space}]') then 1 when seen > 1 then 2 when not regexp_matches(text, '[.!?][{space}]*\\z') then 3 else 0 end as fault from s)),
w as ({closed(start)} union all {closed(stepped)}),
m as (select g, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) as n, sum((fault = 1)::int) as blank, sum((fault = 2)::int) as duplicate, sum((fault = 3)::int) as truncated,
  sum((before is not null and before || k not in ('su', 'ua', 'au'))::int) as illegal from o group by g),
e as (select w.g, {least("s0", "d")} as best from w left join m on m.g = w.g where w.i = coalesce(m.n, 0))
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  best.c::bigint as cost, best.a as audit, sha256(substr(best.r, 2)) as repaired_sha256 from convs join e on e.g = convs.g left join m on m.g = convs.g"""


OP11_SQL = op11_sql()
