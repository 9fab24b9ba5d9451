"""Periodic runs of words, by bit-parallel lags.

The ids of a text's words are held as bit planes, one big integer for each bit of an id. For a lag q, planes XORed with
themselves shifted by q, and ORed together, have a one wherever words q apart differ. ANDs of the complement with itself, shifted
by 1, 2, 4 and so on, leave the beginnings of stretches of zeros that are long enough for a run. A stretch whose smallest period
is a divisor of q has been found with that one before, at the same start and length, as a run is at least three periods long.

In a text of more than SMALL words, lags are tried only if they can have a run: a run of period q holds, among any words that
lie q apart, three in a row that are equal, and these two periods of it don't lie inside a run whose period divides q. Both
are necessary, so no run is lost; what is left of a text of n words is n/q comparisons for a lag q instead of n.

A null or empty text has no words and no runs; a text of any length is treated whole, in one task, in memory of a few bytes
for each word. doc_id is passed through as it is, null too; repeated rows get a row each; other columns are ignored. An empty
table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import by_value, table, trimmed

by_value(__name__)

LEAST, TIMES = 24, 3  # a run's least length in words and in periods
SMALL = 1024  # up to here all lags are tried, as that is faster
PHASES = 3


def planes_of(ids: np.ndarray) -> list[int]:
    """Big integers: bit i of plane k is bit k of the i-th id."""
    width = int(ids.max()).bit_length()
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(width)]


def stretches(same: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of ``least`` ones or more."""
    x, have = same, 1
    while have < least and x:
        step = min(have, least - have)
        x &= x >> step
        have += step
    if not x:
        return []
    out = []
    first, last = x & ~(x << 1), x & ~(x >> 1)
    size = (x.bit_length() + 7) // 8
    bits = lambda v: np.flatnonzero(np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), bitorder="little"))
    for a, b in zip(bits(first).tolist(), bits(last).tolist(), strict=True):
        out.append((a, b - a + least))
    return out


class Runs:
    """Runs found so far: those of one text, by rising period."""

    def __init__(self):
        self.found: dict[tuple[int, int], int] = {}
        self.spans: list[tuple[int, int, int]] = []
        self.array = np.zeros((0, 3), np.int64)

    def add(self, start: int, length: int, q: int) -> None:
        if (start, length) not in self.found:
            self.found[start, length] = q
            self.spans.append((start, start + length, q))

    def inside(self, at: np.ndarray, q: int) -> np.ndarray:
        """Whether the words from ``at`` to at + 2q lie in one run whose period divides q."""
        if len(self.array) < len(self.spans):
            self.array = np.array(sorted(self.spans), np.int64).reshape(-1, 3)
        own = self.array[q % self.array[:, 2] == 0] if len(self.array) else self.array
        if not len(own):
            return np.zeros(len(at), bool)
        place = np.searchsorted(own[:, 0], at, side="right") - 1
        return (place >= 0) & (np.maximum.accumulate(own[:, 1])[np.maximum(place, 0)] >= at + 2 * q)


def possible(ids: np.ndarray, q: int, runs: Runs) -> bool:
    """Whether a lag can have a run that no shorter lag has."""
    for phase in range(min(q, PHASES)):
        x = ids[phase::q]
        equal = x[1:] == x[:-1]
        at = np.flatnonzero(equal[1:] & equal[:-1])
        if not len(at) or runs.inside(phase + at * q, q).all():
            return False
    return True


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of ids from 0, by start and period: of at least ``least`` words
    and ``times`` (3 or more) periods, and as long as the period allows."""
    n, runs = len(ids), Runs()
    if n < least:
        return []
    planes = planes_of(ids)
    for q in range(1, n // times + 1):
        need = max(least - q, (times - 1) * q)
        if n > SMALL and 2 * q <= need and q >= PHASES and not possible(ids, q, runs):
            continue
        differ = 0
        for p in planes:
            differ |= p ^ p >> q
        for start, length in stretches(~differ & (1 << n - q) - 1, need):
            runs.add(start, length + q, q)
    return sorted((a, b - a, q) for a, b, q in runs.spans)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: those of a run after its first period go."""
    step = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


COLUMNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def found(least: int, times: int):
    """mapInArrow function: (doc_id, text) to COLUMNS."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            counts, all_runs, texts = [], [], []
            for s in b.column(1):
                words = (s.as_py() or "").encode().split()
                place: dict[bytes, int] = {}
                ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
                runs = runs_of(ids, least, times)
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
                counts.append(len(ids))
                all_runs.append([{"start": s, "length": size, "period": q} for s, size, q in runs])
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(run_type)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """COLUMNS of each document (doc_id, text): all runs by start and period, and the text's words without those that a run
    repeats, joined by spaces."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(found(least, times)), COLUMNS)


def repeated_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document of ten, by its id's checksum, goes on from some word by repeating a stretch of
    its words. A null id has no checksum, and its text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("_w"), F.floor(h / 10).alias("_g"))
    n, g = F.size("_w"), F.col("_g")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")

    def again(words: Column) -> Column:
        many = F.array_repeat(F.slice(words, F.col("_a") + 1, F.col("_p")), F.ceil((n - F.col("_a")) / F.col("_p")).cast("int"))
        return F.array_join(F.concat(F.slice(words, 1, F.col("_a")), F.slice(F.flatten(many), F.lit(1), n - F.col("_a"))), " ")

    cut = rows.withColumns({"_a": F.when(n > 0, a), "_p": F.when(n > 0, p)})
    return cut.select("doc_id", F.when(n > 0, again(F.col("_w"))).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = F.col("runs")
    none = F.get(runs, F.lit(-1))
    best = F.aggregate(runs, none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = periodic_runs(repeated_ends(docs)).withColumn("_best", best)
    return out.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), digest(F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_sql() -> str:
    """The query in SQL: lags by the same necessary test at one phase, then all words of the lags that are left."""
    space = r"\x20\x09-\x0D"
    return f"""with bits as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from (select unnest(range(256)) as i))),
d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^{space}]+') as ws from documents),
h as (select d.*, len(ws) as n, case when doc_id is not null then xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) end as h from d, bits),
p as (select r, doc_id, n, ws, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, 3 + (h // 10) % 8 as parts from h),
raw as materialized (select r, n, a, case when a is not null then 1 + (n - a) // parts end as p, unnest(ws) as w, unnest(range(n)) as i from p),
word as materialized (select x.r, x.n, x.i, y.w from (select r, n, i, case when a is not null and i >= a then a + (i - a) % p else i end as at from raw) x join raw y on y.r = x.r and y.i = x.at),
ids as materialized (select r, n, i, w, dense_rank() over (order by w) as k from word),
lags as (select r, n, unnest(range(1, n // {TIMES} + 1)) as q from p where n >= {LEAST}),
anchors as (select r, n, q, unnest(range(0, n - 2 * q, q)) as i from lags),
one as materialized (select s.*, a.k from anchors s join ids a on a.r = s.r and a.i = s.i),
two as materialized (select one.* from one join ids b on b.r = one.r and b.i = one.i + one.q and b.k = one.k),
tried as materialized (select distinct two.r, two.q from two join ids c on c.r = two.r and c.i = two.i + 2 * two.q and c.k = two.k),
begun as materialized (select t.r, t.q, a.i, a.k from tried t join ids a on a.r = t.r),
same as materialized (select s.r, s.q, s.i from begun s join ids b on b.r = s.r and b.i = s.i + s.q and b.k = s.k),
isles as (select r, q, min(i) as start, count(*) + q as size from (select r, q, i, i - row_number() over (partition by r, q order by i) as isle from same) group by r, q, isle),
runs as materialized (select r, start, size, min(q) as q from isles where size >= greatest({LEAST}, {TIMES} * q) group by r, start, size),
best as (select * from runs qualify row_number() over (partition by r order by size::double / q desc, start, q) = 1),
said as (select r, count(*) as n_runs, sha256(string_agg(start || ',' || size || ',' || q || chr(10), '' order by start, q)) as digest from runs group by r),
gone as (select distinct r, unnest(range(start + q, start + size)) as i from runs),
left_ as (select r, sha256(string_agg(w, ' ' order by i)) as digest from word where not exists (select 1 from gone where gone.r = word.r and gone.i = word.i) group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.size::bigint as length, best.q::bigint as period, (1000 * best.size // best.q)::bigint as exponent_milli, coalesce(said.digest, sha256('')) as runs_sha256, coalesce(left_.digest, sha256('')) as collapsed_sha256
from p left join said on said.r = p.r left join best on best.r = p.r left join left_ on left_.r = p.r"""


OP13_SQL = op13_sql()
