"""Quality rules with suffix-array repetition.

Word suffixes of each text are put in order by prefix doubling (only suffixes that still tie are sorted again), for many
texts at once; suffixes of different texts never tie. The ranks of each doubling give the longest common prefixes of
neighbours. Every suffix lies in a deepest LCP interval, which is a repeat that can't be made longer to the right; those
that could be made longer to the left are left out, and what remains are the maximal repeats of ``least`` words or more.
Their spans are united; the verdict limits the share of words that they cover, and the longest one's share.

Null and empty texts have no words and are not kept. A text of any length is treated whole. doc_id is passed through as
it is: repeated rows get a row each. Other columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import SPACE, by_value, table, trimmed

by_value(__name__)

SYMBOLS = b"#*$%&|<>"
LEAST, MAX_COVERED, MAX_LONGEST = 8, 0.3, 0.2
HELD = 1 << 17  # words that are sorted at once; one text may have more


def repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word of the texts (``text`` rises) the number of words from there on that occur again in the text."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(text, text, side="right")
    order = np.argsort(text * (int(words.max()) + 1) + words, kind="stable")
    fresh = np.r_[True, (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])]
    at = np.arange(n)  # places of the order that still tie
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    levels, h = [rank.copy()], 1
    at = at[~fresh | ~np.r_[fresh[1:], True]]
    while len(at):
        here = order[at]
        after = here + h
        second = np.where(after < end[here], rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[here]
        again = np.argsort(first * (n + 1) + second, kind="stable")
        here, first, second = here[again], first[again], second[again]
        order[at] = here
        fresh = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[here] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        levels.append(rank.copy())
        h *= 2
        at = at[~fresh | ~np.r_[fresh[1:], True]]
    common = np.zeros(n + 1, np.int64)  # of each place of the order with the place before
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    i, j, size = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    for k in reversed(range(len(levels))):
        inside = (i + size < end[i]) & (j + size < end[j])
        same = inside & (levels[k][np.minimum(i + size, n - 1)] == levels[k][np.minimum(j + size, n - 1)])
        size[same] += 1 << k
    common[pair] = size
    out = np.empty(n, np.int64)
    out[order] = np.maximum(common[:-1], common[1:])
    return out


def covered(longest: np.ndarray, text: np.ndarray, n_texts: int, least: int):
    """Per text: words within repeats of ``least`` words or more, and the longest of these."""
    start = np.flatnonzero(longest >= least)
    before = np.maximum(start - 1, 0)
    left = (start > 0) & (text[before] == text[start]) & (longest[before] > longest[start])
    start = start[~left]  # a repeat that goes on to the left is part of the one before
    step = np.zeros(len(longest) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + longest[start], -1)
    inside = np.cumsum(step[:-1]) > 0
    most = np.zeros(n_texts, np.int64)
    np.maximum.at(most, text[start], longest[start])
    return np.bincount(text[inside], minlength=n_texts), most


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def measures(texts: list[str], least: int) -> np.ndarray:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat."""
    out = np.zeros((len(texts), 7), np.int64)
    ids: dict[bytes, int] = {}
    flat: list[int] = []
    for i, s in enumerate(texts):
        b = s.encode()
        words = b.split()
        lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
        out[i, :4] = len(words), len(s) - len(b) + len(b.translate(None, SPACE)), len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines))
        flat += [ids.setdefault(w, len(ids)) for w in words]
    text = np.repeat(np.arange(len(texts)), out[:, 0])
    longest = repeats(np.array(flat, np.int64), text)
    out[:, 4] = covered(np.minimum(longest, 3), text, len(texts), 3)[0]
    out[:, 5], out[:, 6] = covered(longest, text, len(texts), least)
    return out


def rules(least, max_covered, max_longest):
    """mapInArrow function: (doc_id, text) to COLUMNS."""

    def run(batches):
        for b in batches:
            done, held, size = [], [], 0
            for s in b.column(1):
                held.append(s.as_py() or "")
                size += len(held[-1])
                if size > 6 * HELD:
                    done.append(measures(held, least))
                    held, size = [], 0
            done.append(measures(held, least))
            m = np.concatenate(done)
            n = m[:, 0]
            failed = (n < 50) | (100 * m[:, 4] > 50 * n)
            kept = ~failed & (m[:, 5] <= max_covered * n) & (m[:, 6] <= max_longest * n)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[:, k].copy()) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(m[:, 5].copy()), pa.array(m[:, 6].copy())], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def quality(docs: DataFrame, least: int = LEAST, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """COLUMNS of each document (doc_id, text). kept: not base_failed, and maximal repeats of ``least`` words or more
    cover max_covered of the words at most, and the longest one has max_longest of them at most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(rules(least, max_covered, max_longest)), COLUMNS)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns, without a shuffle."""
    inner = rules(LEAST, MAX_COVERED, MAX_LONGEST)

    def run(batches):
        for b in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(b.schema.get_field_index("text"))], ["doc_id", "text"])
            for out in inner([pair]):
                yield b.filter(out.column(7))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op4_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


def op4_sql(levels: int = 16) -> str:
    """The rules in SQL, for texts of fewer than 2 ** ``levels`` words. Windows of 2 ** k words are told by hashes of two halves;
    the longest repeat is found bit by bit, as every part of a repeat is a repeat."""
    space = r"\x20\x09-\x0D"
    window = "partition by r order by i"
    hashes = [f"h{k} as materialized (select *, case when i + {1 << k} <= n then hash(h{k - 1}, lead(h{k - 1}, {1 << k - 1}) over ({window})) end as h{k} from h{k - 1})" for k in range(1, levels)]
    steps = [f"l{levels} as materialized (select r, i, 0 as size, cast(0 as ubigint) as c from h0)"]
    for k in reversed(range(levels)):
        steps.append(f"t{k} as materialized (select l.r, l.i, l.size, l.c, case when h.h{k} is not null then hash(l.c, h.h{k}) end as d from l{k + 1} l left join h{levels - 1} h on h.r = l.r and h.i = l.i + l.size)")
        steps.append(f"g{k} as (select r from (select r, d from t{k} where d is not null group by r, d having count(*) > 1) group by r)")
        steps.append(f"l{k} as materialized (select t.r, i, case when g.r is null then size else size + {1 << k} end as size, case when g.r is null then c else d end as c from t{k} t left join g{k} g on g.r = t.r where g.r is null or d is not null)")

    def covered(size: int, name: str) -> str:
        ids = [f"lead(word, {j}) over ({window})" for j in range(1, size)]
        return f"""{name}_w as (select r, i, case when i + {size} <= n then hash(word, {", ".join(ids)}) end as d from words),
{name}_s as (select r, i, d is not null and count(*) over (partition by r, d) > 1 as again from {name}_w),
{name} as (select r, count(*) as n from (select r, max(again) over ({window} rows between {size - 1} preceding and current row) as inside from {name}_s) where inside group by r)"""

    return f"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as (select r, doc_id, t, regexp_extract_all(t, '[^{space}]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as lines from docs),
words as materialized (select r, len(ws) as n, unnest(ws) as word, unnest(range(len(ws))) as i from m),
h0 as materialized (select r, n, i, hash(word) as h0 from words),
{", ".join(hashes)},
{", ".join(steps)},
longest as (select r, max(size) as size from l0 group by r),
{covered(3, "three")},
{covered(LEAST, "many")},
f as (select m.*, len(ws) as n, coalesce(three.n, 0) as n3, coalesce(many.n, 0) as n8, case when size >= {LEAST} then size else 0 end as size
  from m left join three on three.r = m.r left join many on many.r = m.r left join longest on longest.r = m.r)
select doc_id, n as n_words, length(regexp_replace(t, '[{space}]', '', 'g')) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n3 as n_repeat_words, n < 50 or 100 * n3 > 50 * n as base_failed,
  not (n < 50 or 100 * n3 > 50 * n) and n8 <= cast({MAX_COVERED} as double) * n and coalesce(size, 0) <= cast({MAX_LONGEST} as double) * n as kept,
  n8 as covered_words, cast(coalesce(size, 0) as bigint) as longest_repeat
from f"""


OP4_SQL = op4_sql()
