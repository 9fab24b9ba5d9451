"""License scans: exact phrases, and a fuzzy search for short notices.

A text is scanned as its lower-cased words with one space between them. A notice of n characters may be met with
``n // every`` edits (insertions, deletions, replacements); an occurrence begins and ends with whole words. Cut into one
piece more than that, the notice keeps at least one piece unchanged in every occurrence; one pass of an automaton over
the text finds all pieces, each of which marks the only stretch that the occurrence can lie in. A stretch goes on only if it
holds enough of the notice's half pieces, of which an occurrence can break no more than one for each edit. There the regex
library's bounded-error matching decides and gives the span and the number of edits.

Of each notice the spans reported are those that a choice by fewest edits, then by place, makes among all its occurrences,
leaving out what overlaps one chosen before; so a worse occurrence beside a better one is reported too.

Null texts are empty: no words, no labels (an empty string), a score of zero. Texts of any length are scanned whole.
doc_id is passed through; repeated rows get a row each; other columns are ignored; an empty table gives an empty result.
"""

from bisect import bisect

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import by_value, table, trimmed

by_value(__name__)

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public notices, as words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under a creative commons attribution": "cc",
    "licensed under cc by 4 0": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
#: A-Z to a-z; other ASCII characters but digits and letters to spaces.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MATCH = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,notice:string,first_word:long,start:long,end:long,edits:long>>"


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], every: int):
        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.notices, self.halves = [], []
        seeds: dict[str, list] = {}
        for n, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // every
            self.notices.append((notice, label, edits, regex.compile(f"(?b)(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}")))
            cut = [len(notice) * k // (2 * edits + 2) for k in range(2 * edits + 3)]
            self.halves.append([notice[a:b] for a, b in zip(cut, cut[1:])])  # noqa: B905
            for a, b in zip(cut[::2], cut[2::2]):  # noqa: B905
                seeds.setdefault(notice[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def places(self, line: str):
        """(where, label) of each phrase in a text of words with spaces around each: the space before it."""
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                yield at, label
                at = line.find(phrase, at + 1)

    def stretches(self, line: str) -> dict[int, list[tuple[int, int]]]:
        """By notice the stretches of a text in which it may occur."""
        near: dict[int, set] = {}
        for last, (size, where) in self.seeds.iter(line):
            for n, offset in where:
                notice, _, edits, _ = self.notices[n]
                a = last + 1 - size - offset  # where the notice would begin; a space stands on both sides of it
                near.setdefault(n, set()).add((max(0, a - edits - 1), min(len(line), a + len(notice) + edits + 1)))
        return {n: own for n, spans in sorted(near.items()) if (own := sorted(x for x in spans if self.enough(n, line[x[0] : x[1]])))}

    def enough(self, n: int, stretch: str) -> bool:
        halves = self.halves[n]
        return sum(map(stretch.__contains__, halves)) >= len(halves) - self.notices[n][2]

    def occurrences(self, n: int, line: str, a: int, b: int):
        """(edits, start, end) of the notice's occurrences in a stretch: each run of its whole words with a possible length."""
        notice, _, edits, pattern = self.notices[n]
        spaces = [i for i in range(a, b) if line[i] == " "]
        for k, before in enumerate(spaces):
            for after in spaces[k + 1 :]:
                size = after - before - 1
                if size > len(notice) + edits:
                    break
                if size >= len(notice) - edits and self.enough(n, line[before + 1 : after]) and (m := pattern.fullmatch(line, before + 1, after)):
                    yield sum(m.fuzzy_counts), before + 1, after

    def found(self, line: str):
        """(notice, start, end, edits) of the notices in a text."""
        for n, stretches in self.stretches(line).items():
            taken: list[tuple[int, int, int]] = []
            for edits, a, b in sorted({x for stretch in stretches for x in self.occurrences(n, line, *stretch)}):
                i = bisect(taken, (a, b, 0))
                if not (i and taken[i - 1][1] > a or i < len(taken) and taken[i][0] < b):
                    taken.insert(i, (a, b, edits))
            yield from ((n, *span) for span in taken)

    def scan(self, text: str):
        words = text.encode().translate(WORDS).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        line = f" {b' '.join(words).decode()} "
        places = list(self.places(line))
        base = {label for _, label in places}
        matches = [(n, a, b, e) for n, a, b, e in self.found(line)]
        labels = base | {self.notices[n][1] for n, *_ in matches}
        score = 1.0 if base else max((1 - e / len(self.notices[n][0]) for n, _, _, e in matches), default=0.0)
        spaces = [i for i, c in enumerate(line) if c == " "] if places or matches else []
        rows = [{"label": self.notices[n][1], "notice": self.notices[n][0], "first_word": bisect(spaces, a) - 1, "start": a - 1, "end": b - 1, "edits": e} for n, a, b, e in matches]
        at = [bisect(spaces, p) - 1 for p, _ in places]
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, rows


def scanned(phrases, notices, every):
    def run(batches):
        scanner = Scanner(phrases, notices, every)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(MATCH)]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for b in batches:
            rows = [scanner.scan(t.as_py() or "") for t in b.column(1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return run


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, every: int = 10) -> DataFrame:
    """COLUMNS of each document (doc_id, text). Phrases are matched exactly, notices with an edit for each ``every``
    characters. matches: label, notice, word in which it begins, span in the text of words and single spaces, edits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(scanned(dict(phrases), dict(notices), every)), COLUMNS)


def op1_license_scan(spark, sf_dir):
    """The digest columns, and the spans of all notices as JSON."""
    return scan(table(spark, sf_dir, "documents")).withColumn("matches", F.to_json("matches"))
