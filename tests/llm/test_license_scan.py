import random
import re

from wayfind.llm import license_scan as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for k, p in enumerate(b):
            new.append(min(row[k] + (c != p), row[k + 1] + 1, new[k] + 1))
        row = new
    return row[-1]


def spans(words, notice):
    """By all stretches of whole words: the fewest edits first, then the first, without what overlaps (start, end, edits)."""
    most, found = len(notice) // 10, []
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            size = at[j] - 1 - at[i]
            if size > len(notice) + most:
                break
            if size >= len(notice) - most and (d := distance(" ".join(words[i:j]), notice)) <= most:
                found.append((d, at[i], at[j] - 1))
    taken = []
    for d, a, b in sorted(found):
        if all(b < x or a > y for x, y, _ in taken):
            taken.append((a, b, d))
    return sorted(taken)


def brute(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for p, label in L.PHRASES.items():
        w = p.split()
        for i in range(len(words) - len(w) + 1):
            if words[i : i + len(w)] == w:
                places.append(i)
                base.add(label)
    matches = sorted((n, *span) for n in L.NOTICES for span in spans(words, n))
    more = {L.NOTICES[n] for n, *_ in matches}
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))), matches


def texts():
    r = random.Random(8)
    out = ["", None, "...", "MIT License", "mit-license, MIT licenses CC BY CC BY, the ÉMIT license", "cc by", "ccby", "x " * 60 + "Apache License"]
    for n in L.NOTICES:
        for _ in range(4):
            chars = list(n)
            for _ in range(r.randint(0, len(n) // 10 + 1)):
                k = r.randrange(len(chars))
                chars[k : k + 1] = r.choice([[], ["x"], [chars[k], "é"]])
            noise = lambda: " ".join(r.choices(["the", "license", "under", "öde", "permission", "a"], k=r.randint(0, 9)))
            if r.random() < 0.3:  # and another one beside it
                chars += [" "] * r.randint(0, 2) + list(n[r.randint(0, 3) :])
            out.append(f"{noise()} {''.join(chars).upper() if r.random() < 0.3 else ''.join(chars)}, {noise()}")
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string").repartition(3)
    got = {r.doc_id: r for r in L.scan(df).collect()}
    want = {i: brute(t) for i, t in rows}
    assert {i: tuple(g)[1:7] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert {i: sorted((m.notice, m.start, m.end, m.edits) for m in g.matches) for i, g in got.items()} == {i: w[1] for i, w in want.items()}
    for i, g in got.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[i] or ""))
        assert all(len(" ".join(words[: m.first_word + 1])) - len(words[m.first_word]) == m.start for m in g.matches)
    assert all(0 <= g.score <= 1 and (g.score > 0) == bool(g.labels) for g in got.values())
    assert L.scan(df.limit(0)).count() == 0


def test_a_worse_occurrence_beside_a_better_one():
    scanner = L.Scanner(L.PHRASES, L.NOTICES, 10)
    at = lambda text: [(m["notice"], m["start"], m["end"], m["edits"]) for m in scanner.scan(text)[-1]]
    assert at("all rights reservd all rights reserved") == [("all rights reserved", 0, 18, 1), ("all rights reserved", 19, 38, 0)]
    gpl = "under the terms of the gnu general public license"
    assert at(f"{gpl[:-1]} {gpl}") == [(gpl, 0, 48, 1), (gpl, 49, 98, 0)]
    # Whole words only; a missing space is an edit.
    assert at("small rights reserved") == []
    assert at("some text allrights reserved") == [("all rights reserved", 10, 28, 1)]


def test_very_long_hostile_texts():
    import time

    scanner = L.Scanner(L.PHRASES, L.NOTICES, 10)
    began = time.process_time()
    assert scanner.scan("license " * 20_000)[-1] == []
    assert len(scanner.scan("all rights reservd " * 3_000)[-1]) == 3_000
    assert len(scanner.scan("the license under the terms of permission granted " * 2_000)[-1]) == 0
    assert time.process_time() - began < 60
    began = time.process_time()
    got = scanner.scan("mit license " * 400_000)
    assert got[:4] == (800_000, 400_000, 0, 799_998) and time.process_time() - began < 10
    twice = "all rights reserved " * 2
    assert scanner.scan(twice) == scanner.scan(twice) and len(scanner.scan(twice)[-1]) == 2
