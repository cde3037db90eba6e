"""Line dedup against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulant.llm import line_dedup as ld
from tabulant.llm.editdistance import cut, key_plan, within

from .conftest import frame, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


BLANKS = " \t\n\x0b\x0c\r"


def brute_repeats(docs, edits, least):
    """(doc, line, first_doc, first_line) by comparing all lines."""
    seen = {}
    for d, t in docs:
        for p, x in enumerate((t or "").split("\n")):
            if d is not None and x.strip(BLANKS):
                seen[d, p] = x
    distinct = sorted(set(seen.values()))
    low = {x: x for x in distinct}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    long = [x for x in distinct if len(x) >= least]
    for i, x in enumerate(long):
        for y in long[i + 1:]:
            if abs(len(x) - len(y)) <= edits and distance(x, y) <= edits:
                low[find(y)] = find(x)
    first = {}
    for at in sorted(seen):
        first.setdefault(find(seen[at]), at)
    return {(*at, *first[find(x)]) for at, x in seen.items() if first[find(x)] != at}


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)),
       st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2), st.integers(97, 99)), max_size=6), st.integers(1, 9))
def test_banded_distance_is_exact(a, changes, edits):
    b = a
    for at, kind, byte in changes:
        at %= len(b) + 1
        b = b[:at] + [b"", bytes([byte]), bytes([byte])][kind] + b[at + (kind != 1):]
    assert within([a, b], [b, a], edits).tolist() == [distance(a, b) <= edits] * 2


def test_banded_distance_of_many_lengths_at_once():
    rng = random.Random(1)
    a = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    b = [bytes(x for x in s if rng.random() > 0.01) + rng.choice([b"", b"a"]) for s in a]
    assert within(a, b, 2).tolist() == [distance(x, y) <= 2 for x, y in zip(a, b)]
    assert within([], [], 2).tolist() == []


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=9, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)),
       st.lists(st.tuples(st.integers(0, 60), st.integers(0, 2), st.integers(97, 98)), max_size=3))
def test_near_lines_always_share_a_key(a, changes):
    b = a
    for at, kind, byte in changes:
        at %= len(b) + 1
        b = b[:at] + [b"", bytes([byte]), bytes([byte])][kind] + b[at + (kind != 1):]
    if len(b) < 9 or distance(a, b) > 3:
        return
    a, b = sorted((a, b), key=len)
    index = {(a[s:e], seed) for s, e, seed, role in key_plan(len(a), 3) if role & 1}
    probe = {(b[s:e], seed) for s, e, seed, role in key_plan(len(b), 3) if role & 2}
    assert index & probe


def test_segments_cover_the_line():
    for n in range(3, 50):
        parts = cut(n, 3)
        assert sum(size for _, size in parts) == n and [s for s, _ in parts] == np.cumsum([0] + [z for _, z in parts][:-1]).tolist()


def _planted(rng):
    lines = [words(rng, 6) for _ in range(25)]
    docs = []
    for i in range(40):
        body = []
        for x in rng.sample(lines, 4):
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice(["", "x", "yé"]) + x[at + rng.randint(0, 1):]
            body.append(x)
        docs.append((i, "\n".join(body + ["short", ""])))
    return docs


def test_repeats_match_brute_force(spark, monkeypatch):
    docs = _planted(random.Random(2))
    want = brute_repeats(docs, 2, 12)
    get = lambda: {tuple(r) for r in ld.duplicate_lines(frame(spark, docs), min_chars=12).collect()}
    assert len(want) > 40 and get() == want
    monkeypatch.setattr(ld, "CELL", 3)      # every group is split into squares of blocks
    monkeypatch.setattr(ld, "SCREEN", 4)    # and most are fetched without screening
    assert get() == want


def test_edits_are_characters(spark):
    """One sign for another is one edit whatever its length in UTF-8; short lines are compared for equality."""
    a = "it\'s the same line, whole as it is"
    docs = [(1, a), (2, a.replace("\'", "\u2019")), (3, a.replace("same", "sämé")), (4, a.replace("whole", "\U0001F389hol\u6f22")),
            (5, a.replace("line", "LINE")), (6, "} end\n \t\n\n" + a + "ß"), (7, "} end\n} End"), (8, "} end"), (9, "x" * 23 + "\n" + "x" * 22 + "y")]
    got = {tuple(r) for r in ld.duplicate_lines(frame(spark, docs)).collect()}
    assert got == brute_repeats(docs, 2, 24) == {(i, 0, 1, 0) for i in (2, 3, 4)} | {(6, 3, 1, 0), (7, 0, 6, 0), (8, 0, 6, 0)}


def test_distance_of_texts_in_any_script():
    rng = random.Random(3)
    a = ["".join(rng.choice("abé漢🎉") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    b = ["".join(x for x in s if rng.random() > 0.03) + rng.choice(["", "a", "漢"]) for s in a]
    for edits in (1, 2, 5):
        assert within(a, b, edits).tolist() == [distance(x, y) <= edits for x, y in zip(a, b)]


def test_memory_is_bounded_by_runs_of_cells(spark, monkeypatch):
    """Few rows held at a time: the same repeats."""
    docs = _planted(random.Random(7))
    monkeypatch.setattr(ld, "HELD", 8)
    monkeypatch.setattr(ld, "HELD_LINES", 4)
    got = {tuple(r) for r in ld.duplicate_lines(frame(spark, docs), min_chars=12).collect()}
    assert got == brute_repeats(docs, 2, 12)


def test_copies_with_short_lines_go_whole(spark):
    body = "a line that is long enough to be compared\nshort one\n\nanother line that is long enough for that"
    docs = frame(spark, [(1, body), (2, body), (3, body + "\nand a line of its own that nobody else has"), (4, "short one\nmine")])
    kept = {r.doc_id: r.text for r in ld.drop_lines(docs, ld.duplicate_lines(docs)).collect()}
    assert kept == {1: body, 3: "short one\n\nand a line of its own that nobody else has", 4: "short one\nmine"}


def test_no_task_screens_a_hot_cell_whole(spark, monkeypatch):
    """Distinct lines with one beginning: the rows of a cell stay bounded, and the repeats are those of brute force."""
    rng = random.Random(5)
    lines = ["2026-01-01 00:00:00 INFO " + "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(300)]
    lines += [x[:-1] + "z" for x in lines[:40]]
    docs = frame(spark, [(i, "\n".join([x, lines[0]])) for i, x in enumerate(lines)])
    monkeypatch.setattr(ld, "GATHER", 32)
    monkeypatch.setattr(ld, "SAMPLE", 2)
    largest = lambda keys: keys.groupBy("cell", "role").count().agg({"count": "max"}).first()[0]
    keys = ld._keys(docs, "text", 24, 2).distinct()
    assert largest(keys) > 300
    assert largest(ld._spread(keys, ld._keys(docs, "text", 24, 2, 2))) < 100
    got = {tuple(r) for r in ld.duplicate_lines(docs).collect()}
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 2, 24) and len(got) >= 340


def test_a_task_gives_a_repeated_line_once(spark):
    docs = frame(spark, [(i, "a line that every document has, whole") for i in range(2000)]).coalesce(1)
    keys = ld._keys(docs, "text", 24, 2)
    assert keys.count() == keys.distinct().count()


def test_messy_rows(spark, messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = {tuple(r) for r in ld.duplicate_lines(messy).collect()}
    assert got == brute_repeats(rows, 2, 24)
    out = ld.drop_lines(messy, ld.duplicate_lines(messy))
    assert out.columns == messy.columns
    kept = out.collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id in (1, 2, 3, 10) and r.text) == [(3, "   "), (10, "\n\n")]
    assert 7 not in {r.doc_id for r in kept} and {4, 5, 6, 8, 9, 11, 12} <= {r.doc_id for r in kept}
    twelve = next(r for r in kept if r.doc_id == 12)
    assert twelve.text.count("\n") == 0 and twelve.n_chars == len(twelve.text)
    assert ld.duplicate_lines(messy.limit(0)).count() == 0
    assert ld.drop_lines(messy.limit(0), ld.duplicate_lines(messy.limit(0))).count() == 0


def test_query_on_the_small_table(spark):
    from tabulant.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_repeats_fast(docs, 2, 24)
    got = QUERIES["op8_line_dedup"](spark, sf).collect()
    assert {(r.doc_id, p) for r in got for p in r.repeated_lines} == want
    assert {r.doc_id: r.n_lines for r in got} == {d: t.count("\n") + 1 for d, t in docs}


def brute_repeats_fast(docs, edits, least):
    """As ``brute_repeats``, all pairs of near lengths, with a cheap bound before the distance."""
    seen = {(d, p): x for d, t in docs for p, x in enumerate(t.split("\n")) if x.strip(BLANKS)}
    distinct = sorted(set(seen.values()))
    low = {x: x for x in distinct}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    long = [x for x in distinct if len(x) >= least]
    counts = np.array([np.bincount([ord(c) % 256 for c in x], minlength=256) for x in long])
    for i in range(len(long)):
        close = np.flatnonzero(np.abs(counts[i + 1:] - counts[i]).sum(1) <= 2 * edits) + i + 1
        for j in close:
            if distance(long[i], long[j]) <= edits:
                low[find(long[j])] = find(long[i])
    first = {}
    for k in sorted(seen):
        first.setdefault(find(seen[k]), k)
    return {k for k, x in seen.items() if first[find(x)] != k}
