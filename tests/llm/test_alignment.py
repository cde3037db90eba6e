"""Alignment against the two libraries' own tokens of whole texts, compared byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulant.llm import alignment, queries
from .conftest import frame, words

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    a, b = alignment.ByteLevel.load(), alignment.Pieces.load()
    a.open(), b.open()
    return a, b


def fresh():
    """Sides to ship with a job: files only, libraries are opened where they run."""
    return alignment.ByteLevel.load(), alignment.Pieces.load()


def brute(texts, sides):
    """Per text the result columns, from tokens of the whole text and a map from bytes to tokens."""
    a, b = sides
    links, shapes = [], []
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids = [s.encode([text])[0] for s in (a, b)] if text else [[], []]
        if not text or any(b"".join(s.bytes[i] for i in x) != raw for s, x in zip(sides, ids)):
            links.append([])
            shapes.append((0, 0, 0, ""))
            continue
        owner, ends = [], []
        for s, x in zip(sides, ids):
            owner.append([n for n, i in enumerate(x) for _ in s.bytes[i]])
            ends.append(set(np.cumsum([len(s.bytes[i]) for i in x]).tolist()))
        pairs = set(zip(*owner))
        links.append([(ids[0][i], ids[1][j]) for i, j in pairs])
        groups, at = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(x[n]) for n in dict.fromkeys(o[at:end])) for x, o in zip(ids, owner)))
            at = end
        shapes.append((len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for x in links for p in x)
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [(na, nb, ng, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), sha)
            for x, (na, nb, ng, sha) in zip(links, shapes)]


def check(spark, rows, sides):
    got = alignment.align(frame(spark, rows), *fresh()).select(COLUMNS).collect()
    order = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    expected = sorted(((key, *r) for (key, _), r in zip(rows, brute([t for _, t in rows], sides))), key=order)
    assert sorted((tuple(r) for r in got), key=order) == expected


def texts():
    rng = random.Random(7)
    odd = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\n\nb  c\t d", "don't we'll 'tis it's", "x=1;  y = 22222 ...",
           "naïve café ß 你好 世界 🎉🎉 a b a  b", "a▁b", "▁", "one ▁ two", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00 \x01a \x7f b",
           "a​ b ​c", "é é ﬁ", "﻿bom x", "   lead and trail   ", "\n", "\r\n a\r\n", "tab\t\tb \t c", "ａｂ　ｃ", "w" * 3000,
           "a\x1c b\x85 c", "0123456789 " * 50, "नमस्ते दुनिया", "مرحبا بالعالم"]
    return odd + [words(rng, n) for n in (1, 5, 50, 400)] + [
        "".join(rng.choice(" \n\t.,'aAbé🎉▁"[:-1] + "tse") for _ in range(rng.randint(1, 60))) for _ in range(200)]


def test_against_brute_force(spark, sides):
    check(spark, list(enumerate(texts())) + [(None, "a b c"), (3, "twice"), (3, "twice")], sides)


def test_small_lots_slices_and_memory(sides, monkeypatch):
    """Texts of several slices, units forgotten between lots: the same numbers."""
    for name, value in (("LOT", 40), ("REMEMBER", 60), ("JOINED", 16)):
        monkeypatch.setattr(alignment, name, value)
    body = [t for t in texts()]
    table = alignment.UnitTable(*sides)
    total, hashes, cuts, place, often, pairs, sums = alignment.align_lot(body, table)
    expected = brute(body, sides)
    assert [tuple(t) for t in total.tolist()] == [e[:4] for e in expected]
    assert hashes == [e[6] for e in expected]
    assert [int(often[s:e].sum()) for s, e in zip(cuts, cuts[1:])] == [e[3] for e in expected]
    assert int(sums.sum()) == sum(e[3] for e in expected) and len(set(pairs.tolist())) == len(pairs)
    rows = [sum(int(sums[p]) * int(o) for p, o in zip(place[s:e], often[s:e])) for s, e in zip(cuts, cuts[1:])]
    assert rows == [e[5] for e in expected]


def test_coalesce_on_random_cuts():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 30)
        cut = [sorted({n} | set(rng.sample(range(1, n), rng.randint(0, n - 1)) if n > 1 else ())) for _ in range(2)]
        ends = [np.array(c) for c in cut]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        ga, gb, left, right = alignment.coalesce(starts[0], ends[0], starts[1], ends[1])
        both = sorted(set(cut[0]) & set(cut[1]))
        assert ga.tolist() == [sum(b <= s for b in both) for s in starts[0]] and gb.tolist() == [sum(b <= s for b in both) for s in starts[1]]
        assert set(zip(left.tolist(), right.tolist())) == {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
                                                           if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])}


def test_pair_counts_ties_and_hot_pair(spark):
    rows = [(1 << 32 | 5, 3), (2 << 32 | 5, 2), (2 << 32 | 5, 1), (3 << 32 | 5, 1), (9 << 32 | 6, 1)] + [(7 << 32 | 7, 1)] * 3000
    got = {r.code: (r.total, r.best) for r in alignment.pair_counts(spark.createDataFrame(rows, "code long, n long")).collect()}
    assert got == {1 << 32 | 5: (3, True), 2 << 32 | 5: (3, True), 3 << 32 | 5: (1, False), 9 << 32 | 6: (1, True), 7 << 32 | 7: (3000, True)}


def test_messy_and_empty_tables(spark, messy, sides):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    got = alignment.align(messy, *fresh()).select(COLUMNS).collect()
    order = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    expected = [(k, *r) for (k, _), r in zip(rows, brute([t for _, t in rows], sides))]
    assert sorted((tuple(r) for r in got), key=order) == sorted(expected, key=order)
    assert alignment.align(frame(spark, []), *fresh()).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(frame(spark, [(1, None)]), *fresh()).select(COLUMNS).collect()] == [(0,) * 6 + ("",)]


def test_query_on_a_table(spark, sides):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op11_alignment(spark, sf).select(COLUMNS).collect())
    assert got == sorted((d.doc_id, *r) for d, r in zip(docs, brute([d.text for d in docs], sides)))
